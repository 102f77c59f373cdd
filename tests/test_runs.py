import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from hitlytics.operators import runs

from helpers import at, rows


def brute_force(events):
    found = []
    for key in {k for k, *_ in events}:
        timeline = sorted((ts, i, failed) for k, ts, i, failed in events if k == key)
        for failed, group in groupby(timeline, key=lambda e: e[2]):
            group = list(group)
            if failed:
                found.append((key, len(group), group[0][0], group[-1][0]))
    return sorted(found)


def check(spark, events, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(events, "k string, ts timestamp, id int, failed boolean").repartition(3)
        got = runs.failure_runs(df, ["k"], ["ts", "id"], F.col("failed"), threshold=10)
        chunks = runs.segments(df, ["k"], ["ts", "id"], F.col("failed")).select("chunk").distinct().count()
        from datetime import timezone
        have = sorted((r["k"], r["failures"], r["started_at"].astimezone(timezone.utc),
                       r["ended_at"].astimezone(timezone.utc)) for r in got.collect())
        assert have == brute_force(events)
        assert {r["poison"] == (r["failures"] >= 10) for r in got.collect()} == {True}
        return chunks
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("failure_rate", [0.02, 0.5, 0.97])
def test_runs_of_a_hot_key_cross_chunks(spark, failure_rate):
    rng = random.Random(int(failure_rate * 100))
    events = [("hot" if i % 5 else rng.choice("xyz"), at(rng.randrange(300)), i, rng.random() < failure_rate)
              for i in range(700)]
    assert check(spark, events, 7) > 2


def test_whole_chunks_of_failures(spark):
    events = [("k", at(i), i, True) for i in range(300)] + [("k", at(300), 300, False), ("k", at(301), 301, True)]
    assert check(spark, events, 6) > 2


def test_null_counts_as_success(spark):
    df = spark.createDataFrame([("k", 1, True), ("k", 2, None), ("k", 3, True)], "k string, n int, f boolean")
    assert rows(runs.failure_runs(df, ["k"], ["n"], F.col("f")), "failures", "started_at") == [(1, 1), (1, 3)]
