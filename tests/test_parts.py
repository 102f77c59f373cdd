"""Parts and published states: reruns, rival publishers, merging of all tables, look-ups by time, due retries, counters."""

import json
from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hitlytics.operators import dedupe, runs
from hitlytics.plans import analytics
from hitlytics.plans.batch import ingest_batch, survey
from hitlytics.operators import envelope
from hitlytics.schema import RUN_SEGMENT
from hitlytics.session import shared_path
from hitlytics.sources import queue
from hitlytics.sources.tables import RUN_KEYS, HitTables, new_part
from hitlytics.sources.versions import Versions
from hitlytics.streaming import counters, ingest

from helpers import EPOCH, at, hex_id, plan_of, rows
from test_tables import NOW, contents, frame, message


@pytest.fixture
def tables(spark):
    return HitTables(spark, shared_path(spark, "parts")).create()


class Lost(HitTables):
    """Loses a batch when it writes the named table, or when it publishes."""

    def __init__(self, spark, root, at_table):
        super().__init__(spark, root)
        self.at_table = at_table

    def write(self, df, name, *args):
        if name == self.at_table:
            raise InterruptedError(name)
        super().write(df, name, *args)

    def publish_batch(self, *args):
        if self.at_table == "publish":
            raise InterruptedError("publish")
        super().publish_batch(*args)


E5, F6 = message(1, ts=at(4 * 86400)), message(2, ts=at(5 * 86400))


@pytest.mark.parametrize("lost_at", ["endpoint_metrics", "publish"])
def test_a_rerun_replaces_what_a_failed_attempt_left(spark, tables, lost_at):
    """Batch 1 is lost, batch 2 brings one of its events, batch 1 is run again: each event counts once."""
    ingest_batch(tables, frame(spark, [message(0)]), 0, NOW)
    with pytest.raises(InterruptedError):
        ingest_batch(Lost(spark, tables.root, lost_at), frame(spark, [E5, F6]), 1, NOW)
    ingest_batch(tables, frame(spark, [E5]), 2, NOW)
    ingest_batch(tables, frame(spark, [E5, F6]), 1, NOW)
    assert rows(tables.raw(), "event_id") == [("e0",), ("e1",), ("e2",)]
    assert tables.rollup().agg(F.sum("total_hits")).first()[0] == 3
    before = contents(tables)
    assert tables.compact() == 2
    assert tables.clean(NOW + 10 ** 13, 0) > 0
    assert contents(tables) == before


def test_an_empty_rerun_leaves_nothing_of_the_batch(spark, tables):
    """An attempt with rows for every table is replaced by one with none."""
    full = [message(1), message(2, serviceName="s" * 300), ("{bad", "x", 0, None, None), message(3, error="Connection closed")]
    ingest_batch(tables, frame(spark, full), 0, NOW)
    for name in ("api_hits", "dead_letters", "retries", "rollup_rejects", "endpoint_metrics", "failure_segments"):
        assert tables._read(name).count() > 0, name
    ingest_batch(tables, frame(spark, []), 0, NOW)
    for name in ("api_hits", "dead_letters", "retries", "rollup_rejects", "endpoint_metrics", "failure_segments"):
        assert tables._read(name).count() == 0, name
    assert [r["processed"] for r in tables.batch_stats().collect()] == [0]


def test_a_merged_batch_is_final(spark, tables):
    for n in range(2):
        ingest_batch(tables, frame(spark, [message(n)]), n, NOW)
    assert tables.compact() == 1
    assert ingest_batch(tables, frame(spark, [message(9)]), 1, NOW) is None
    assert rows(tables.raw(), "event_id") == [("e0",), ("e1",)]


def test_a_batch_that_was_overtaken_is_compared_again(spark, tables):
    """Another writer adds a batch with the same event between comparing and publishing."""
    class Slow(HitTables):
        raced = False

        def publish_batch(self, batch_id, *args):
            if not Slow.raced:
                Slow.raced = True
                ingest_batch(tables, frame(spark, [message(1)]), 1, NOW)
            super().publish_batch(batch_id, *args)

    stats = ingest_batch(Slow(spark, tables.root), frame(spark, [message(1), message(2)]), 0, NOW)
    assert (stats["processed"], stats["duplicates"]) == (1, 1)
    assert rows(tables.raw(), "event_id") == [("e1",), ("e2",)]
    assert tables.rollup().agg(F.sum("total_hits")).first()[0] == 2


def test_one_of_many_publishers_takes_a_version(spark):
    versions = Versions(spark, shared_path(spark, "versions"), {"n": 0, "by": []})
    assert versions.latest() == (0, {"n": 0, "by": []})
    with ThreadPoolExecutor(8) as pool:
        taken = list(pool.map(lambda i: versions.folder.put_if_absent("000000000001.json", json.dumps({"n": 1, "by": [i]})), range(8)))
    assert sum(taken) == 1 and versions.latest() == (1, {"n": 1, "by": [taken.index(True)]})
    with ThreadPoolExecutor(8) as pool:  # losers read again: no change is lost
        list(pool.map(lambda i: versions.publish(lambda s: {"n": s["n"] + 1, "by": [*s["by"], i]}), range(8)))
    number, state = versions.latest()
    assert number == 9 and state["n"] == 9 and sorted(state["by"][1:]) == list(range(8))
    assert versions.publish(lambda s: None) is None and versions.latest()[0] == 9
    assert versions.forget(3) == 6 and versions.latest() == (9, state)


def test_two_compactions_and_an_expiry_at_once_lose_nothing(spark, tables):
    for n in range(3):
        ingest_batch(tables, frame(spark, [message(10 * n + i) for i in range(10)]), n, NOW)
    before = contents(tables)
    with ThreadPoolExecutor(3) as pool:
        jobs = [pool.submit(tables.compact), pool.submit(HitTables(spark, tables.root).compact), pool.submit(tables.expire, NOW, 30)]
        assert [j.result() for j in jobs] == [2, 2, 0]
    snapshot = tables.snapshot()
    assert [(p.first, p.last) for p in snapshot.parts] == [(0, 2)] and snapshot.expired_before is not None
    assert contents(tables) == before
    assert tables.clean(NOW + 10 ** 13, 0) > 0 and contents(tables) == before


def files(tables):
    return len([p for p in Path(tables.root).rglob("*.parquet")])


def test_compaction_merges_all_tables_into_few_parts(spark, tables):
    for n in range(6):
        items = [message(10 * n + i) for i in range(6)] + [("{bad", f"x{n}", 0, None, None), message(10 * n + 9, error="ETIMEDOUT")]
        ingest_batch(tables, frame(spark, items), n, NOW)
        if n in (0, 1, 3):
            assert tables.compact() == n
    stats = rows(tables.batch_stats(), "batch_id", "processed", "failed", "retried", "last_processed_at")
    before, held = contents(tables), files(tables)
    assert tables.compact() == 5
    assert [(p.first, p.last) for p in tables.snapshot().parts] in ([(0, 5)], [(0, 3), (4, 5)])
    assert contents(tables) == before
    assert rows(tables.batch_stats(), "batch_id", "processed", "failed", "retried", "last_processed_at") == stats and len(stats) == 6
    tables.clean(NOW + 10 ** 13, 0)
    assert files(tables) < held / 2 and contents(tables) == before


def test_parts_grow_with_the_logarithm_of_batches(spark, tables):
    """Merging by spans alone, without rows: how many parts are left after many compactions."""
    for n in range(40):
        tables.publish_batch(n, new_part(n), [], {"batch_id": n}, tables.snapshot())
        tables._write_merged = lambda parts, expired: type(parts[0])(new_part(0), parts[0].first, parts[-1].last, ())
        tables.compact()
    parts = tables.snapshot().parts
    assert len(parts) <= 6 and sum(p.span for p in parts) == 40


def test_expired_hits_are_refused_and_counted(spark, tables):
    ingest_batch(tables, frame(spark, [message(1), message(2)]), 0, NOW)
    assert tables.expire(NOW, 5) == 2
    stats = ingest_batch(tables, frame(spark, [message(1), message(60, ts=EPOCH + timedelta(days=9))]), 1, NOW)
    assert (stats["processed"], stats["expired"], stats["duplicates"]) == (1, 1, 0)
    tables.compact()
    assert rows(tables.raw(), "event_id") == [("e60",)]
    assert tables.rollup().agg(F.sum("total_hits")).first()[0] == 3


def test_look_ups_read_the_times_of_the_batch_only(spark, tables):
    """Day and time range reach the scan; row groups of other times are not read."""
    for hour in range(4):
        ingest_batch(tables, frame(spark, [message(100 * hour + i, ts=at(3600 * hour + i)) for i in range(50)]), hour, NOW)
    routed = envelope.route(frame(spark, [message(100 * 2 + 7, ts=at(3600 * 2 + 7)), message(999, ts=at(3600 * 2 + 30))]))
    counts, span = survey(routed, None)
    assert counts == {"STORE": 2} and span.days is not None and len(span.days) == 1
    fresh = dedupe.unseen(routed.where("outcome = 'STORE'"), tables.raw(), span=span)
    assert rows(fresh, "event_id") == [("e999",)]
    plan = plan_of(fresh)
    pushed = [line for line in plan.split("FileScan")[1:] if "event_id" in line]
    assert pushed and any("GreaterThanOrEqual(hit_ts" in p and "LessThanOrEqual(hit_ts" in p and "hit_date" in p.split("PartitionFilters")[1] for p in pushed)
    whole = dedupe.unseen(routed.where("outcome = 'STORE'"), tables.raw())
    assert rows(whole, "event_id") == [("e999",)]


def test_survey_of_many_days_falls_back_to_one_range(spark):
    items = [message(n, ts=at(86400 * n)) for n in range(dedupe.DAY_RANGES + 10)] + [("{bad", "x", 0, None, None)]
    counts, span = survey(envelope.route(frame(spark, items)), None)
    assert counts == {"STORE": dedupe.DAY_RANGES + 10, "DLQ": 1} and span.days is None and span.last - span.first == 86_400_000_000 * (dedupe.DAY_RANGES + 9)
    assert survey(envelope.route(frame(spark, [])), None) == ({}, None)


def test_merging_runs_is_associative(spark):
    """Any batches that follow each other may be merged first; the runs are those of the whole timeline."""
    import random

    rng = random.Random(3)
    hits = [(hex_id(k), "s", f"/{k}", at(t), f"e{k}-{t}", 500 if rng.random() < 0.75 else 200) for k in range(3) for t in range(120)]
    df = spark.createDataFrame(hits, "client_id string, service_name string, endpoint string, hit_ts timestamp, event_id string, status_code int")
    failed = F.col("status_code") >= 400
    parts = [
        spark.createDataFrame(runs.segments(
            df.where((F.unix_seconds("hit_ts") - int(EPOCH.timestamp())).between(20 * b, 20 * b + 19)), RUN_KEYS, ["hit_ts", "event_id"], failed)
            .withColumn("batch_id", F.lit(b).cast("long")).select(*RUN_SEGMENT.names).collect(), RUN_SEGMENT)
        for b in range(6)]
    order = ["batch_id", "chunk"]

    def joined(frames):
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return runs.merge(out, RUN_KEYS, order)

    expected = rows(runs.failure_runs(df, RUN_KEYS, ["hit_ts", "event_id"], failed, 1), *RUN_KEYS, "failures", "started_at", "ended_at")
    ways = [parts, [joined(parts[:3]), *parts[3:]], [parts[0], joined(parts[1:4]), joined(parts[4:])], [joined([joined(parts[:2]), parts[2]]), joined(parts[3:])]]
    for way in ways:
        assert rows(runs.stitch(joined(way), RUN_KEYS, order), *RUN_KEYS, "failures", "started_at", "ended_at") == expected
    assert joined(parts).where("NOT closed").groupBy(*RUN_KEYS).count().agg(F.max("count")).first()[0] <= 2


def test_batches_of_a_stream_stay_under_the_byte_bound(spark):
    folder = shared_path(spark, "bytes")
    for n in range(5):
        frame(spark, [message(20 * n + i) for i in range(20)]).coalesce(1).write.mode("append").json(f"{folder}/queue")
    sizes = [p.stat().st_size for p in Path(f"{folder}/queue").glob("*.json")]
    bound = max(sizes) * 2 + 10
    seen = []
    stream = queue.read_stream(spark, f"{folder}/queue", fmt="json", max_bytes=bound)
    query = stream.writeStream.foreachBatch(lambda df, n: seen.append(df.agg(F.sum(F.length("value"))).first()[0])).option(
        "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(seen) == 3 and max(seen) <= bound


def test_counters_of_a_running_stream_equal_the_stored_ones(spark):
    folder = shared_path(spark, "live")
    items = [message(n) for n in range(8)] + [message(3), ("{bad", "x", 0, None, None), message(20, error="ETIMEDOUT"), message(21, retry_count=3, error="ETIMEDOUT")]
    frame(spark, items).write.parquet(f"{folder}/queue")
    listener = counters.OutcomeListener()
    spark.streams.addListener(listener)
    try:
        tables = ingest.run(spark, f"{folder}/queue", f"{folder}/tables", f"{folder}/checkpoint", clock=lambda: NOW)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        live, last = listener.totals(), listener.last_batch()
    finally:
        spark.streams.removeListener(listener)
    stored = tables.batch_stats().first()
    assert live == {"messages": 12, "sound": 9, "failed": 3, "retried": 1, "dead_lettered": 2}
    assert last["batch_id"] == 0
    assert live["sound"] == stored["processed"] + stored["duplicates"]
    assert (live["failed"], live["retried"], live["dead_lettered"]) == (stored["failed"], stored["retried"], stored["dead_lettered"])


def test_delays_double_up_to_the_cap(spark):
    counts = spark.createDataFrame([(n,) for n in (None, 0, 1, 4, 5, 40, 2_000_000_000)], "retry_count int")
    now = F.timestamp_millis(F.lit(NOW).cast("long"))
    delays = counts.select(F.unix_millis(envelope.due_at(now, F.col("retry_count"))) - NOW).collect()
    assert [d[0] for d in delays] == [1000, 1000, 2000, 16000, 30000, 30000, 30000]


def test_a_broken_part_leaves_the_other_two(spark, tables):
    ingest_batch(tables, frame(spark, [message(n) for n in range(9)]), 0, NOW)
    whole = analytics.dashboard(tables.rollup(), NOW, bounds=analytics.TimeRange(1, NOW)).first()
    settled = analytics.settled_dashboard(tables.rollup(), NOW, bounds=analytics.TimeRange(1, NOW)).first()
    assert settled["errors"] is None and all(settled[c] == whole[c] for c in ("stats", "top_endpoints", "recent_activity"))

    def broken():
        raise ConnectionError("store is away")

    for name, column in analytics.PARTS.items():
        row = analytics.settled_dashboard(tables.rollup(), NOW, bounds=analytics.TimeRange(1, NOW), parts={name: broken}).first()
        assert row[column] is None and row["errors"] == {column: "ConnectionError: store is away"}
        assert all(row[c] == whole[c] for c in analytics.PARTS.values() if c != column)
    none = analytics.settled_dashboard(tables.rollup(), NOW, parts=dict.fromkeys(analytics.PARTS, broken)).first()
    assert len(none["errors"]) == 3 and none["stats"] is None
