"""Storage, batches and the stream: replay, crash, lateness, compaction, expiry."""

import json
from datetime import timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hitlytics.functions.times import epoch_ms
from hitlytics.operators import rollup
from hitlytics.plans import analytics
from hitlytics.plans.batch import ingest_batch
from hitlytics.schema import HIT, MESSAGE, ROLLUP
from hitlytics.session import shared_path
from hitlytics.sources import queue
from hitlytics.sources.tables import HitTables
from hitlytics.streaming import ingest
from hitlytics.streaming.ingest import wall_clock_ms

from helpers import EPOCH, at, hex_id, plan_of, rows

NOW = epoch_ms(EPOCH + timedelta(days=10))


def message(n, ts=None, retry_count=0, error=None, **changes):
    data = {"eventId": f"e{n}", "timestamp": (ts or at(n * 1000)).isoformat().replace("+00:00", "Z"), "serviceName": "s",
            "endpoint": f"/{n % 2}", "method": "GET", "statusCode": 500 if n % 3 else 200, "latencyMs": n + 0.5,
            "clientId": hex_id(1), "apiKeyId": hex_id(2), "ip": "1.1.1.1", "userAgent": "t", **changes}
    return json.dumps({"type": "API_HIT", "data": data}), f"e{n}", retry_count, error, None


def frame(spark, items):
    return spark.createDataFrame(items, MESSAGE)


def contents(tables):
    """What matters of all tables; write times and chunk numbers aside."""
    return (
        rows(tables.raw(), *HIT.names),
        rows(tables.endpoint_metrics(), *ROLLUP.names),
        rows(tables.dead_letters(), "value", "message_id", "dead_reason", "dead_error"),
        rows(tables.retries(), "value", "message_id", "retry_count"),
        rows(tables.failure_runs(1), "endpoint", "failures", "started_at", "ended_at"),
    )


@pytest.fixture
def tables(spark):
    return HitTables(spark, shared_path(spark, "tables")).create()


BATCHES = [
    [message(n) for n in range(0, 20)] + [message(3), ("{bad", "x", 0, None, None)],
    [message(n) for n in range(15, 40)] + [message(50, error="Connection closed"), message(51, serviceName="s" * 300)],
    [message(n) for n in range(38, 45)] + [message(60, ts=at(-86400 * 40))],
]


def ingest_all(spark, tables):
    for number, items in enumerate(BATCHES):
        ingest_batch(tables, frame(spark, items), number, NOW)


def test_batches_fill_all_tables(spark, tables):
    ingest_all(spark, tables)
    assert {e for e, in rows(tables.raw(), "event_id")} == {f"e{n}" for n in [*range(45), 51, 60]}
    stats = {r["batch_id"]: r for r in tables.batch_stats().collect()}
    assert [(stats[b]["processed"], stats[b]["duplicates"], stats[b]["failed"], stats[b]["retried"],
             stats[b]["dead_lettered"], stats[b]["rollup_rejected"]) for b in range(3)] == [
        (20, 1, 1, 0, 1, 0), (21, 5, 1, 1, 0, 1), (6, 2, 0, 0, 0, 0)]
    assert rows(tables.rollup_rejects(), "event_id", "reject_reason") == [("e51", "service_name is longer than 255")]
    expected = rollup.merge(rollup.fold(tables.raw().where("event_id <> 'e51'")))
    assert rows(tables.endpoint_metrics(), *ROLLUP.names) == rows(expected, *ROLLUP.names)
    late = tables.endpoint_metrics().where(F.col("time_bucket") < F.lit("2024-01-01").cast("timestamp"))
    assert late.agg(F.sum("total_hits")).first()[0] == 1


def test_replays_and_crashes_leave_the_tables_as_they_are(spark, tables, monkeypatch):
    ingest_all(spark, tables)
    whole = contents(tables)
    for number in (2, 0):
        ingest_batch(tables, frame(spark, BATCHES[number]), number, NOW)
    assert contents(tables) == whole

    crashed = HitTables(spark, shared_path(spark, "crashed")).create()
    write = HitTables.write

    def fail_on_rollup(self, df, name, *args):
        if name == "endpoint_metrics":
            raise RuntimeError("lost")
        write(self, df, name, *args)

    ingest_batch(crashed, frame(spark, BATCHES[0]), 0, NOW)
    monkeypatch.setattr(HitTables, "write", fail_on_rollup)
    with pytest.raises(RuntimeError):
        ingest_batch(crashed, frame(spark, BATCHES[1]), 1, NOW)
    monkeypatch.undo()
    assert crashed.last_batch() == 0 and crashed.raw().count() == 20  # the unfinished batch does not show
    for number in (1, 2):
        ingest_batch(crashed, frame(spark, BATCHES[number]), number, NOW)
    assert contents(crashed) == whole


def test_stream_equals_batch(spark, tables):
    ingest_all(spark, tables)
    folder = shared_path(spark, "stream")
    streamed = None
    for items in BATCHES:  # the queue grows; every run takes what is new
        frame(spark, items).coalesce(1).write.mode("append").json(f"{folder}/queue")
        streamed = ingest.run(
            spark, f"{folder}/queue", f"{folder}/tables", f"{folder}/checkpoint", fmt="json", max_files=1,
            clock=lambda: NOW)
    assert contents(streamed) == contents(tables)
    assert streamed.last_batch() == 2
    assert queue.read(spark, f"{folder}/queue", fmt="json").count() == sum(map(len, BATCHES))


def test_retried_messages_come_round_again(spark):
    folder = shared_path(spark, "retry")
    frame(spark, [message(1), message(2, error="Connection closed"), message(3, retry_count=3, error="ETIMEDOUT")]
          ).write.parquet(f"{folder}/queue")

    def run(now):
        return ingest.run(spark, f"{folder}/queue", f"{folder}/tables", f"{folder}/checkpoint", with_retries=True,
                          clock=lambda: now)

    tables = run(NOW)
    assert rows(tables.raw(), "event_id") == [("e1",)]
    assert rows(tables.retries(), "message_id", "retry_count") == [("e2", 1)]
    assert rows(tables.retries().select((F.unix_millis("due_at") - NOW).alias("delay"))) == [(1000,)]
    assert rows(run(NOW + 999).raw(), "event_id") == [("e1",)]  # not due yet
    assert rows(run(NOW + 1000).raw(), "event_id") == [("e1",), ("e2",)]
    tables = run(NOW + 5000)  # released once
    assert rows(tables.raw(), "event_id") == [("e1",), ("e2",)] and tables.last_batch() == 1
    assert tables.release_due(NOW + 5000) == 0
    assert rows(tables.dead_letters(), "message_id", "dead_reason") == [("e3", "MAX_RETRIES_EXCEEDED")]


def test_compaction_keeps_the_sums(spark, tables):
    ingest_batch(tables, frame(spark, BATCHES[0]), 0, NOW)
    assert tables.compact() == 0
    ingest_batch(tables, frame(spark, BATCHES[1]), 1, NOW)
    before = rows(tables.endpoint_metrics(), *ROLLUP.names)
    unmerged = tables.rollup().count()
    assert unmerged > len(before)
    assert tables.compact() == 1
    assert rows(tables.endpoint_metrics(), *ROLLUP.names) == before
    assert tables.rollup().count() == len(before) < unmerged
    assert tables.compact() == 1  # nothing new
    stored = lambda: len(list(Path(tables.path("endpoint_metrics")).rglob("*.parquet")))
    files, later = stored(), wall_clock_ms() + 86_400_000 + 1000
    assert tables.clean(later - 86_400_000) == 0  # readers may still be on them
    assert tables.clean(later) > 0 and stored() < files and tables.clean(later) == 0
    assert rows(tables.endpoint_metrics(), *ROLLUP.names) == before
    ingest_batch(tables, frame(spark, BATCHES[2]), 2, NOW)
    tables.compact()
    fitting = tables.raw().where("event_id <> 'e51'")
    total = fitting.count()
    assert rows(tables.endpoint_metrics(), *ROLLUP.names) == rows(rollup.merge(rollup.fold(fitting)), *ROLLUP.names)
    ingest_batch(tables, frame(spark, BATCHES[0]), 0, NOW)  # a replay of a merged batch does not count twice
    assert tables.endpoint_metrics().agg(F.sum("total_hits")).first()[0] == total


def test_expiry_drops_raw_hits_but_not_the_rollup(spark, tables):
    ingest_all(spark, tables)
    metrics = rows(tables.endpoint_metrics(), *ROLLUP.names)
    cutoff = EPOCH + timedelta(hours=12)
    now = epoch_ms(cutoff + timedelta(days=30))
    old = tables.raw().where(F.col("hit_ts") < F.lit(cutoff)).count()
    total = tables.raw().count()
    assert 1 < old < total
    assert tables.expire(now) == old
    assert tables.raw().count() == total - old
    assert tables.raw().agg(F.min("hit_ts")).first()[0].astimezone(timezone.utc) >= cutoff
    assert tables.expire(now) == 0
    assert rows(tables.endpoint_metrics(), *ROLLUP.names) == metrics
    days = {r["hit_date"].isoformat() for r in tables._read("api_hits").select("hit_date").distinct().collect()}
    assert min(days) == "2024-01-01"  # the whole day before is gone from storage


def test_a_batch_that_failed_counts_when_it_is_run_again(spark, tables, monkeypatch):
    ingest_batch(tables, frame(spark, BATCHES[0]), 0, NOW)
    write = HitTables.write

    def fail_on_rollup(self, df, name, *args):
        if name == "endpoint_metrics":
            raise RuntimeError("lost")
        write(self, df, name, *args)

    monkeypatch.setattr(HitTables, "write", fail_on_rollup)
    with pytest.raises(RuntimeError):
        ingest_batch(tables, frame(spark, BATCHES[1]), 1, NOW)
    monkeypatch.undo()
    ingest_batch(tables, frame(spark, BATCHES[2]), 2, NOW)
    assert tables.compact() == 0  # not past the gap
    shown = rows(tables.raw(), "event_id")
    assert len(shown) == 28 and len(set(shown)) == 28  # the unfinished batch does not show
    ingest_batch(tables, frame(spark, BATCHES[1]), 1, NOW)
    assert tables.compact() == 2
    hits = tables.raw().where("event_id <> 'e51'")
    assert rows(tables.endpoint_metrics(), *ROLLUP.names) == rows(rollup.merge(rollup.fold(hits)), *ROLLUP.names)
    assert {e for e, in rows(tables.raw(), "event_id")} == {f"e{n}" for n in [*range(45), 51, 60]}


def test_expiry_compares_dates_and_never_goes_back(spark, tables):
    far = [message(70, timestamp=1_704_067_200_000_000), message(71, timestamp="-62200000000000"), message(72, timestamp=-62_200_000_000_000), message(73)]
    ingest_batch(tables, frame(spark, far), 0, NOW)
    ingest_batch(tables, frame(spark, far), 1, NOW)
    assert rows(tables.raw(), "event_id") == [("e70",), ("e72",), ("e73",)]  # once each; a text of digits is no time
    assert tables.expire(NOW, 5) == 2
    assert rows(tables.raw(), "event_id") == [("e70",)]
    assert tables.expire(NOW, 30) == 0 and rows(tables.raw(), "event_id") == [("e70",)]
    assert tables._read("api_hits").where("event_id = 'e70'").count() == 1  # still stored


def test_reports_prune_days(spark, tables):
    ingest_batch(tables, frame(spark, BATCHES[0]), 0, NOW)
    plan = plan_of(analytics.overall_stats(tables.rollup(), NOW))
    filters = [part.split("]", 1)[0] for part in plan.split("PartitionFilters: [")[1:]]
    assert any("bucket_date" in f for f in filters)
