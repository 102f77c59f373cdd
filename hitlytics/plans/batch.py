"""One batch of queue messages into the tables."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.times import at
from ..functions.values import is_error
from ..operators import dedupe, envelope, rollup, runs
from ..schema import DEFAULT_QUEUE, HIT, MAX_RETRIES, OUTCOME
from ..sources.tables import RUN_KEYS, HitTables, Snapshot, new_part, update

EXPIRED = "EXPIRED"


def outcome_counts(
    routed: DataFrame, stored: DataFrame, rejected: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Counters: processed, duplicates, failed, retried, dead-lettered, rejected by the roll-up."""
    def marked(df: DataFrame, outcome: Column, ts: Column) -> DataFrame:
        return df.select(*by, outcome.alias("outcome"), ts.alias("hit_ts"))

    no_time = F.lit(None).cast("timestamp")
    seen = marked(routed, F.col("outcome"), no_time).unionByName(
        marked(stored, F.lit("STORED"), F.col("hit_ts")))
    if rejected is not None:
        seen = seen.unionByName(marked(rejected, F.lit("REJECTED"), no_time))

    def of(outcome: str) -> Column:
        return F.count_if(F.col("outcome") == outcome)

    return seen.groupBy(*by).agg(
        of("STORED").alias("processed"),
        (of(envelope.STORE) - of("STORED")).alias("duplicates"),
        (of(envelope.RETRY) + of(envelope.DEAD)).alias("failed"),
        of(envelope.RETRY).alias("retried"),
        of(envelope.DEAD).alias("dead_lettered"),
        of("REJECTED").alias("rollup_rejected"),
        F.max("hit_ts").alias("last_hit"))


def ingest_batch(
    tables: HitTables,
    messages: DataFrame,
    batch_id: int,
    now_ms: int,
    queue: str = DEFAULT_QUEUE,
    max_retries: int = MAX_RETRIES,
) -> dict | None:
    """Routes the messages once and fills every table. Running a batch again replaces all of its rows.

    Returns the batch's counters; None for a batch that has been merged, which is final.
    """
    return ingest_routed(tables, envelope.route(messages, max_retries), batch_id, now_ms, queue)


def ingest_routed(tables: HitTables, routed: DataFrame, batch_id: int, now_ms: int, queue: str = DEFAULT_QUEUE) -> dict | None:
    """`ingest_batch` for messages that `envelope.route` has judged.

    All rows of an attempt lie in a part of its own, which counts as a whole from the moment it is published. If other
    writers have added batches since the hits were compared with the stored ones, the attempt is made anew.
    """
    routed = routed.persist(StorageLevel.MEMORY_AND_DISK)
    counters: dict = {}

    def attempt(seen: Snapshot) -> None:
        counters.clear()
        if batch_id > seen.compacted_through:
            counters.update(_write_batch(tables, routed, batch_id, now_ms, queue, seen))

    try:
        update(tables, attempt)
    finally:
        routed.unpersist()
    return counters or None


def survey(routed: DataFrame, expired_before: int | None) -> tuple[dict[str, int], dedupe.Span | None]:
    """(messages by outcome, sound but expired ones by `EXPIRED`; where the sound hits lie), in one pass as a rule."""
    late = F.lit(False) if expired_before is None else F.col("hit_ts") < at(expired_before)
    sound = F.col("outcome") == envelope.STORE
    judged = routed.select(F.when(sound & late, EXPIRED).otherwise(F.col("outcome")).alias("outcome"), F.when(sound & ~late, F.col("hit_ts")).alias("ts"))
    measures = [F.count("*").alias("messages"), F.unix_micros(F.min("ts")).alias("first"), F.unix_micros(F.max("ts")).alias("last")]
    # A row per day, as long as they are few.
    days = judged.groupBy("outcome", F.unix_date(F.to_date("ts")).alias("day")).agg(*measures).limit(dedupe.DAY_RANGES + 4).collect()
    few = len(days) < dedupe.DAY_RANGES + 4
    rows = days if few else judged.groupBy("outcome").agg(*measures).collect()
    counts: dict[str, int] = {}
    for r in rows:
        counts[r["outcome"]] = counts.get(r["outcome"], 0) + r["messages"]
    stored = [r for r in rows if r["outcome"] == envelope.STORE]
    if not stored:
        return counts, None
    by_day = tuple(sorted((r["day"], r["first"], r["last"]) for r in stored)) if few else None
    return counts, dedupe.Span(by_day, min(r["first"] for r in stored), max(r["last"] for r in stored))


def _write_batch(tables: HitTables, routed: DataFrame, batch_id: int, now_ms: int, queue: str, seen: Snapshot) -> dict:
    now, part, written = at(now_ms), new_part(batch_id), []
    counts, span = survey(routed, seen.expired_before)
    sound = routed.where(F.col("outcome") == envelope.STORE)
    if seen.expired_before is not None:
        sound = sound.where(F.col("hit_ts") >= at(seen.expired_before))

    def outcome(rows: DataFrame, name: str) -> DataFrame:
        made = {"outcome": F.lit(name), "batch_id": F.lit(batch_id).cast("long")}
        return rows.select(*[
            made.get(f.name, F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in OUTCOME])

    routes = []
    if span is not None:
        stored = tables.raw(seen.without(batch_id))
        fresh = dedupe.unseen(dedupe.first_copies(sound), stored, days_of=sound, span=span)
        routes.append(outcome(fresh.select(
            *HIT.names, now.alias("stored_at"), F.to_date("hit_ts").alias("hit_date"), rollup.reject_reason().alias("reject_reason")), envelope.STORE))
    if envelope.DEAD in counts:
        routes.append(outcome(envelope.dead_letters(routed, queue, now), envelope.DEAD))
    if envelope.RETRY in counts:
        routes.append(outcome(envelope.retries(routed, queue, now), envelope.RETRY))

    totals = {"stored": 0, "rejected": 0}
    if routes:
        # All routes are written by one job, which counts them on the way: its last stage counts each row once.
        observed = Observation()
        tables.write(reduce(DataFrame.unionByName, routes), "outcomes", part, (observed, _observed()))
        totals, _ = observed.get, written.append("outcomes")
    if totals["stored"]:
        stored = tables.part_of(part, "api_hits")
        partials = rollup.fold(stored).withColumns({"updated_at": now, "bucket_date": F.to_date("time_bucket")})
        segments = runs.segments(stored, RUN_KEYS, ["hit_ts", "event_id"], is_error(F.col("status_code"))).withColumn(
            "batch_id", F.lit(batch_id).cast("long"))
        folds = {"endpoint_metrics": partials, "failure_segments": segments}
        with ThreadPoolExecutor(len(folds)) as pool:  # two jobs that share the executors
            for done in [pool.submit(tables.write, df, name, part) for name, df in folds.items()]:
                done.result()
        written += folds

    retried, dead = counts.get(envelope.RETRY, 0), counts.get(envelope.DEAD, 0)
    stats = {
        "batch_id": batch_id, "processed": totals["stored"], "duplicates": counts.get(envelope.STORE, 0) - totals["stored"],
        "failed": retried + dead, "retried": retried, "dead_lettered": dead, "rollup_rejected": totals["rejected"],
        "expired": counts.get(EXPIRED, 0), "last_processed_at": now_ms if totals["stored"] else None}
    tables.publish_batch(batch_id, part, written, stats, seen)
    return stats


def _observed() -> list[Column]:
    stored = F.col("outcome") == envelope.STORE
    return [F.count_if(stored).alias("stored"), F.count_if(stored & F.col("reject_reason").isNotNull()).alias("rejected")]
