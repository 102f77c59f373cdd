"""The tables of one deployment under one root folder.

All are parquet. What a batch writes lies in folders of its own, `part=<name>`, named anew for every attempt. The published
state lists the parts that count: those of finished batches, and those in which compaction has merged batches that follow
each other. So an attempt replaces its batch as a whole at the moment its part is published, whatever an earlier attempt
has left behind, and readers see one consistent set of parts in all tables. Batch numbers start at 0 and leave none out.
The roll-up is the sum of the partial rows of all parts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions.times import DAY_MS, at
from ..operators import envelope, raw_hits, rollup, runs
from .versions import Folder, Versions

#: name: (columns, columns of the folders below a part, columns by which files are cut and sorted)
TABLES = {
    "outcomes": (schema.OUTCOME, ["outcome", "hit_date"], ["hit_ts"]),
    "endpoint_metrics": (schema.STORED_ROLLUP, ["bucket_date"], ["client_id", "service_name", "endpoint"]),
    "failure_segments": (schema.RUN_SEGMENT, [], ["client_id", "service_name", "endpoint"]),
    "batch_stats": (schema.BATCH_STATS, [], ["batch_id"]),
}
#: Tables in which a row of several others is shown: the table that holds it and the outcome it has there.
VIEWS = {
    "api_hits": (schema.STORED_HIT, envelope.STORE),
    "dead_letters": (schema.DEAD_LETTER, envelope.DEAD),
    "retries": (schema.RETRY, envelope.RETRY),
    "rollup_rejects": (schema.ROLLUP_REJECT, envelope.STORE),
}
RUN_KEYS = ["client_id", "service_name", "endpoint"]
_INITIAL = {"parts": [], "compacted_through": -1, "expired_before": None, "released": None}


class Overtaken(Exception):
    """Another writer has published batches that this one has not seen."""


@dataclass(frozen=True)
class Part:
    """Batches `first` to `last` of which `name` holds the rows, in the given tables; the counters of a single batch are
    listed with it until it is merged."""

    name: str
    first: int
    last: int
    tables: tuple[str, ...]
    stats: dict | None = None

    @property
    def span(self) -> int:
        return self.last - self.first + 1


@dataclass(frozen=True)
class Snapshot:
    """One published state; `expired_before` in epoch milliseconds."""

    parts: tuple[Part, ...]
    compacted_through: int
    expired_before: int | None

    @staticmethod
    def of(state: dict) -> "Snapshot":
        parts = (Part(p["name"], p["first"], p["last"], tuple(p["tables"]), p["stats"]) for p in state["parts"])
        return Snapshot(tuple(sorted(parts, key=lambda p: p.first)), state["compacted_through"], state["expired_before"])

    def without(self, batch_id: int) -> "Snapshot":
        return Snapshot(tuple(p for p in self.parts if (p.first, p.last) != (batch_id, batch_id)), self.compacted_through, self.expired_before)

    def leading(self) -> tuple[Part, ...]:
        """The parts from batch 0 up to the first number that is missing."""
        end = 0
        while end < len(self.parts) and self.parts[end].first == (self.parts[end - 1].last + 1 if end else 0):
            end += 1
        return self.parts[:end]


def _listed(part: Part) -> dict:
    return {"name": part.name, "first": part.first, "last": part.last, "tables": list(part.tables), "stats": part.stats}


class HitTables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.versions = Versions(spark, self.path("state"), _INITIAL)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create(self) -> "HitTables":
        """The folder that a stream may watch; tables and state come with the first batch."""
        folder = Folder(self.spark, self.path("released"))
        folder.files.mkdirs(folder.path)
        return self

    def snapshot(self) -> Snapshot:
        return Snapshot.of(self.versions.latest()[1])

    # -- parts -----------------------------------------------------------------------------------------------

    def _read(self, name: str, parts: Sequence[Part] | None = None) -> DataFrame:
        """Rows of the given parts, of all that count by default."""
        if name in VIEWS:
            fields, outcome = VIEWS[name]
            rows = self._read("outcomes", parts).where(F.col("outcome") == outcome)
            if name == "rollup_rejects":
                rows = rows.where(F.col("reject_reason").isNotNull())
            return rows.select(*fields.names)
        fields, folders, _ = TABLES[name]
        parts = self.snapshot().parts if parts is None else parts
        held = [f"{self.path(name)}/part={p.name}" for p in parts if name in p.tables]
        if not held:
            return self.spark.createDataFrame([], fields)
        stored = T.StructType([f for f in fields if f.name not in folders] + [f for f in fields if f.name in folders])
        rows = self.spark.read.schema(stored).option("basePath", self.path(name)).parquet(*held)
        return rows.select(*fields.names)

    def part_of(self, part: str, name: str) -> DataFrame:
        """Rows of one part, published or not."""
        return self._read(name, [Part(part, 0, 0, tuple(TABLES))])

    def write(self, df: DataFrame, name: str, part: str, observed: tuple[Observation, list[Column]] | None = None) -> None:
        """Rows of a part that is not published yet, in files of about equal size whatever share one folder holds."""
        fields, folders, order = TABLES[name]
        rows = df.select(*fields.names).hint("rebalance", *folders)
        if observed is not None:
            rows = rows.observe(observed[0], *observed[1])
        # The order starts with all folder columns, so that the writer keeps it.
        self._put(rows.sortWithinPartitions(*folders, *order), name, part)

    def _put(self, rows: DataFrame, name: str, part: str) -> None:
        rows.write.mode("overwrite").partitionBy(*TABLES[name][1]).parquet(f"{self.path(name)}/part={part}")

    def publish_batch(self, batch_id: int, part: str, tables: Sequence[str], stats: dict, seen: Snapshot) -> None:
        """Makes `part` the rows of a batch in place of whatever counted for it, and `stats` its counters.

        Raises `Overtaken` if batches have been added that are not in `seen`, which the part was compared with. A batch that
        has been merged is final: nothing changes.
        """
        known = {b for p in seen.parts for b in range(p.first, p.last + 1)}

        def change(state: dict) -> dict | None:
            now = Snapshot.of(state)
            if batch_id <= now.compacted_through:
                return None
            others = now.without(batch_id).parts
            if any(b not in known for p in others for b in range(p.first, p.last + 1)):
                raise Overtaken(f"batch {batch_id}")
            return state | {"parts": [_listed(p) for p in (*others, Part(part, batch_id, batch_id, tuple(tables), stats))]}

        self.versions.publish(change)

    def last_batch(self) -> int:
        """The last batch up to which none is missing; -1 before the first."""
        return max((p.last for p in self.snapshot().leading()), default=-1)

    # -- readers ---------------------------------------------------------------------------------------------

    def raw(self, snapshot: Snapshot | None = None) -> DataFrame:
        """Stored hits inside the retention time."""
        snapshot = snapshot or self.snapshot()
        hits, expired_before = self._read("api_hits", snapshot.parts), snapshot.expired_before
        if expired_before is None:
            return hits
        return raw_hits.kept(hits, expired_before).where(F.col("hit_date") >= F.to_date(at(expired_before)))

    def rollup(self) -> DataFrame:
        """Roll-up rows, not merged across parts; reports add them up."""
        return self._read("endpoint_metrics")

    def endpoint_metrics(self) -> DataFrame:
        """The roll-up with one row per key and bucket."""
        return rollup.merge(self.rollup(), F.max("updated_at").alias("updated_at"))

    def rollup_rejects(self) -> DataFrame:
        return self._read("rollup_rejects")

    def dead_letters(self) -> DataFrame:
        return self._read("dead_letters")

    def retries(self) -> DataFrame:
        return self._read("retries")

    def batch_stats(self) -> DataFrame:
        return self._stats(self.snapshot().parts)

    def _stats(self, parts: Sequence[Part]) -> DataFrame:
        """Counters per batch: those that are listed with their parts, a row per batch since the last merge, and the rest."""
        rows = [[self._cell(f, p.stats.get(f.name)) for f in schema.BATCH_STATS] for p in parts if p.stats]
        listed = self.spark.createDataFrame(rows, schema.BATCH_STATS)
        return listed.unionByName(self._read("batch_stats", parts)) if any("batch_stats" in p.tables for p in parts) else listed

    @staticmethod
    def _cell(field: T.StructField, value: int | None) -> object:
        is_time = field.dataType == T.TimestampType()
        return datetime.fromtimestamp(value / 1000, timezone.utc) if is_time and value is not None else value

    def failure_runs(self, threshold: int = schema.POISON_THRESHOLD) -> DataFrame:
        """Failure runs across all batches, in order of arrival."""
        whole = runs.stitch(self._read("failure_segments"), RUN_KEYS, ["batch_id", "chunk"])
        return whole.withColumn("poison", F.col("failures") >= threshold)

    # -- retries ---------------------------------------------------------------------------------------------

    def release_due(self, now_ms: int) -> int:
        """Puts the retries that have become due into the `released` folder, which a stream reads; returns how many.

        Each is released once: the state notes up to which batch and which time that has been done, and a clock that goes
        back releases what the latest one did. If this call is lost before it is noted, the same messages are released
        again, as any queue delivers at least once. Batches after a missing one wait for it.
        """
        state = self.versions.latest()[1]
        snapshot, done = Snapshot.of(state), state["released"]
        through = max((p.last for p in snapshot.leading()), default=-1)
        before = max(now_ms, done["before"]) if done else now_ms
        due = self._read("outcomes", snapshot.parts).where(
            (F.col("outcome") == envelope.RETRY) & (F.col("batch_id") <= through) & (F.col("due_at") <= at(before)))
        if done:
            due = due.where((F.col("batch_id") > done["through"]) | (F.col("due_at") > at(done["before"])))
        messages = due.select(*schema.MESSAGE.names)
        if messages.isEmpty():
            return 0
        counted = Observation()
        messages.observe(counted, F.count("*").alias("messages")).write.mode("append").parquet(self.path("released"))
        self.versions.publish(lambda now: now | {"released": {"through": through, "before": before}})
        return counted.get["messages"]

    # -- upkeep ----------------------------------------------------------------------------------------------

    def _merged(self, name: str, parts: Sequence[Part], expired_before: int | None) -> DataFrame:
        if name == "batch_stats":
            return self._stats(parts)
        rows = self._read(name, parts)
        if name == "endpoint_metrics":
            merged = rollup.merge(rows, F.max("updated_at").alias("updated_at"))
            return merged.withColumn("bucket_date", F.to_date("time_bucket"))
        if name == "failure_segments":
            return runs.merge(rows, RUN_KEYS, ["batch_id", "chunk"])
        if name == "outcomes" and expired_before is not None:
            return rows.where((F.col("outcome") != envelope.STORE) | (F.col("hit_ts") >= at(expired_before)))
        return rows

    def compact(self) -> int:
        """Merges finished batches, in all tables, into parts of many batches. Returns the last batch that is final.

        Stops at the first batch that is missing, so that one that failed and is run again still counts. New batches become
        one part, together with merged parts before them that are not longer: the number of parts grows with the logarithm of
        the batches, and a row is rewritten as often. Nothing is rewritten in place: readers switch when the state is
        published. Of two compactions at once, one is published; the other's part is left to `clean`.
        """
        snapshot = self.snapshot()
        leading = list(snapshot.leading())
        if not leading or leading[-1].last <= snapshot.compacted_through:
            return snapshot.compacted_through
        last = leading[-1].last
        chosen = [p for p in leading if p.last > snapshot.compacted_through]
        rest = leading[:len(leading) - len(chosen)]
        while rest and rest[-1].span <= sum(p.span for p in chosen):
            chosen.insert(0, rest.pop())
        merged = chosen[0] if len(chosen) == 1 else self._write_merged(chosen, snapshot.expired_before)
        names = {p.name for p in chosen}

        def change(state: dict) -> dict | None:
            now = Snapshot.of(state).parts
            if not names <= {p.name for p in now}:
                return None  # merged or run again in the meantime
            parts = [*(p for p in now if p.name not in names), merged]
            return state | {"parts": [_listed(p) for p in parts], "compacted_through": max(last, state["compacted_through"])}

        self.versions.publish(change)
        return self.snapshot().compacted_through

    def _write_merged(self, parts: Sequence[Part], expired_before: int | None) -> Part:
        name, held = f"m{parts[-1].last}-{uuid4().hex[:12]}", []
        for table, (_, folders, order) in TABLES.items():
            if table == "batch_stats" or any(table in p.tables for p in parts):
                rows = self._merged(table, parts, expired_before).select(*TABLES[table][0].names)
                if table == "outcomes":
                    # Files hold neighbouring times, so that readers of a time range open few; a day of any size is cut.
                    self._put(rows.repartitionByRange(*folders, *order).sortWithinPartitions(*folders, *order), table, name)
                else:
                    self.write(rows, table, name)
                held.append(table)
        return Part(name, parts[0].first, parts[-1].last, tuple(held))

    def expire(self, now_ms: int, days: int = schema.RETENTION_DAYS) -> int:
        """Removes hits older than `days`; returns how many. The roll-up is kept for ever.

        Readers stop seeing them at once; whole days are also deleted from storage, the rest by the next merge. What has
        expired stays so: a call with an earlier cutoff removes nothing and brings nothing back, and batches refuse hits from
        before the cutoff, since a copy of one could no longer be told from a new one.
        """
        wanted = raw_hits.cutoff_ms(now_ms, days)
        snapshot = self.snapshot()
        cutoff = wanted if snapshot.expired_before is None else max(wanted, snapshot.expired_before)
        removed = raw_hits.expired_count(self.raw(snapshot), cutoff).first()["hits"]
        self.versions.publish(lambda state: state | {
            "expired_before": cutoff if state["expired_before"] is None else max(cutoff, state["expired_before"])})
        day = datetime.fromtimestamp(cutoff / 1000, timezone.utc)
        self._delete_days_before((day.year, day.month, day.day))
        return removed

    def _delete_days_before(self, day: tuple[int, int, int]) -> None:
        """Deletes the folders of earlier days; years may have a sign and any number of digits."""
        folder = Folder(self.spark, self.path("outcomes"))
        for part in folder.entries():
            for entry in folder.entries(f"{part.getPath().getName()}/outcome={envelope.STORE}"):
                found = re.fullmatch(r"hit_date=([+-]?[0-9]+)-([0-9]+)-([0-9]+)", entry.getPath().getName())
                if found and tuple(map(int, found.groups())) < day:
                    folder.files.delete(entry.getPath(), True)

    def clean(self, now_ms: int, grace_ms: int = DAY_MS) -> int:
        """Deletes the parts that do not count: what compaction or a later attempt has replaced, and what failed attempts left.

        Folders changed within the last `grace_ms` stay, for writers that have not published yet and readers that began
        before the newest state. Returns the number of folders deleted; readers of the newest state see no difference.
        """
        live, deleted = {f"part={p.name}" for p in self.snapshot().parts}, 0
        for name in TABLES:
            folder = Folder(self.spark, self.path(name))
            for entry in folder.entries():
                if entry.getPath().getName() not in live and entry.getModificationTime() <= now_ms - grace_ms:
                    deleted += folder.files.delete(entry.getPath(), True)
        self.versions.forget()
        return deleted


def new_part(batch_id: int) -> str:
    return f"b{batch_id}-{uuid4().hex[:12]}"


def update(tables: HitTables, work: Callable[[Snapshot], None], tries: int = 10) -> None:
    """Does `work` against the newest state, anew when other writers have added batches meanwhile."""
    for left in reversed(range(tries)):
        try:
            return work(tables.snapshot())
        except Overtaken:
            if not left:
                raise
