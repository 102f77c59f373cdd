"""Whole-number vectors, dealt to shards that are searched with every query.

Rows are dealt by number, so shards are of about equal size whatever ids, labels or copies there are. A task holds one
shard's rows and one Arrow batch of queries at a time; each shard gives its own best rows, which are few, and Spark ranks
them. A query is a row of the table too: `without_own` leaves it out of its own result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitlytics import session

SCALE = 256
#: Most rows of a shard.
SHARD_ROWS = 1 << 16
_EXACT = 2.0 ** 53
_COLUMNS = ["shard", "asks", "key", "id", "label", "vec", "tops"]
FOUND = "key long, top int, id long, score long, own boolean"


def whole(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector has only finite components; `vec` holds each as floor(256 * x), within the range of a long."""
    def finite(x: Column) -> Column:
        return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))

    vector = F.col(column)
    return df.filter(vector.isNotNull() & F.forall(vector, finite)).withColumn(
        "vec", F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)))


def shard_count(rows: int) -> int:
    """Grows with the root of the table, so that copies of the queries do too, until shards are full."""
    return max(1, math.ceil(max(math.sqrt(rows) / 8, rows / SHARD_ROWS)))


def matrix(column: pa.Array) -> np.ndarray:
    """A row per vector, shorter ones filled with zeros; whole numbers as doubles while their products are exact."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat, width = column.flatten().to_numpy(zero_copy_only=False), int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _bound(x: np.ndarray) -> float:
    return float(np.abs(x.astype(np.float64)).max(initial=0))


def exact(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if every inner product, and five times it, is exact in doubles; else as Python's whole numbers."""
    kind = np.float64 if 5 * _bound(left) * _bound(right) * max(1, left.shape[1]) < _EXACT else object
    return left.astype(kind), right.astype(kind)


class Shard:
    """Rows of a shard in the order that breaks ties: by id, those without one last."""

    def __init__(self, table: pa.Table):
        ids = table["id"].combine_chunks()
        empty = ids.is_null().to_numpy(zero_copy_only=False)
        order = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), empty))
        table = table.take(pa.array(order))
        self.ids = table["id"].combine_chunks()
        self.labels = table["label"].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
        self.vectors = matrix(table["vec"].combine_chunks())
        self.number = self.ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.named = self.ids.is_valid().to_numpy(zero_copy_only=False)


class Queries:
    def __init__(self, batch: pa.RecordBatch, width: int):
        column = dict(zip(_COLUMNS, batch.columns))
        self.keys = column["key"].to_numpy(zero_copy_only=False)
        self.ids = column["id"].to_numpy(zero_copy_only=False)
        self.labels = column["label"].fill_null(0).to_numpy(zero_copy_only=False)
        self.tops = column["tops"].to_pylist()
        full = matrix(column["vec"])
        self.vectors = np.zeros((len(full), width), np.int64)
        shared = min(width, full.shape[1])
        self.vectors[:, :shared] = full[:, :shared]
        self.beyond = np.abs(full[:, shared:]).any(1)  # components that no row of the shard has

    def __len__(self) -> int:
        return len(self.keys)


class Found:
    """Collects what a batch of queries finds in a shard."""

    def __init__(self, shard: Shard, queries: Queries):
        self.shard, self.queries, self.parts = shard, queries, []

    def add(self, query: int, positions: np.ndarray, scores: np.ndarray, top: int = 0) -> None:
        self.parts.append((query, top, positions, scores))

    def batch(self) -> pa.RecordBatch:
        counts = [len(p[2]) for p in self.parts]
        query = np.repeat([p[0] for p in self.parts], counts).astype(np.int64)
        top = np.repeat([p[1] for p in self.parts], counts).astype(np.int32)
        at = np.concatenate([np.zeros(0, np.int64), *[p[2] for p in self.parts]])
        limits = np.iinfo(np.int64)
        scores = [min(max(int(s), limits.min), limits.max) for p in self.parts for s in p[3]]
        q = self.queries
        own = self.shard.named[at] & (self.shard.number[at] == q.ids[query]) & (self.shard.vectors[at] == q.vectors[query]).all(1) & ~q.beyond[query]
        return pa.RecordBatch.from_arrays(
            [pa.array(q.keys[query]), pa.array(top), self.shard.ids.take(pa.array(at)), pa.array(scores, pa.int64()), pa.array(own)],
            ["key", "top", "id", "score", "own"])


def _streamed(index: Callable, ask: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            shards, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            edges = np.flatnonzero((shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])) + 1
            for low, high in zip([0, *edges], [*edges, batch.num_rows]):
                part = batch.slice(low, high - low)
                if shards[low] != number:
                    number, rows, ready = shards[low], [], None
                if not asks[low]:
                    rows.append(part)
                elif rows or ready:
                    ready, rows = ready or index(Shard(pa.Table.from_batches(rows))), []
                    yield ask(ready, part)
    return run


def search(rows: DataFrame, queries: DataFrame, shards: int, index: Callable, ask: Callable) -> DataFrame:
    """What `ask(index(shard), queries)` finds in every shard: (key, top, id, score, own).

    `rows` has id, label, vec; `queries` has key, id, label, vec, tops.
    """
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    held = rows.select(
        number.alias("shard"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("key"), F.col("id").cast("long").alias("id"),
        F.col("label").cast("long").alias("label"), "vec", F.lit(None).cast("array<long>").alias("tops"))
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), "key", F.col("id").cast("long").alias("id"),
        F.col("label").cast("long").alias("label"), "vec", "tops")
    dealt = held.unionByName(asked).repartition(2 * shards, "shard").sortWithinPartitions("shard", "asks")
    return dealt.mapInArrow(_streamed(index, ask), FOUND)


def best_first(*extra: Column) -> list[Column]:
    return [F.col("score").desc(), F.col("id").asc_nulls_last(), *extra]


def ranked(found: DataFrame, keys: list[str], k: int, *extra: Column) -> DataFrame:
    """The k best of each query over all shards, by `rank` from 1."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*best_first(*extra)))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def without_own(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query other than its own; shards must give k + 1."""
    most = ranked(found, ["key"], k + 1, F.col("own").desc())
    own = F.min(F.when(F.col("own"), F.col("rank"))).over(Window.partitionBy("key"))
    others = most.withColumn("own_rank", own).filter(~F.col("rank").eqNullSafe(F.col("own_rank")))
    rank = F.col("rank") - F.coalesce((F.col("rank") > F.col("own_rank")).cast("int"), F.lit(0))
    return others.withColumn("rank", rank).filter(F.col("rank") <= k).select("key", "rank", "id", "score")


def keyed(rows: DataFrame, asks: Column) -> DataFrame:
    """The rows that ask, numbered: the same row has the same key in every use of the written table."""
    chosen = rows.filter(F.coalesce(asks, F.lit(False))).select(F.monotonically_increasing_id().alias("key"), "id", "label", "vec")
    return session.written(chosen, "queries")
