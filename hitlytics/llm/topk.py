"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted lists, one per dimension.

Sorted access walks every list from the end that serves the query; random access scores each row once, when it is first
seen. What is still unseen cannot score above the sum of the lists' frontiers: a query stops when that bound is below
its kth score, so that no row, and no tie, is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlytics.llm import texts, vectors

K = 5
QUERY_STEP = 50
_FIRST_DEPTH = 16
_CELLS = 1 << 18


class Lists:
    """The rows of a shard and, per dimension, a list sorted from the smallest component up and each row's place in it."""

    def __init__(self, shard: vectors.Shard):
        self.shard = shard
        order = np.argsort(shard.vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(shard.vectors, order, 0)
        self.place = np.empty_like(order)
        np.put_along_axis(self.place, order, np.arange(len(order))[:, None], 0)

    def reached(self, upward: np.ndarray, downward: np.ndarray, depth: int) -> np.ndarray:
        """Per query, which rows stand among the first `depth` of a list it walks from the top or from the bottom."""
        top = (self.place >= len(self.place) - depth).astype(np.float32)
        bottom = (self.place < depth).astype(np.float32)
        return upward.astype(np.float32) @ top.T + downward.astype(np.float32) @ bottom.T > 0


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The kth best of each row; minus infinity if there are fewer."""
    n = scores.shape[1]
    if n < k:
        return np.full(len(scores), -np.inf)
    return (np.sort(scores, axis=1) if scores.dtype == object else np.partition(scores, n - k, axis=1))[:, n - k]


def _threshold_scores(lists: Lists, rows: np.ndarray, asked: np.ndarray, k: int) -> np.ndarray:
    """Scores of every row that was seen before a query stopped, minus infinity elsewhere."""
    n, total = len(rows), len(asked)
    scores = np.full((total, n), -np.inf, rows.dtype)
    seen = np.zeros((total, n), bool)
    active, depth = np.arange(total), 0
    while len(active):
        reach = min(n, max(_FIRST_DEPTH, n // 32, 2 * depth))
        upward = asked[active] > 0
        # Lists in which the query has a zero hold no part of the bound and are not walked.
        fresh = lists.reached(upward, asked[active] < 0, reach) & ~seen[active]
        seen[active] |= fresh
        columns = np.flatnonzero(fresh.any(0))
        query, column = np.nonzero(fresh[:, columns])
        scores[active[query], columns[column]] = (asked[active] @ rows[columns].T)[query, column]
        frontier = np.where(upward, lists.sorted[::-1][reach - 1], lists.sorted[reach - 1]).astype(rows.dtype)
        bound = (asked[active] * frontier).sum(1)
        depth = reach
        going = ~((bound < _kth(scores[active], k)) | seen[active].all(1))
        if depth == n and going.any():  # only rows of queries whose components are all zero are left
            left = active[going]
            scores[left] = np.where(seen[left], scores[left], (asked[left] @ rows.T))
            going[:] = False
        active = active[going]
    return scores


def _ask(k: int):
    def ask(lists: Lists, batch: pa.RecordBatch) -> pa.RecordBatch:
        shard = lists.shard
        queries = vectors.Queries(batch, shard.vectors.shape[1])
        found, step = vectors.Found(shard, queries), max(1, _CELLS // len(shard.vectors))
        rows, asked = vectors.exact(shard.vectors, queries.vectors)
        for low in range(0, len(queries), step):
            scores = _threshold_scores(lists, rows, asked[low:low + step], k)
            for i, (row, kth) in enumerate(zip(scores, _kth(scores, k))):
                above = np.flatnonzero(row > kth)
                above = above[np.argsort(-row[above], kind="stable")]
                level = np.flatnonzero(row == kth)[:k - len(above)] if kth > -np.inf else above[:0]
                at = np.concatenate([above, level])
                found.add(low + i, at, row[at])
        return found.batch()
    return ask


def nearest(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(key, rank, id, score): the k rows of `rows` (id, label, vec) with the highest inner product with each query of
    `queries` (key, id, vec), its own row left out; equal scores by the smaller id, rows without an id last.

    All rows if there are fewer than k. Repeated ids are rows of their own: of rows that repeat a query's id and vector,
    one is its own. Vectors of different lengths are compared as if the shorter ended in zeros; scores beyond a long are held
    at its ends after ranking within a shard. Empty tables give no rows.
    """
    asked = queries.withColumn("tops", F.lit(None).cast("array<long>"))
    found = vectors.search(rows, asked, vectors.shard_count(rows.count()), Lists, _ask(k + 1))
    return vectors.without_own(found, k)


def table(embeddings: DataFrame) -> DataFrame:
    """(id, label, vec) of the rows that take part; other columns, whatever their names, are left out."""
    return vectors.whole(embeddings.select("vec_id", "label", "embedding")).select(F.col("vec_id").alias("id"), "label", "vec")


def self_search(embeddings: DataFrame, query_step: int = QUERY_STEP, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose vec_id is divisible by `query_step`, against all rows."""
    texts.prepare(embeddings.sparkSession)
    rows = table(embeddings)
    queries = vectors.keyed(rows, F.col("id") % query_step == 0)
    found = nearest(rows, queries, k).withColumnRenamed("id", "vec_id")
    return found.join(queries.select("key", F.col("id").alias("query_id")), "key").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
