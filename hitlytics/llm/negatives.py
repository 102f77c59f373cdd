"""Hard negatives by an inverted multi-index.

Each half of the vector has a codebook; a row's two codewords name its cell. For a query, a codeword bounds the half-score
of all its rows: the query's product with the codeword plus its length times the codeword's radius. Cells are visited from
a heap by the sum of both bounds (multi-sequence order). Whatever is not visited scores at most the next sum, so a search
stops once its results, or its windows of scores, lie above that bound: results are exact, and recall is one. Cells are
never cut; a shard holds a bounded number of rows, so a cell that holds a third of the table is spread over all shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlytics import session
from hitlytics.llm import texts, vectors

ANCHOR_STEP = 100
POSITIVES = 5
NEGATIVES = 5
#: A negative's score lies between so many hundredths of the positive's and the positive's.
LEAST, MOST = 80, 100
#: Codewords of each half.
CODEWORDS = 8
#: Rows the codebooks are fitted on, drawn by a hash of id and vector; every row is indexed.
SAMPLE_ROWS = 4096
_ROUNDS = 10
_FIRST_ROWS = 256
_SLACK = 1e-9


def _closest(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words ** 2).sum(1) - 2 * points @ words.T).argmin(1)


def codebook(points: np.ndarray, size: int = CODEWORDS) -> np.ndarray:
    """k-means from evenly spread different points; fewer words if there are fewer points."""
    points = points.astype(np.float64)
    different = np.unique(points, axis=0)
    words = different[np.linspace(0, len(different) - 1, min(size, len(different))).astype(int)]
    for _ in range(_ROUNDS):
        code = _closest(points, words)
        counts = np.bincount(code, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, code, points)
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
    return words


def codebooks(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks of the first and second half, fitted on at most `sample_rows` rows; one zero word each without rows."""
    sample = rows.select("id", "vec").orderBy(F.xxhash64("id", "vec")).limit(sample_rows).toArrow()
    points = vectors.matrix(sample["vec"].combine_chunks()) if sample.num_rows else np.zeros((1, 0), np.int64)
    half = points.shape[1] // 2
    return codebook(points[:, :half]), codebook(points[:, half:])


class Cells:
    """A shard's rows by cell, and what bounds the half-scores of each codeword."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], shard: vectors.Shard):
        self.shard = shard
        width = shard.vectors.shape[1]
        self.half = len(books[0][0])
        codes, self.words, self.radius, self.used = [], [], [], []
        for book, (low, high) in zip(books, ((0, self.half), (self.half, max(width, self.half)))):
            part = shard.vectors[:, low:high].astype(np.float64)
            # Rows may be shorter or longer than those of the sample.
            words = np.zeros((len(book), part.shape[1]))
            shared = min(part.shape[1], book.shape[1])
            words[:, :shared] = book[:, :shared]
            code = _closest(part, words)
            radius = np.zeros(len(words))
            np.maximum.at(radius, code, np.sqrt(((part - words[code]) ** 2).sum(1)))
            codes.append(code)
            self.words.append(words)
            self.radius.append(radius)
            self.used.append(np.unique(code))
        cell = codes[0] * len(books[1]) + codes[1]
        self.rows = np.argsort(cell, kind="stable")
        self.starts = np.searchsorted(cell[self.rows], np.arange(len(books[0]) * len(books[1]) + 1)).tolist()
        self.second = len(books[1])

    def bounds(self, asked: np.ndarray) -> list[np.ndarray]:
        """Per half, a row of bounds for each query; rounding never puts one too low."""
        out = []
        for words, radius, part in zip(self.words, self.radius, (asked[:, :self.half], asked[:, self.half:])):
            part = part.astype(np.float64)[:, :words.shape[1]]
            length = np.sqrt((part ** 2).sum(1))[:, None]
            widest = np.sqrt((words ** 2).sum(1)) + radius
            out.append(part @ words.T + length * radius + _SLACK * (length * widest + 1))
        return out

    def visits(self, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """Rows of the cells in multi-sequence order, a growing number at a time, each time with the bound of all
        rows that are still to come (minus infinity at the end)."""
        left = self.used[0][np.argsort(-first[self.used[0]], kind="stable")]
        right = self.used[1][np.argsort(-second[self.used[1]], kind="stable")]
        a, b = first[left].tolist(), second[right].tolist()
        left, right = left.tolist(), right.tolist()
        heap, wanted, held, size = [(-(a[0] + b[0]), 0, 0)], _FIRST_ROWS, [], 0
        while heap:
            _, i, j = heapq.heappop(heap)
            # Every cell has one way to enter the heap: along the second half, and from its first cell to the next row.
            if j + 1 < len(b):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
            cell = left[i] * self.second + right[j]
            low, high = self.starts[cell], self.starts[cell + 1]
            if high > low:
                held.append(self.rows[low:high])
                size += high - low
            if held and (size >= wanted or not heap):
                yield np.concatenate(held), -heap[0][0] if heap else -np.inf
                wanted, held, size = 2 * wanted, [], 0


def _best(at: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, then by place in the shard."""
    order = np.lexsort((at, -scores))[:k] if scores.dtype != object else np.array(
        sorted(range(len(at)), key=lambda i: (-scores[i], at[i]))[:k], int)
    return at[order], scores[order]


def _ask_positives(k: int):
    def ask(cells: Cells, batch: pa.RecordBatch) -> pa.RecordBatch:
        shard = cells.shard
        queries = vectors.Queries(batch, shard.vectors.shape[1])
        rows, asked = vectors.exact(shard.vectors, queries.vectors)
        first, second = cells.bounds(queries.vectors)
        found = vectors.Found(shard, queries)
        for i in range(len(queries)):
            at, scores = np.zeros(0, np.int64), np.zeros(0, rows.dtype)
            for visited, bound in cells.visits(first[i], second[i]):
                visited = visited[shard.labels[visited] == queries.labels[i]]
                at, scores = _best(np.concatenate([at, visited]), np.concatenate([scores, rows[visited] @ asked[i]]), k)
                if len(at) == k and scores[-1] > bound:
                    break
            found.add(i, at, scores)
        return found.batch()
    return ask


def _ask_negatives(k: int, least: int, most: int):
    def ask(cells: Cells, batch: pa.RecordBatch) -> pa.RecordBatch:
        shard = cells.shard
        queries = vectors.Queries(batch, shard.vectors.shape[1])
        rows, asked = vectors.exact(shard.vectors, queries.vectors)
        first, second = cells.bounds(queries.vectors)
        found = vectors.Found(shard, queries)
        for i, tops in enumerate(queries.tops):
            # least * top <= most * score <= most * top, in whole numbers
            windows = [(-(-least * top // most), top) for top in tops]
            lowest, highest = min(w[0] for w in windows), max(w[1] for w in windows)
            at, scores = np.zeros(0, np.int64), np.zeros(0, rows.dtype)
            for visited, bound in cells.visits(first[i], second[i]):
                visited = visited[shard.labels[visited] != queries.labels[i]]
                reached = rows[visited] @ asked[i]
                inside = (reached >= lowest) & (reached <= highest)
                at, scores = np.concatenate([at, visited[inside]]), np.concatenate([scores, reached[inside]])
                sure = scores[scores > bound]
                if all(bound < low or high < low or np.count_nonzero((sure >= low) & (sure <= high)) >= k for low, high in windows):
                    break
            for w, (low, high) in enumerate(windows):
                inside = (scores >= low) & (scores <= high)
                if inside.any():
                    found.add(i, *_best(at[inside], scores[inside], k), w + 1)
        return found.batch()
    return ask


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
         sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(key, positive_id, positive_score, rank, negative_id, negative_score) for the anchors (key, id, label, vec).

    An anchor's positives are its `positives` best other rows of its label by inner product; a positive's negatives the
    `negatives` best rows of other labels whose score lies between least/most of the positive's and the positive's. Equal
    scores are ordered by the smaller id, rows without an id last. Anchors without positives and positives without
    negatives give no rows. Rows need a label and a vector; of rows that repeat an anchor's id and vector, one is its own,
    all others count. Empty tables give no rows. Scores beyond a long are held at its ends.
    """
    shards, index = vectors.shard_count(rows.count()), partial(Cells, codebooks(rows, sample_rows))
    nobody = anchors.withColumn("tops", F.lit(None).cast("array<long>"))
    near = vectors.without_own(vectors.search(rows, nobody, shards, index, _ask_positives(positives + 1)), positives)
    near = session.written(near.select("key", F.col("rank").cast("int").alias("top"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    tops = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("top", "positive_score"))).alias("tops"))
    asked = anchors.join(tops.select("key", F.col("tops.positive_score").alias("tops")), "key")
    found = vectors.search(rows, asked, shards, index, _ask_negatives(negatives, least, most))
    best = vectors.ranked(found, ["key", "top"], negatives)
    return best.join(near, ["key", "top"]).select(
        "key", "positive_id", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))


def table(embeddings: DataFrame) -> DataFrame:
    """(id, label, vec) of the rows with a label and a finite vector; where 7 divides vec_id, the label is the next of ten."""
    rows = vectors.whole(embeddings.select("vec_id", "label", "embedding")).filter(F.col("label").isNotNull())
    moved = F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False))
    label = F.col("label").cast("long")
    return rows.select(F.col("vec_id").alias("id"), F.when(moved, (label + 1) % 10).otherwise(label).alias("label"), "vec")


def self_mine(embeddings: DataFrame, anchor_step: int = ANCHOR_STEP) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows whose vec_id is divisible by
    `anchor_step`, against all rows."""
    texts.prepare(embeddings.sparkSession)
    rows = table(embeddings)
    anchors = vectors.keyed(rows, F.col("id") % anchor_step == 0)
    found = mine(rows, anchors).join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
