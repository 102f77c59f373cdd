"""Near-duplicate groups by SimHash, searched through a hierarchical index in Gray order.

Every pair of fingerprints that differ in at most three bits is found. Fingerprints are dealt to groups that share
one of four blocks of bits, since three differences cannot touch all four blocks; a group with too many members is
dealt again by a block of its remaining bits, so no bucket needs a cap. Within a group, fingerprints are sorted by their
rank in Gray order and runs of neighbours are factored into nodes that hold the bits all members share. A search adds up
the differences on the way down and drops a whole node as soon as they exceed the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlytics.llm import texts

SHINGLE_WORDS = 3
SEED = 42
MAX_DIFFERENCES = 3
#: Members of a group that one search takes; larger groups are dealt again by further bits.
GROUP_LIMIT = 1024
#: After five dealings 49 bits are equal in a group, so it has at most 2^15 different fingerprints.
MAX_LEVELS = 5
FAN_OUT = 8
_SHINGLE_BLOCK = 1 << 16
_FRONTIER = 1 << 21


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's word shingles; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    total, counts = len(words) - SHINGLE_WORDS + 1, np.zeros(64, np.int64)
    for low in range(0, total, _SHINGLE_BLOCK):
        part = words[low:low + _SHINGLE_BLOCK + SHINGLE_WORDS - 1]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(part, part[1:], part[2:])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["id", "print"])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, print): the SimHash of each whole text as a signed 64-bit number. Null, empty and wordless texts have zero."""
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        _fingerprint_batches, f"id {texts.kind(docs, id_column)}, print long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def parts_of(mask: int) -> list[int]:
    """`mask` widened by each of four blocks of the bits it leaves open."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [round(i * len(free) / (MAX_DIFFERENCES + 1)) for i in range(MAX_DIFFERENCES + 2)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])]


def _deal(rows: DataFrame, masks: list[int]) -> DataFrame:
    """Copies each (print, mask) row to the four finer groups of its mask."""
    finer = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(p)) for p in parts_of(m)]))])
    return rows.select("print", F.explode(finer[F.col("mask")]).alias("mask")).withColumn(
        "shared", F.col("print").bitwiseAND(F.col("mask")))


def groups(prints: DataFrame) -> DataFrame:
    """(print, mask, shared): groups within which all close pairs are to be searched."""
    masks, rows = [0], prints.select("print", F.lit(0).cast("long").alias("mask"))
    settled = None
    for level in range(1, MAX_LEVELS + 1):
        rows, masks = _deal(rows, masks), sorted({p for m in masks for p in parts_of(m)})
        large = None
        if level < MAX_LEVELS:
            sizes = rows.groupBy("mask", "shared").count().filter(F.col("count") > GROUP_LIMIT).select("mask", "shared")
            large = texts.checkpointed(sizes)
            if large.isEmpty():
                large = None
        small = rows if large is None else rows.join(large, ["mask", "shared"], "left_anti").select("print", "mask", "shared")
        settled = small if settled is None else settled.unionByName(small)
        if large is None:
            break
        # Different ways of dealing can lead to one mask.
        rows = texts.checkpointed(rows.join(large, ["mask", "shared"], "left_semi").select("print", "mask").distinct())
    return settled


def _gray_rank(column: str) -> F.Column:
    rank = F.col(column)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank


def _levels(prints: np.ndarray, group: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per level from the leaves up: bits shared below a node, their values, first child, end of children."""
    every, some = prints, prints
    nodes = np.arange(len(prints))
    out = [(np.full(len(prints), ~np.uint64(0)), prints, nodes, nodes + 1)]
    while True:
        heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        if len(heads) == len(group) and len(out) > 1:
            return out
        place = np.arange(len(group)) - np.repeat(heads, np.diff(np.r_[heads, len(group)]))
        first = np.flatnonzero(place % FAN_OUT == 0)
        every, some = np.bitwise_and.reduceat(every, first), np.bitwise_or.reduceat(some, first)
        shared = ~(every ^ some)
        out.append((shared, every & shared, first, np.r_[first[1:], len(group)]))
        group = group[first]


def _close_pairs(prints: np.ndarray, group: np.ndarray, queries: np.ndarray,
                 levels: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    tops = np.unique(group, return_inverse=True)[1]
    shared, values, _, _ = levels[-1]
    asked, node = queries, tops[queries]
    differ = np.bitwise_count((prints[asked] ^ values[node]) & shared[node])
    for above, below in zip(levels[::-1], levels[-2::-1]):
        near = differ <= MAX_DIFFERENCES
        asked, node, differ = asked[near], node[near], differ[near]
        count = above[3][node] - above[2][node]
        child = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(above[2][node], count)
        asked, parent, differ = np.repeat(asked, count), np.repeat(node, count), np.repeat(differ, count)
        own = below[0][child] & ~above[0][parent]
        differ = differ + np.bitwise_count((prints[asked] ^ below[1][child]) & own)
        node = child
    near = (differ <= MAX_DIFFERENCES) & (asked < node)
    return asked[near], node[near]


def _merge(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    while True:
        a, b = labels[left], labels[right]
        apart = a != b
        if not apart.any():
            return labels
        np.minimum.at(labels, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (labels != labels[labels]).any():
            labels = labels[labels]


def links_within(prints: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the close pairs of each group; rows of a group are neighbours, in Gray order."""
    _, first, size = np.unique(group, return_index=True, return_counts=True)
    lonely = np.repeat(size == 1, size)
    prints, group = prints[~lonely], group[~lonely]
    if not len(prints):
        return prints, prints
    levels, labels = _levels(prints, group), np.arange(len(prints))
    step = max(1, _FRONTIER // int(size.max()))
    for low in range(0, len(prints), step):
        labels = _merge(labels, *_close_pairs(prints, group, np.arange(low, min(low + step, len(prints))), levels))
    tied = labels != np.arange(len(labels))
    return prints[tied], prints[labels[tied]]


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; the last group of a batch waits for its rest."""
    kept = None

    def search(rows: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.r_[True, (rows[1:, 1:] != rows[:-1, 1:]).any(1)])
        left, right = links_within(rows[:, 0].copy().view(np.uint64), group)
        return pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), pa.array(right.view(np.int64))], ["a", "b"])

    for batch in batches:
        rows = np.column_stack([c.to_numpy() for c in batch.columns])
        rows = rows if kept is None else np.concatenate([kept, rows])
        if len(rows):
            whole = int(np.flatnonzero((rows[:, 1:] == rows[-1, 1:]).all(1))[0])
            kept = rows[whole:]
            if whole:
                yield search(rows[:whole])
    if kept is not None and len(kept):
        yield search(kept)


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints whose components are those of all close pairs."""
    ordered = groups(prints).withColumn("rank", _gray_rank("print")).repartition("mask", "shared").sortWithinPartitions(
        "mask", "shared", "rank")
    return ordered.select("print", "mask", "shared").mapInArrow(_link_batches, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each linked node reaches, by alternating large and small stars."""
    edges, before = texts.checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), None
    while True:
        size, total = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (size, total) == before or not size:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = size, total
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = texts.checkpointed(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, print, component): one row per row of `docs`; component is the smallest id reachable over links.

    Texts without words all have fingerprint zero and so form one component. Rows repeated under one id give one row
    each; a null id is never a component's name unless all of its ids are null. An empty table gives no rows.
    """
    prints = texts.checkpointed(fingerprints(docs, id_column, text_column))
    smallest = texts.checkpointed(prints.groupBy("print").agg(F.min("id").alias("id")))
    roots = components(links(smallest.select("print")))
    named = smallest.join(roots, smallest["print"] == roots["node"], "left").select(
        "print", "id", F.coalesce("root", "print").alias("root"))
    names = named.groupBy("root").agg(F.min("id").alias("component"))
    return prints.join(named.join(names, "root").select("print", "component"), "print").select("id", "print", "component")


def hexadecimal(column: str) -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
