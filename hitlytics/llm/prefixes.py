"""Prefix trie of conversations: who shares which beginning, and what sharing saves.

A turn is known by a digest of its role and text. Conversations are sorted by their digests and cut into range shards of
about equal size, so that one beginning, or one conversation, may belong to any share of them. Each shard numbers its
different turns in order and builds a ternary search tree over the numbers, inserting the median of each range first; an
iterative traversal then adds up members, leaves and savings. Only nodes on the first or last conversation of a shard can
lie in several shards; they are named by the shard they begin in and their depth, and merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitlytics import session
from hitlytics.llm import texts

#: Fixed values of the rebuilding rule: conversations by twenties, up to three turns of the first of each.
GROUP, HEADS = 20, 4
#: Turns of a shard, on average.
SHARD_TURNS = 1 << 18
#: Ids of a text that is hashed in parts.
PART_IDS = 4096
WORD = r"[^\x20\x09-\x0D]+"

_NODE = ("first long, depth int, members long, children long, leaves long, saved long, ends string, "
         "parent long, origin int, parent_origin int, shard int, part int")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words) of the turns of conversations that have an id."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(digest).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def _in_order(rows: DataFrame) -> DataFrame:
    """(conv_id, seq): turns by number, those without one first; equal numbers by digest."""
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("seq"))


def rebuilt(rows: DataFrame) -> DataFrame:
    """(conv_id, seq): each conversation begins with the first turns of the first one of its twenty."""
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = _in_order(rows.filter(F.col("conv_id") % GROUP == 0)).select(
        F.col("conv_id").alias("base"), F.slice("seq", 1, HEADS - 1).alias("head"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    own = _in_order(rows).withColumn("base", base).join(heads, "base", "left").withColumn("h", shared)
    seq = F.concat(
        F.when(F.col("head").isNotNull(), F.expr("slice(head, 1, h)")).otherwise(F.expr("slice(seq, 1, 0)")),
        F.expr("slice(seq, h + 1, greatest(size(seq) - h, 0))"))
    return own.select("conv_id", seq.alias("seq"))


def _common(a: str, b: str) -> Column:
    """Length of the common beginning of two arrays."""
    equal = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return F.coalesce(F.nullif(F.array_position(equal, False), F.lit(0)) - 1, F.size(a).cast("long"))


Seams = dict[int, tuple[int, int, int]]


def _seams(sharded: DataFrame) -> Seams:
    """Per shard with rows: its place among them, and how many turns its first conversation shares with the last one before
    it and with its own last one."""
    edges = sharded.groupBy("shard").agg(F.min("keys").alias("first"), F.max("keys").alias("last"))
    # One row per shard.
    before = F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("shard"))
    seams = edges.withColumn("before", before).select(
        "shard", F.when(F.col("before").isNotNull(), _common("first", "before")).otherwise(-1).alias("shared"),
        _common("first", "last").alias("within"))
    return {r["shard"]: (i, r["shared"], r["within"]) for i, r in enumerate(seams.orderBy("shard").collect())}


class Trie:
    """A ternary search tree of number sequences; node 0 is the root, of no number."""

    def __init__(self):
        self.key, self.low, self.equal, self.high = [-1], [0], [0], [0]
        self.parent, self.depth = [0], [0]

    def _node(self, key: int, parent: int) -> int:
        self.key.append(key)
        for links in (self.low, self.equal, self.high):
            links.append(0)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        return len(self.key) - 1

    def insert(self, sequence: list[int]) -> list[int]:
        """The nodes of a sequence, from the root on."""
        path = [0]
        for key in sequence:
            parent = path[-1]
            at, links, holder = self.equal[parent], self.equal, parent
            while at and self.key[at] != key:
                links = self.low if key < self.key[at] else self.high
                holder, at = at, links[at]
            if not at:
                at = links[holder] = self._node(key, parent)
            path.append(at)
        return path

    def traversal(self) -> list[int]:
        """Every node after its parent, without recursion."""
        order, stack = [0], [self.equal[0]]
        while stack:
            at = stack.pop()
            if at:
                order.append(at)
                stack += (self.high[at], self.equal[at], self.low[at])
        return order


def medians(count: int) -> Iterator[int]:
    """0 to count - 1, the middle of every range ahead of the rest of it."""
    ranges = [(0, count)]
    for low, high in ranges:
        if low < high:
            middle = (low + high) // 2
            yield middle
            ranges += ((low, middle), (middle + 1, high))


def _origins(shard: int, place: Seams, depth: int) -> list[int]:
    """For each depth up to `depth`, the place of the shard in which the node on this shard's first conversation begins."""
    shared, within = ({p[0]: p[i] for p in place.values()} for i in (1, 2))
    here, out = place[shard][0], [0] * (depth + 1)
    at = here
    for d in range(depth, -1, -1):
        # In a shard before, the node goes back further only if it is on its first conversation as well as on its last.
        while (at == here or within[at] >= d) and shared[at] >= d:
            at -= 1
        out[d] = at
    return out


def _summarise(shard: int, place: Seams, keys: list[tuple], words: list[list[int]], ids: list[list[int]]) -> Iterator[tuple]:
    """Rows of all nodes of one shard, from its different sequences in order, the words of their turns and their members.

    A node's name (origin, depth) is given only if other shards may hold it too. What neighbours count as well is left to
    one of them: a child to the shard it begins in, a leaf to the shard it ends in.
    """
    numbers = {t: i for i, t in enumerate(sorted({t for s in keys for t in s}))}
    trie, paths = Trie(), [[]] * len(keys)
    for i in medians(len(keys)):
        paths[i] = trie.insert([numbers[t] for t in keys[i]])
    size = len(trie.key)
    weight, ends = [0] * size, [[]] * size
    for path, w, members in zip(paths, words, ids):
        ends[path[-1]] = members
        for node, count in zip(path[1:], w):
            weight[node] = count
    here, before, _ = place[shard]
    after = next((p[1] for p in place.values() if p[0] == here + 1), -1)
    origin = [-1] * size
    for node, at in zip(paths[0], _origins(shard, place, min(before, len(paths[0]) - 1))):
        origin[node] = at
    for node in paths[-1][:after + 1]:
        if origin[node] < 0:
            origin[node] = here

    order = trie.traversal()
    first, members, children, leaves, saved = ([0] * size for _ in range(5))
    first = [None] * size
    continued = paths[-1][-1] if after == len(paths[-1]) - 1 else -1
    for node in reversed(order):
        own = ends[node]
        members[node] += len(own)
        if own and (first[node] is None or own[0] < first[node]):
            first[node] = own[0]
        if not children[node] and node != continued:
            leaves[node] = 1
        saved[node] += (members[node] - 1) * weight[node]
        if node:
            up = trie.parent[node]
            members[up] += members[node]
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
            if first[up] is None or first[node] < first[up]:
                first[up] = first[node]
    # A seam with the shard before: its nodes are one each, not two.
    seam = paths[0][:before + 1]
    again = 0
    for node, child in zip(reversed(seam), [None, *reversed(seam)]):
        again += weight[node]
        saved[node] += again
        children[node] -= child is not None
    for node in order:
        up = trie.parent[node]
        shared = origin[node] >= 0
        texts_of = [str(i) for i in ends[node]]
        parts = [",".join(texts_of[i:i + PART_IDS]) for i in range(0, len(texts_of), PART_IDS)]
        digest = None if shared else hashlib.sha256(",".join(texts_of).encode()).hexdigest()
        yield (first[node], trie.depth[node], members[node], children[node], leaves[node], saved[node], digest,
               first[up] if node else None, origin[node] if shared else None, origin[up] if node and origin[up] >= 0 else None, here, 0)
        if shared:
            for number, part in enumerate(parts, 1):
                yield (None, trie.depth[node], None, None, None, None, part, None, origin[node], None, here, number)


def _batches(place: Seams, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards come one after another, each sorted by sequence and id."""
    names = [c.split()[0] for c in _NODE.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in _NODE.split(", ")]

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])

    def nodes() -> Iterator[tuple]:
        for shard, held in groupby(rows(), key=lambda r: r[0]):
            keys, words, ids = [], [], []
            for _, conversation, sequence, counts in held:
                sequence = tuple(sequence)
                if not keys or keys[-1] != sequence:
                    keys.append(sequence)
                    words.append(counts)
                    ids.append([])
                ids[-1].append(conversation)
            yield from _summarise(shard, place, keys, words, ids)

    waiting = []
    for node in nodes():
        waiting.append(node)
        if len(waiting) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting), kinds)], names)
            waiting = []
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting), kinds)], names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's parts, which come in order, joined by commas."""
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])

    for name, parts in groupby(rows(), key=lambda r: r[:2]):
        digest, comma = hashlib.sha256(), b""
        for part in parts:
            digest.update(comma + part[4].encode())
            comma = b","
        yield pa.RecordBatch.from_arrays(
            [pa.array([name[0]], pa.int32()), pa.array([name[1]], pa.int32()), pa.array([digest.hexdigest()])], ["origin", "depth", "ends"])


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row per node.

    Null roles and texts are empty, null turn numbers come first and turns of equal number in the order of their digests.
    Rows without a conv_id belong to no conversation and are left out; repeated rows are turns of their own. Texts without
    words save nothing. An empty table gives no nodes. A conversation is held as the digests of its turns, its texts are not.
    """
    spark = texts.prepare(conversations.sparkSession)
    sequences = session.written(rebuilt(turns(conversations)).select(
        "conv_id", F.col("seq.digest").alias("keys"), F.col("seq.words").alias("words")), "sequences")
    total = sequences.agg(F.sum(F.size("keys") + 1)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_TURNS))
    sharded = session.written(
        sequences.repartitionByRange(shards, "keys", "conv_id").withColumn("shard", F.spark_partition_id()), "shards")
    place = _seams(sharded)
    nodes = session.written(
        sharded.select("shard", "conv_id", "keys", "words").repartition(shards, "shard").sortWithinPartitions("shard", "keys", "conv_id")
        .mapInArrow(partial(_batches, place), _NODE), "nodes")

    name = ["origin", "depth"]
    pieces = nodes.filter(F.col("origin").isNotNull())
    ends = pieces.filter("part > 0").select(*name, "shard", "part", "ends").repartition(*name).sortWithinPartitions(
        *name, "shard", "part").mapInArrow(_hashed, "origin int, depth int, ends string")
    seam = pieces.filter("part = 0").groupBy(*name).agg(
        F.min("first").alias("first"), *[F.sum(c).alias(c) for c in ("members", "children", "leaves", "saved")],
        F.min("parent_origin").alias("parent_origin")).join(ends, name, "left")
    # Few rows: at most the length of one conversation per shard.
    seam = session.written(seam.withColumn("ends", F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256))), "seams")
    inner = nodes.filter(F.col("origin").isNull()).select("first", "depth", "members", "children", "leaves", "saved", "ends", "parent", "parent_origin")
    rows = inner.unionByName(seam.drop("origin").withColumn("parent", F.lit(None).cast("long")))
    above = seam.select(F.col("origin").alias("parent_origin"), (F.col("depth") + 1).alias("depth"), F.col("first").alias("seam_parent"))
    return rows.join(above, ["parent_origin", "depth"], "left").select(
        F.col("first").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.coalesce("seam_parent", "parent").alias("parent_conv_id"),
        F.col("members").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
