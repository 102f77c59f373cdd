"""The prefix trie against brute force: shared beginnings, copies over many shards, odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from hitlytics.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, digest string, words long, seq string, shard int, parent string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 7, "s", 3, "p") for r in rows], SCHEMA)


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows):
    held = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            held[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    held = {c: [t[3:] for t in sorted(ts)] for c, ts in held.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(held):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        seq = (*held.get(base, [])[:h], *held[c][h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p in members:
        w = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += w
            leaves[p[:d]] += not kids[p]
    return [(members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), kids[p], leaves[p], saved[p],
             hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p in members]


def same(found, wanted):
    key = lambda row: tuple((x is None, x or 0) for x in row)
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)
    return True


def branching(n, seed, names=3, longest=6):
    rng = random.Random(seed)
    return [(c, t, rng.choice("ua"), f"turn {rng.randrange(names)} x")
            for c in range(n) for t in range(rng.randrange(longest + 1))]


ODD = [
    (0, 0, "u", "hello there"), (0, 1, "a", None), (0, None, None, "  "), (1, 0, "u", "hello there"), (1, 5, "a", "x y"), (1, 5, "a", "b c"),
    (2, 0, "u", "é ß 日本"), (3, 0, "u", "w " * 30_000), (3, 1, "u", "end"), (None, 0, "u", "nobody"), (None, None, None, None),
    (-3, 0, "u", "minus"), (-20, 0, "u", "hello there"), (41, 0, "u", "no base"), (41, 1, "u", "no base"), (41, 1, "u", "no base"),
    (5, 0, "u1", ":x"), (6, 0, "u", "1:x"), (7, 0, None, None), (2 ** 62, 3, "u", "far"), (60, 0, "u", "a"), (61, 0, "u", "a"), (62, 0, "u", "a")]
COPIES = [(c, t, "u", f"same {t}") for c in range(400) for t in range(5)] + branching(60, 4)
LONG = [(c, t, "u", f"step {t}") for c in range(45) for t in range(120 + c % 3)]
CASES = {"odd": ODD, "branching": branching(300, 1), "narrow": branching(500, 2, names=1, longest=9), "copies": COPIES, "long": LONG,
         "one": [(7, 0, "u", "x")]}


@pytest.mark.parametrize("name", list(CASES))
def test_trie_equals_brute_force(spark, name):
    assert same(prefixes.trie(frame(spark, CASES[name])).collect(), brute(CASES[name]))


@pytest.mark.parametrize("shards", ["1", "37"])
def test_number_of_shards_changes_nothing(spark, monkeypatch, shards):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    monkeypatch.setattr(prefixes, "PART_IDS", 7)
    try:
        assert same(prefixes.trie(frame(spark, COPIES)).collect(), brute(COPIES))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty_table(spark):
    assert prefixes.trie(frame(spark, [])).collect() == []
    assert prefixes.trie(frame(spark, [(None, 1, "u", "x")])).collect() == []


def test_trees_are_balanced():
    trie = prefixes.Trie()
    assert sorted(prefixes.medians(1000)) == list(range(1000))
    for i in prefixes.medians(1000):
        trie.insert([i, 0])
    deepest, stack = 0, [(trie.equal[0], 1)]
    while stack:
        at, depth = stack.pop()
        if at:
            deepest = max(deepest, depth)
            stack += [(trie.low[at], depth + 1), (trie.high[at], depth + 1)]
    assert deepest == 10 and len(trie.traversal()) == 2001
