"""Exact top-k search and hard negatives against brute force, with every odd row."""

import math

import numpy as np
import pytest

from hitlytics.llm import negatives, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id long, vec string, key long, label2 int, score string, rank int"
ODD = [float("nan"), float("inf"), float("-inf"), None]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "v", 2, 3, "s", 4) for i, v, y in rows], SCHEMA)


def clustered(n, seed, width=8, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 5] + rng.normal(size=width) / 2], int(rng.integers(0, 10))) for i in range(n)]
    same = rows[3][1]
    return rows + [(n + i, same, int(rng.integers(0, 10))) for i in range(copies)]


def odd_rows():
    base = clustered(150, 3)
    bad = [(1000 + i, [1.0, x, 2.0], 1) for i, x in enumerate(ODD)]
    return base + bad + [
        (2000, None, 1), (2100, [], 1), (2101, [], 2), (2200, [0.0] * 8, 1), (2300, [1.0] * 12, 3), (2400, [0.5, 0.5], 3),
        (None, [1.0] * 8, 1), (None, [1.0] * 8, 2), (100, base[100][1], base[100][2]), (100, base[100][1], base[100][2]),
        (-100, base[7][1], 4), (-50, base[7][1], None), (0, base[0][1], None)]


def whole(rows):
    out = []
    for i, v, y in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, [math.floor(256 * x) for x in v], y))
    return out


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def order(row):
    return -row[0], row[1] is None, row[1] or 0


def brute_top(rows, step=50, k=5):
    rows, out = whole(rows), []
    for q, (i, v, _) in enumerate(rows):
        if i is not None and i % step == 0:
            scored = sorted(((product(v, w), j) for r, (j, w, _) in enumerate(rows) if r != q), key=order)[:k]
            out += [(i, rank, j, s) for rank, (s, j) in enumerate(scored, 1)]
    return out


def moved(i, y):
    return (y + 1) % 10 if i is not None and i % 7 == 0 else y


def brute_negatives(rows, step=100):
    rows = [(i, v, moved(i, y)) for i, v, y in whole(rows) if y is not None]
    out = []
    for a, (i, v, y) in enumerate(rows):
        if i is None or i % step:
            continue
        scored = sorted(((product(v, w), j, z) for r, (j, w, z) in enumerate(rows) if r != a), key=order)
        for ps, p, _ in [r for r in scored if r[2] == y][:5]:
            fit = [r for r in scored if r[2] != y and 80 * ps <= 100 * r[0] <= 100 * ps][:5]
            out += [(i, p, rank, n, ps, ns) for rank, (ns, n, _) in enumerate(fit, 1)]
    return out


def same(found, wanted):
    key = lambda row: tuple((x is None, x or 0) for x in row)
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)
    return True


CASES = {
    "odd": odd_rows(),
    "clusters": clustered(2500, 1),
    "copies": clustered(700, 2, copies=900),
    "one": [(0, [1.0, 2.0], 1)],
    "negative": [(i, [-1.0 if i else 1.0, i / 7], i % 3) for i in range(0, 300, 3)],
    "huge": [(i, [3e38 if i % 3 else -1e38, float(i)], i % 2) for i in range(0, 120, 5)],
}


@pytest.mark.parametrize("name", [n for n in CASES if n != "huge"])
def test_top_k_equals_brute_force(spark, name):
    assert same(topk.self_search(frame(spark, CASES[name])).collect(), brute_top(CASES[name]))


@pytest.mark.parametrize("name", [n for n in CASES if n != "huge"])
def test_negatives_equal_brute_force(spark, name):
    assert same(negatives.self_mine(frame(spark, CASES[name])).collect(), brute_negatives(CASES[name]))


def test_huge_components_are_held_at_the_ends(spark):
    rows = frame(spark, CASES["huge"])
    found = topk.self_search(rows).collect()
    assert len(found) == 15 and {abs(r["score"]) for r in found} <= {2 ** 63 - 1, 2 ** 63}
    negatives.self_mine(rows).collect()


def test_empty_tables(spark):
    assert topk.self_search(frame(spark, [])).collect() == []
    assert negatives.self_mine(frame(spark, [])).collect() == []
    assert negatives.self_mine(frame(spark, [(0, None, 1)])).collect() == []


def shard_of(matrix, labels=None):
    import pyarrow as pa

    n = len(matrix)
    return vectors.Shard(pa.table({"id": pa.array(range(n), pa.int64()), "label": pa.array([0] * n if labels is None else labels, pa.int64()),
                                   "vec": pa.array([list(map(int, r)) for r in matrix], pa.list_(pa.int64()))}))


def test_threshold_algorithm_stops_early():
    """On rows that one list tells apart, most are never scored."""
    rng = np.random.default_rng(5)
    rows = np.column_stack([np.arange(4000) * 50, rng.integers(-5, 5, (4000, 3))]).astype(np.int64)
    lists = topk.Lists(shard_of(rows))
    scores = topk._threshold_scores(lists, rows.astype(float), np.array([[10., 1, -1, 1]]), 6)
    seen = np.isfinite(scores[0])
    whole_scores = rows @ np.array([10, 1, -1, 1])
    assert seen.sum() < 2000 and (np.sort(scores[0][seen])[-6:] == np.sort(whole_scores)[-6:]).all()


def test_cells_bound_what_they_hold_and_come_once():
    rng = np.random.default_rng(6)
    rows = rng.integers(-200, 200, (900, 6))
    cells = negatives.Cells((negatives.codebook(rows[:, :3]), negatives.codebook(rows[:, 3:])), shard_of(rows))
    query = rng.integers(-200, 200, (1, 6))
    first, second = cells.bounds(query)
    left, scores, parts = set(range(900)), rows @ query[0], 0
    for visited, bound in cells.visits(first[0], second[0]):
        assert left.issuperset(visited.tolist())
        left -= set(visited.tolist())
        assert not left or max(scores[list(left)]) <= bound
        parts += 1
    assert not left and parts > 1


def test_sample_bounds_only_the_codebooks(spark):
    rows = negatives.table(frame(spark, CASES["clusters"]))
    books = negatives.codebooks(rows, 20)
    assert all(len(b) <= negatives.CODEWORDS for b in books)
    anchors = vectors.keyed(rows, rows["id"] % 100 == 0)
    found = negatives.mine(rows, anchors, sample_rows=20).join(anchors, "key").select("id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert same(found.collect(), brute_negatives(CASES["clusters"]))
