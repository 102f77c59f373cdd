import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpora import docs, odd_texts
from hitlytics.llm import pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.vocabulary(pieces.VOCABULARY)


def all_segmentations(text, vocabulary):
    """{ids: probability} of a text, by listing them."""
    by_text = {t: n for n, t in enumerate(vocabulary.text) if t and vocabulary.byte[t[0]] != n}
    total = {}

    def cost(piece):
        node = 0
        for char in piece:
            node = int(vocabulary.children(np.array([node], np.int32), np.array([ord(char)], np.int32))[0])
        return float(vocabulary.cost[node])

    def go(at, ids, log_p):
        if at == len(text):
            total[tuple(ids)] = math.exp(log_p)
        for end in range(at + 1, len(text) + 1):
            piece = text[at:end]
            if (n := by_text.get(piece.encode())) is not None:
                go(end, [*ids, n], log_p + cost(piece))
            elif end == at + 1:
                data = piece.encode()
                go(end, [*ids, *[int(vocabulary.byte[b]) for b in data]], log_p + len(data) * vocabulary.byte_cost)

    go(0, [], 0.0)
    whole = sum(total.values())
    return {k: v / whole for k, v in total.items()}


def draw(texts, k, seed=3):
    keys = np.arange(1, len(texts) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return pieces.sample(texts, keys, pieces.lattices(pieces.VOCABULARY), k, seed)


def test_lattice_probabilities(vocabulary):
    want = all_segmentations(" thenç", vocabulary)
    for row in draw(["thenç"] * 50, 1):
        ids, log_p, _ = row[0]
        assert math.exp(log_p) == pytest.approx(want[tuple(ids)], rel=1e-3)


def test_first_samples_follow_the_distribution_and_pairs_the_draw_without_replacement(vocabulary):
    want = all_segmentations(" abc", vocabulary)
    n = 20_000
    found = draw(["abc"] * n, 2)
    firsts = Counter(tuple(r[0][0]) for r in found)
    pairs = Counter((tuple(r[0][0]), tuple(r[1][0])) for r in found)
    for ids, p in want.items():
        assert abs(firsts[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4
    for a, pa in want.items():
        for b, pb in want.items():
            p = pa * pb / (1 - pa) if a != b else 0
            assert abs(pairs[a, b] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_inclusion_scores_weigh_to_one(vocabulary):
    """The sum of p / q over the samples is an unbiased estimate of the whole probability."""
    found = draw(["abcd"] * 4000, 3)
    sums = [sum(math.exp(p - q) for _, p, q in row) for row in found]
    assert abs(np.mean(sums) - 1) < 5 * np.std(sums) / math.sqrt(len(sums)) + 1e-3


def test_all_segmentations_are_found_once(vocabulary):
    want = all_segmentations(" abc", vocabulary)
    for row in draw(["abc"] * 20, len(want) + 5):
        assert sorted(tuple(r[0]) for r in row) == sorted(want)
        assert all(r[2] == 0 for r in row)


@pytest.mark.parametrize("text", ["I", "a", ".", " a", "  a", "a  b", "\n  a", "    ", "x" * 12])
def test_rare_segmentations_and_runs_of_spaces_are_found(text, vocabulary):
    """All segmentations, however small their chance, each with its probability."""
    want = all_segmentations(" " + text, vocabulary)
    k = len(want) if len(want) < 300 else 2
    for row in draw([text] * 3, k):
        assert len({tuple(r[0]) for r in row}) == k
        assert all(r[1] == pytest.approx(math.log(want[tuple(r[0])]), abs=1e-3) for r in row)


def test_pieces_reach_over_long_runs(vocabulary):
    """No cut within a unit: a run's log probability is its pieces' cost less the sum over the whole lattice."""
    for text in ["x" * 300, "ab" * 700, " " * 900 + "end", "=" * 513]:
        whole, cost = " " + text, {t.decode(): n for n, t in enumerate(vocabulary.text) if t and vocabulary.byte[t[0]] != n}
        costs, most = {}, max(map(len, cost))
        for piece in {whole[i:j] for i in range(len(whole)) for j in range(i + 1, min(len(whole), i + most) + 1)} & set(cost):
            node = 0
            for char in piece:
                node = int(vocabulary.children(np.array([node], np.int32), np.array([ord(char)], np.int32))[0])
            costs[piece] = float(vocabulary.cost[node])
        total = [0.0] + [-math.inf] * len(whole)
        for j in range(1, len(whole) + 1):
            total[j] = np.logaddexp.reduce([total[i] + costs[whole[i:j]] for i in range(max(0, j - most), j) if whole[i:j] in costs])
        for ids, log_p, _ in draw([text], 3)[0]:
            assert log_p == pytest.approx(sum(costs[vocabulary.text[i].decode()] for i in ids) - total[-1], abs=1e-2)
    assert len(pieces.units_of("x" * 9000)) == 1


def test_no_piece_crosses_the_beginning_of_a_unit(vocabulary):
    for n, piece in enumerate(vocabulary.text):
        if piece and vocabulary.byte[piece[0]] != n:
            assert b"\n" not in piece and b" " not in piece.lstrip(b" ")


def test_round_trip_of_odd_texts(vocabulary):
    texts = [t for _, t in odd_texts()] + ["a  b\n\nc \n d", "\n", " ", "▁", "ab" * 1000 + " " + "ç" * 700]
    for text, row in zip(texts, draw(texts, 3)):
        assert (row == []) == (text is None)
        assert len({tuple(r[0]) for r in row}) == len(row)
        assert all(vocabulary.decode(list(r[0])) == text for r in row)


def test_draws_depend_on_the_key_alone(spark):
    rows = [(i, t) for i, t in odd_texts() if t is not None and i is not None]
    one = {r.id: r.samples for r in pieces.encode(docs(spark, rows).repartition(5)).collect()}
    other = {r.id: r.samples for r in pieces.encode(docs(spark, rows[::-1] + [(77, "more words here")]).coalesce(1)).collect()}
    assert all(other[i] == s for i, s in one.items())
    assert one[1] != one[2]  # the same text under another key


def test_lattices_are_rebuilt_when_too_many(vocabulary, monkeypatch):
    texts = [f"word{n} other{n}" for n in range(200)]
    want = [[tuple(s[0]) for s in row] for row in draw(texts, 2)]
    monkeypatch.setattr(pieces, "KEPT_UNITS", 10)
    assert [[tuple(s[0]) for s in row] for row in draw(texts, 2)] == want


def test_odd_rows_and_decoding(spark):
    table = docs(spark, odd_texts())
    encoded = pieces.encode(table)
    assert encoded.count() == len(odd_texts()) and pieces.encode(docs(spark, [])).count() == 0
    first = pieces.decode(encoded.select("id", F.get("samples", F.lit(0))["ids"].alias("ids")))
    assert sorted(map(repr, ((r.id, r.text) for r in first.collect()))) == sorted(map(repr, odd_texts()))
