import math
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest

from corpora import docs, key, odd_texts
from hitlytics.llm import lm, queries, texts
from pyspark.sql import functions as F


def brute_words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()


def brute_base(rows, held):
    counts = Counter(w for (i, t), h in zip(rows, held) if not h for w in [*brute_words(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for (i, t), h in zip(rows, held):
        tokens = [*brute_words(t), None]
        out.append((i, h, len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)))
    return out


def slow_share(model, pairs, before, target):
    if model.begins[target]:
        return model.share[-1, target]
    size = len(model.class_of)
    return pairs.get(before * size + target, model.share[model.bucket_of[before], target] + model.left[before, model.class_of[target]])


def slow_score(model, ids):
    """Every position by itself, as the definition says."""
    p = model.parameters
    end = len(model.symbol) - 1
    symbols = model.symbol[[end, *ids[:-1]]]
    total, pairs = 0.0, dict(zip(model.pairs.tolist(), model.pair_share.tolist()))
    for at, target in enumerate(ids):
        first = max(0, at // lm.SCORED * lm.SCORED - lm.CONTEXT)
        e = p["e"][symbols[first:at + 1]].astype(float)
        q, k, v = e[-1] @ p["q"], e @ p["k"], e @ p["v"]
        a = np.exp(k @ q / math.sqrt(lm.WIDTH) + p["b"][at - np.arange(first, at + 1)])
        h = np.maximum(a / a.sum() @ v @ p["o"] + e[-1] @ p["s"], 0)
        logits = h @ p["u"] + p["c"]
        before = end if at == 0 else ids[at - 1]
        total += logits[model.class_of[target]] - np.log(np.exp(logits).sum()) + slow_share(model, pairs, before, target)
    return total / math.log(10)


def shards(table, n_bytes=1):
    return lm.sample(table.select(F.col("doc_id").alias("id"), "text"), table.count(), n_bytes, lm.VOCABULARY)


@pytest.fixture
def model(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 30)
    table = docs(spark, odd_texts())
    return lm.fit(shards(table), lm.word_counts(table), len(odd_texts()), lm.VOCABULARY)


def test_batched_windows_equal_single_positions(model):
    coder = lm.subwords(lm.VOCABULARY)
    rows = [lm.words_of(t) for _, t in odd_texts() if t is None or len(t) < 3000]
    ids, starts = coder.sequences(rows)
    found = model.log10(ids, starts)
    for n in range(len(rows)):
        own = ids[starts[n]:starts[n + 1]].tolist()
        assert own[-1] == coder.end and [i for w in rows[n] for i in coder.split(w)] == own[:-1]
        assert found[n] == pytest.approx(slow_score(model, own), rel=1e-3, abs=1e-2)


def test_shares_sum_to_one_in_every_class(model):
    for bucket in (0, 5, len(model.share) - 1):
        sums = np.bincount(model.class_of, np.exp(model.share[bucket].astype(float)), lm.CLASSES)
        assert np.allclose(sums[np.unique(model.class_of)], 1, atol=1e-3)


@pytest.mark.parametrize("text", ["", "of", "The idiot of", "über çed", "日本 the thin"])
def test_probabilities_of_all_next_subwords_sum_to_one(model, text):
    coder = lm.subwords(lm.VOCABULARY)
    before = [i for w in lm.words_of(text) for i in coder.split(w)]
    rows = np.column_stack([np.tile(np.array(before, np.int32), (coder.size, 1)), np.arange(coder.size, dtype=np.int32)])
    found = model.log10(rows.ravel(), np.arange(coder.size + 1) * rows.shape[1])
    so_far = model.log10(np.array(before, np.int32), np.array([0, len(before)]))[0] if before else 0.0
    assert (10 ** (found - so_far)).sum() == pytest.approx(1, abs=2e-3)


def test_no_class_holds_first_and_inner_subwords(model):
    first, inner = np.unique(model.class_of[model.begins]), np.unique(model.class_of[~model.begins])
    assert len(first) > 1 and len(inner) > 1 and not set(first.tolist()) & set(inner.tolist())


def test_pairs_equal_counts_and_shares_after_a_subword_sum_to_one(spark, model, monkeypatch):
    coder = lm.subwords(lm.VOCABULARY)
    counts = Counter()
    for _, text in odd_texts():
        for word in lm.words_of(text):
            found = [coder.size, *coder.split(word)]
            counts.update(a * coder.size + b for a, b in zip(found, found[1:]))
    for gathered in (1, lm.GATHERED):
        monkeypatch.setattr(lm, "GATHERED", gathered)
        assert {r.code: r.n for r in lm.pair_counts(lm.word_counts(docs(spark, odd_texts())), lm.VOCABULARY).collect()} == counts
    pairs = dict(zip(model.pairs.tolist(), model.pair_share.tolist()))
    assert set(pairs) == {c for c in counts if c < coder.size ** 2}
    inner = np.flatnonzero(~model.begins)
    for before in {c // coder.size for c in list(pairs)[:5]} | {coder.end}:
        whole = np.array([pairs.get(before * coder.size + t, model.share[model.bucket_of[before], t] + model.left[before, model.class_of[t]])
                          for t in range(coder.size)])
        sums = np.bincount(model.class_of, np.exp(whole), lm.CLASSES)
        assert np.allclose(sums[np.unique(model.class_of)], 1, atol=1e-3)
        assert np.allclose(model.shares(np.full(len(inner), before), inner), whole[inner], atol=1e-5)


def test_few_pairs_have_a_share_of_their_own(spark, monkeypatch):
    words = lm.word_counts(docs(spark, odd_texts()))
    pairs = lm.pair_counts(words, lm.VOCABULARY)
    size = lm.subwords(lm.VOCABULARY).size
    every = dict(zip(*(x.tolist() for x in lm.frequent_pairs(pairs, size))))
    monkeypatch.setattr(lm, "PAIRS", 20)
    codes, counts = lm.frequent_pairs(pairs, size)
    assert len(codes) < 20 and dict(zip(codes.tolist(), counts.tolist())) == {c: n for c, n in every.items() if n * 20 > sum(every.values())}


@pytest.mark.parametrize("n_bytes", [1, 3 * lm.SHARD_BYTES])
def test_training_lowers_the_loss(spark, monkeypatch, n_bytes):
    """In one shard, and averaged over three."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    rows = [lm.words_of(r.text) for r in table.select("text").collect()]
    ids, starts = lm.subwords(lm.VOCABULARY).sequences(rows)
    dealt, words = shards(table, n_bytes), lm.word_counts(table)
    assert dealt.rdd.getNumPartitions() == (1 if n_bytes == 1 else 3)
    monkeypatch.setattr(lm, "STEPS", 200)
    model = lm.fit(dealt, words, len(rows), lm.VOCABULARY)
    untrained = replace(model, parameters=lm._views(lm._start())[0])
    assert model.log10(ids, starts).sum() > untrained.log10(ids, starts).sum() + 0.1 * len(ids)


def test_training_documents_grow_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_DOCS", 10)
    table = spark.range(8000).select("id", F.concat(F.lit("a few words and number "), "id").alias("text"))
    for n in (2000, 8000):
        part = table.filter(F.col("id") < n)
        assert 0.7 < lm.sample(part, n, 50 * n, lm.VOCABULARY).count() * 32 / n < 1.3
    few = table.filter("id < 40")
    assert 3 <= lm.sample(few, 40, 2000, lm.VOCABULARY).count() <= 20


def test_neighbour_counts_equal_brute_force(spark):
    table = docs(spark, odd_texts())
    counts = np.bincount(np.concatenate([np.array(r.ids) for r in shards(table).collect()]), minlength=lm.subwords(lm.VOCABULARY).size)
    often, marks = lm._frequent(counts)
    found, want = lm.neighbour_counts(shards(table), counts), Counter()
    for r in shards(table).collect():
        padded = [counts.size - 1, *r.ids]
        for a, b in zip(padded, padded[1:]):
            want[b, a, 0] += 1
            want[a, b, 1] += 1
    inner = [m for m in range(len(marks)) if marks[m] != counts.size - 1]  # the start of a row may follow that of another
    for i, o in enumerate(often):
        assert found[i, inner].tolist() == [want[o, marks[m], 0] for m in inner]
        assert found[i, [len(marks) + m for m in inner]].tolist() == [want[o, marks[m], 1] for m in inner]


@pytest.mark.parametrize("frequent", [20, 1 << 20])
def test_base_equals_brute_force(spark, monkeypatch, frequent):
    """With few frequent words most go through the join, with many none."""
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "STEPS", 2)
    rows = odd_texts()
    table = docs(spark, rows)
    held = texts.remainder(F.col("doc_id"), 7) == 2
    marks = {r.doc_id: r.h for r in table.select("doc_id", held.alias("h")).collect()}
    found = lm.score(table, held).collect()
    want = brute_base(rows, [marks[i] for i, _ in rows])
    shown = lambda r: key((*r[:5], round(r[5], 6)))
    assert sorted(shown(tuple(r)[:6]) for r in found) == sorted(map(shown, want))
    assert all(r.score < 0 for r in found)


def test_whole_table_equals_brute_force(spark, sf_dir):
    found = queries.attention_scores(spark, sf_dir).toPandas().sort_values("doc_id")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    want = brute_base(rows, found.held_out.tolist())
    assert found.n_tokens.tolist() == [w[2] for w in want] and found.n_known.tolist() == [w[3] for w in want]
    assert set(found.train_tokens) == {want[0][4]} and np.allclose(found.base_score, [w[5] for w in want])
    held = found[found.held_out]
    assert held.score.sum() > 1.3 * held.base_score.sum()


def test_no_training_rows_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 2)
    table = docs(spark, [(1, "a b"), (2, None)])
    rows = lm.score(table, F.lit(True)).collect()
    assert [(r.n_known, r.train_tokens) for r in rows] == [(0, 0), (0, 0)] and all(r.score < 0 for r in rows)
    assert lm.score(docs(spark, []), F.lit(False)).count() == 0


def test_every_training_document_is_counted_and_trained_on(spark, monkeypatch):
    """Of 3000 documents, more than a sample for trials holds; each is in one round."""
    monkeypatch.setattr(lm, "STEPS", 2)
    table = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a few words and number "), "id").alias("text"))
    fit, seen = lm.fit, []
    monkeypatch.setattr(lm, "fit", lambda shards, *rest: seen.append(shards) or fit(shards, *rest))
    held = texts.remainder(F.col("doc_id"), 7) == 2
    assert lm.score(table, held).count() == 3000
    want = table.filter(~held).select(F.xxhash64("doc_id", "text").alias("key"))
    assert sorted(r.key for r in seen[0].collect()) == sorted(r.key for r in want.collect())
    parts = [part.count() for part in lm.rounds(seen[0])]
    assert sum(parts) == want.count() and min(parts) > 0.8 * want.count() / lm.ROUNDS


def test_packed_ids_are_read_back():
    rows = [[1, 50256, 7], [], [65535], []]
    ids, starts = np.concatenate([np.array(r, np.int32) for r in rows]), np.r_[0, np.cumsum([len(r) for r in rows])]
    for size in (1 << 16, 1 << 17):
        for low in range(5):
            found, at = lm._ids(lm._packed(ids, starts, size).slice(low), size)
            assert found.tolist() == ids[starts[low]:].tolist() and at.tolist() == (starts[low:] - starts[low]).tolist()


def test_products_in_blocks_equal_plain_ones():
    random = np.random.default_rng(3)
    for n in (3, 64):
        a, b = random.random((n, lm.SCORED, 5)), random.random((n, lm.SCORED, 4))
        assert np.allclose(lm._summed(a, b), a.reshape(-1, 5).T @ b.reshape(-1, 4))
        assert lm._blocks(a).shape[1] <= lm.BLOCK and np.array_equal(lm._blocks(a).reshape(a.shape), a)


@pytest.mark.parametrize("odd", [[], ["a ", "　b", "c\x1cd", " ", "e\u0085"]])
def test_words_split_together_equal_words_split_alone(odd):
    coder, words = lm.subwords(lm.VOCABULARY), ["house", "über", *odd, "日本,", "12%%", "don't", "x" * 3000]
    ids, sizes = coder.split_all(pa.array(words))
    assert [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])] == [coder.split(w.encode()) for w in words]
    assert [len(x) for x in coder.split_all(pa.array([], pa.string()))] == [0, 0]


def test_different_words_of_a_chunk_are_split_in_one_call(monkeypatch):
    coder, calls = lm.subwords(lm.VOCABULARY), []
    encode = coder._encode
    monkeypatch.setattr(coder, "_encode", lambda text: calls.append(text) or encode(text))
    rows = ["The cat, the cat", None, "", "the DOG cat,"]
    ids, starts = coder.of_words(lm.Words(pa.array(rows)))
    assert len(calls) == 1 and sorted(calls[0].split()) == ["cat", "cat,", "dog", "the"]
    want = [[i for w in lm.words_of(t) for i in coder.split(w)] + [coder.end] for t in rows]
    assert [part.tolist() for part in np.split(ids, starts[1:-1])] == want


def test_chunks_hold_every_row_once_and_few_bytes(monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 10)
    rows = ["12345678901234567890", None, "1234", "1234", "1234", "", "123456789", "1"]
    found = [c.column(0).to_pylist() for c in lm._chunks(iter([pa.RecordBatch.from_arrays([pa.array(rows)], ["text"])]), 0)]
    assert [t for c in found for t in c] == rows and all(sum(len(t or "") for t in c[1:]) < 10 for c in found)
    assert list(lm._chunks(iter([pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["text"])]), 0)) == []


def test_one_odd_word_leaves_the_others_together(monkeypatch):
    coder, calls = lm.subwords(lm.VOCABULARY), []
    encode = coder._encode
    monkeypatch.setattr(coder, "_encode", lambda text: calls.append(text) or encode(text))
    words = ["cat", "a\u00a0", "dog", "house"]
    ids, sizes = coder.split_all(pa.array(words))
    assert sorted(calls) == [" a\u00a0", " cat dog house"]
    assert [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])] == [coder.split(w.encode()) for w in words]
