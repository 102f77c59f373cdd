import numpy as np
import pyarrow as pa

from corpora import docs, odd_texts
from hitlytics.llm import language, queries


def brute_trigrams(text):
    data = text.lower().encode()
    own = [0, *[b - 96 if 97 <= b <= 122 else b - 101 if b >= 128 else 0 for b in data], 0]
    return [(((own[i - 1] * 155 + own[i]) * 155 + own[i + 1]) * 2654435761 % (1 << 32)) >> 16 for i in range(1, len(own) - 1) if own[i]]


def test_trigrams_cross_no_row():
    rows = ["ab", None, "", "ça va", "x", "12", "A long Row über"]
    bucket, starts = language.trigrams(pa.array(rows))
    for n, text in enumerate(rows):
        assert bucket[starts[n]:starts[n + 1]].tolist() == brute_trigrams(text or "")


def test_mixture_finds_both_languages():
    likely = np.array([[0.7, 0.1, 0.01], [0.2, 0.1, 0.01], [0.1, 0.8, 0.98]], np.float32)
    shares = language.proportions(np.array([350, 100, 450], np.float32), likely[:, :2])
    assert abs(shares[0] - 0.5) < 0.1
    assert language.proportions(np.array([70, 20, 10], np.float32), likely).tolist() == [1, 0, 0]


def test_held_out_accuracy(spark):
    found = queries.language_mixture(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    held = found.merge(truth)[lambda x: x.held_out]
    assert len(found) == len(truth) and (held.lang_pred == held.lang).mean() > 0.98
    assert found.score.between(0, 1).all()


def test_odd_rows_and_no_languages(spark):
    table = docs(spark, odd_texts())
    model = language.learn(table)
    assert model.names == ["en"]
    rows = language.identify(table, model).collect()
    assert len(rows) == len(odd_texts())
    letterless = {4, 5, 6, 12, 13}
    assert {r.id for r in rows if r.lang_pred == "und"} == letterless | {None}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    nothing = language.learn(docs(spark, [(2, "text")]))
    assert nothing.names == [] and language.identify(table, nothing).filter("lang_pred != 'und'").count() == 0
    assert language.identify(docs(spark, []), model).count() == 0


def test_many_languages_of_a_batch_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(language, "GATHERED", 2)
    langs, rows = ["a", "b", "c", "a", "d", "e"], ["abc", "über", "x y", "abc abc", "", "zz"]
    found = {}
    for part in language._count_batches(iter([pa.RecordBatch.from_arrays([pa.array(langs), pa.array(rows)], ["lang", "text"])])):
        assert len(set(part["lang"].to_pylist())) <= 1
        for lang, bucket, n in zip(*(part[c].to_pylist() for c in ("lang", "bucket", "n"))):
            found[lang, bucket] = found.get((lang, bucket), 0) + n
    want = {}
    for lang, text in zip(langs, rows):
        for bucket in brute_trigrams(text):
            want[lang, bucket] = want.get((lang, bucket), 0) + 1
    assert found == want


def test_probabilities_equal_brute_force(spark):
    rows = [("a", "abc abd"), ("b", "über 日本"), ("a", "abc"), ("c", "..."), (None, "x"), ("b", None)]
    model = language.learn(spark.createDataFrame(rows, "lang string, text string"))
    assert model.names == ["a", "b"]
    found = model.likely(np.arange(language.BUCKETS))
    want = np.full((language.BUCKETS, 2), language.SMOOTHING)
    for lang, text in rows[:3]:
        for bucket in brute_trigrams(text):
            want[bucket, "ab".index(lang)] += 1
    assert np.allclose(found, want / want.sum(0)) and np.allclose(found.sum(0, dtype=float), 1, atol=1e-4)


def test_hundreds_of_languages_and_scripts_are_all_learned(spark):
    """More languages than a counting task gathers; texts of two of them get both."""
    rng = np.random.default_rng(1)
    alphabet = np.array(list("abcdefghijklmnopqrstuvwxyzабвгдежзиклмнопрстуαβγδεζηθικλμνξοπ日本語中文"))
    lexicon = [["".join(rng.choice(alphabet, 5)) for _ in range(12)] for _ in range(260)]
    sentence = lambda n: " ".join(rng.choice(lexicon[n], 40))
    rows = [(f"l{n:03}", sentence(n)) for n in range(260) for _ in range(3)]
    model = language.learn(spark.createDataFrame(rows, "lang string, text string"))
    assert len(model.names) == 260
    asked = [(n, sentence(n)) for n in range(260)] + [(1000, sentence(7) + " " + sentence(9))]
    found = {r.id: r for r in language.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert all(found[n].lang_pred == f"l{n:03}" for n in range(260))
    assert set(found[1000].mixture) == {"l007", "l009"} and max(found[1000].mixture.values()) < 0.7


def brute_proportions(counts, likely):
    """Expectation-maximisation to its end for every set of languages; the set of best penalised likelihood."""
    from itertools import combinations

    best = None
    for size in range(1, likely.shape[1] + 1):
        for chosen in combinations(range(likely.shape[1]), size):
            part, shares = likely[:, chosen].astype(float), np.full(size, 1 / size)
            for _ in range(400):
                shares = shares * ((counts / (part @ shares)) @ part) / counts.sum()
            value = counts @ np.log(part @ shares) / language.OVERLAP - 0.5 * size * np.log(max(2.0, counts.sum() / language.OVERLAP))
            if best is None or value > best[0]:
                best = value, dict(zip(chosen, shares))
    return best[1]


def test_mixtures_equal_the_best_of_all_sets():
    rng = np.random.default_rng(3)
    likely = rng.dirichlet(np.full(200, 0.2), 4).T.astype(np.float32) + np.float32(1e-4)
    likely /= likely.sum(0)
    for truth in ([1, 0, 0, 0], [0.5, 0.5, 0, 0], [0, 0.6, 0, 0.4], [0.3, 0.3, 0.4, 0], [0.25] * 4):
        counts = rng.multinomial(3000, likely @ np.array(truth) / (likely @ np.array(truth)).sum()).astype(np.float32)
        own = counts > 0
        found = language.proportions(counts[own], likely[own])
        want = brute_proportions(counts[own], likely[own])
        assert set(np.flatnonzero(found)) == set(want)
        assert all(abs(found[n] - share) < 0.05 for n, share in want.items())
