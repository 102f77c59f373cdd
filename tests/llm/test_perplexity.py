import random
from collections import Counter

import numpy as np
import pytest

from corpora import docs, odd_texts, sentence
from hitlytics.llm import perplexity, queries

SPACE = " \t\n\x0b\x0c\r"


def split(text):
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(text):
    text = text or ""
    words = split(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if split(x)]
    repeated = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(hit)


def test_measures_equal_brute_force():
    rng = random.Random(2)
    for _, text in odd_texts():
        if len(text or "") < 10_000:
            assert perplexity.measures(text) == brute(text)
    for _ in range(300):
        text = "".join(rng.choice("ab é#|\n\t\x1c ") for _ in range(rng.randrange(80)))
        assert perplexity.measures(text) == brute(text)


def test_probabilities_of_every_context_sum_to_one():
    rng = random.Random(3)
    found = Counter(c for _ in range(30) for c in perplexity.codes(sentence(rng, 50)).tolist())
    model = perplexity.KneserNey(np.array(list(found)), np.array(list(found.values())))
    size = perplexity.SYMBOLS
    seen = [c // size for c in list(found)[:30]]
    for context in [*seen, 0, size ** 3 - 1, 777]:
        total = np.exp(model.log_probability(context * size + np.arange(size))).sum()
        assert abs(total - 1) < 1e-4, context


def test_counts_equal_brute_force(spark):
    table = docs(spark, odd_texts())
    want = Counter(c for _, t in odd_texts() if t for c in perplexity.codes(t).tolist())
    assert {r.code: r.n for r in perplexity.count(table).collect()} == want


def test_noise_is_rejected_and_prose_kept(spark):
    rng = random.Random(4)
    letters = "".join(c for c in "qxzjkvwy#%")
    prose = [(n, sentence(rng, 120)) for n in range(1, 400, 2)]
    noise = [(1001 + 2 * n, " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(120))) for n in range(3)]
    rows = {r.id: r for r in perplexity.filtered(docs(spark, prose + noise)).collect()}
    assert all(rows[i].kept for i, _ in prose) and not any(rows[i].kept for i, _ in noise)
    assert not any(rows[i].base_failed for i, _ in noise)


def test_noise_in_another_script_is_rejected(spark):
    rng = random.Random(5)
    greek = lambda text: "".join(chr(0x3B1 + ord(c) - 97) if "a" <= c <= "z" else c for c in text)
    prose = [(n, greek(sentence(rng, 120))) for n in range(1, 300, 2)]
    noise = [(1001 + 2 * n, " ".join("".join(rng.choice("βψωζχ") for _ in range(6)) for _ in range(120))) for n in range(3)]
    rows = {r.id: r for r in perplexity.filtered(docs(spark, prose + noise)).collect()}
    assert np.mean([rows[i].kept for i, _ in prose]) > 0.97 and not any(rows[i].kept for i, _ in noise)


def test_bands_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab") * 2, rng.gauss(2, 0.3), rng.randrange(100, 9000), 60, 0) for _ in range(500)] + [("bb", 90.0, 10, 3, 0), ("c", 1.0, 50, 2, 0)]
    found = {r.lang: r for r in perplexity.bands(spark.createDataFrame(
        rows, "lang string, log_perplexity double, n_units long, n_words long, n_repeat_words long")).collect()}
    assert set(found) == {"aa", "bb"}  # no document of "c" passes the base rules
    for lang in found:
        value, size = (np.array([r[c] for r in rows if r[0] == lang and r[3] >= 50]) for c in (1, 2))
        off = np.abs(value - np.median(value))
        long = size >= np.median(size)
        assert abs(found[lang].middle - np.median(value)) < 5e-3
        assert abs(found[lang].own / (1.4826 * np.median(off * np.sqrt(size))) - 1) < 5e-2
        assert abs(found[lang].between / (1.4826 * np.median(off[long])) - 1) < 5e-2


def test_odd_rows(spark):
    rows = perplexity.filtered(docs(spark, odd_texts())).collect()
    assert len(rows) == len(odd_texts()) and all(r.base_failed for r in rows if r.n_words < 50)
    assert perplexity.filtered(docs(spark, [])).count() == 0


def test_whole_table(spark, sf_dir):
    found = queries.perplexity_rules(spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    good = found.merge(labels[labels.quality == 1])
    assert good[~good.base_failed].kept.mean() > 0.97
    assert not (found.kept & found.base_failed).any()


def test_most_poor_texts_leave_the_band(spark, sf_dir):
    """On the larger table: the smallest has only six poor texts that pass the base rules."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    found = queries.perplexity_rules(spark, sf_dir).toPandas().merge(labels)
    found = found[~found.base_failed]
    assert found[found.quality == 0].kept.mean() < 0.5 and found[found.quality == 1].kept.mean() > 0.97


def test_units_tell_all_characters_apart():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c) == chr(c).lower() and chr(c) not in perplexity.SIGNS[1:]]
    found = perplexity.units("".join(map(chr, points)))
    assert found.max() < perplexity.SYMBOLS
    single = found[found < perplexity.SINGLE]
    pairs = found[found >= perplexity.SINGLE].reshape(-1, 2)
    assert len(np.unique(single)) == len(single) and len(np.unique(pairs, axis=0)) == len(pairs) and len(single) + len(pairs) == len(points)
    assert not set(pairs[:, 0].tolist()) & set(pairs[:, 1].tolist())
    # Formerly of one class each: digits, other ASCII, letters eight code points apart, letters beyond two bytes.
    for a, b in (("1", "2"), ("@", "_"), (" ", "\n"), ("\u00e0", "\u00e8"), ("\u4e00", "\u4e04"), ("\U0001f600", "\U0001f601")):
        assert perplexity.codes(a).tolist() != perplexity.codes(b).tolist()


@pytest.mark.parametrize("frequent", [50, perplexity.FREQUENT])
def test_log_perplexities_equal_the_model_in_memory(spark, monkeypatch, frequent):
    """With few frequent n-grams most go through the join."""
    monkeypatch.setattr(perplexity, "FREQUENT", frequent)
    rows = [(i, t if t is None else t[:20_000]) for i, t in odd_texts()] + [(9001, "\u65e5\u672c\u8a9e \U0001f600 123 a#b")]
    found = Counter(c for _, t in rows if t for c in perplexity.codes(t).tolist())
    model = perplexity.KneserNey(np.array(list(found)), np.array(list(found.values())))
    table = docs(spark, rows)
    got = sorted((r.id, round(r.log_perplexity, 5), r.n_units) for r in perplexity.assess(table, perplexity.learn(table)).collect() if r.id is not None)
    want = sorted((i, round(-model.log_probability(perplexity.codes(t)).mean(), 5), len(perplexity.codes(t))) for i, t in rows if i is not None)
    assert [(g[0], g[2]) for g in got] == [(w[0], w[2]) for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=2e-5)
