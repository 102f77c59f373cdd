import random
import re

import duckdb
import pytest

from corpora import docs, odd_texts, sentence
from hitlytics.llm import decontaminate, oracle, queries
from pyspark.sql import functions as F


def brute_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, items):
    words, hit, names = brute_words(text), set(), set()
    for item, passage in items:
        own = brute_words(passage)
        if not own:
            continue
        size = min(13, len(own))
        for i in range(len(own) - size + 1):
            for at in range(len(words) - size + 1):
                if words[at:at + size] == own[i:i + size]:
                    hit |= set(range(at, at + size))
                    names.add(None if item is None else str(item))
    return len(words), len(hit), sorted(names, key=lambda n: (n is None, n))


@pytest.fixture
def corpus(spark):
    rng = random.Random(8)
    items = [(1, sentence(rng, 30)), (2, sentence(rng, 13)), (3, "Short item HERE"), (4, ""), (5, None), (None, sentence(rng, 20)), (3, "short, item; here"), (30, "ü")]
    texts = [*odd_texts(), (40, "so a Short-item here and short item here"), (41, items[0][1]), (42, sentence(rng, 50) + " " + items[0][1][40:] + ", " + items[1][1]), (43, items[1][1] + " x " + items[1][1]),
             (44, "it " + items[5][1] + " " + items[1][1])]
    return docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), texts, items


@pytest.mark.parametrize("block", [5, 500_000])
def test_scan_equals_brute_force_in_any_number_of_blocks(corpus, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
    table, bench, texts, items = corpus
    found = decontaminate.scan(table, bench).select("id", "n_words", decontaminate.n_hit().alias("h"), "items").collect()
    want = [(i, *brute(t, items)) for i, t in texts]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def test_removal_of_documents_and_of_spans(corpus):
    table, bench, texts, items = corpus
    judged = {i: brute(t, items) for i, t in texts}
    bad = {i for i, (n, h, _) in judged.items() if i is not None and h and 20 * h >= n}
    left = decontaminate.removed(table, bench)
    assert left.columns == table.columns and {r.doc_id for r in left.collect()} == set(judged) - bad
    cut = {r.doc_id: r.text for r in decontaminate.removed(table, bench, spans=True).collect()}
    assert len(cut) == len(judged) and brute(cut[41], items)[1] == 0 and cut[14] == dict(texts)[14]
    assert cut[40].startswith("so a ") and "tem" not in cut[40]


def test_items_without_an_id_hit_as_well(corpus):
    table, bench, texts, items = corpus
    found = decontaminate.scan(table, bench).filter("id = 44").select(decontaminate.n_hit(), "items").first()
    assert tuple(found) == (33, ["2", None])


def test_rows_of_one_id_are_cut_one_by_one(spark, corpus):
    _, bench, _, items = corpus
    texts = ["before " + items[0][1] + " after", "clean", items[1][1], None, ""]
    table = spark.createDataFrame([(7, t, "x", 1, [n]) for n, t in enumerate(texts)], "doc_id long, text string, spans string, `id.c0` int, items array<int>")
    left = decontaminate.removed(table, bench, spans=True)
    assert left.columns == table.columns and left.dtypes == table.dtypes
    assert {r["items"][0]: r["text"].split() if r["text"] else r["text"] for r in left.collect()} == {
        0: ["before", "after"], 1: ["clean"], 2: "", 3: None, 4: ""}
    assert {tuple(r)[2:4] for r in left.collect()} == {("x", 1)}


def test_empty_tables(spark, corpus):
    table, bench, texts, _ = corpus
    assert decontaminate.scan(docs(spark, []), bench).count() == 0
    assert decontaminate.scan(table, bench.limit(0)).filter(F.size("items") > 0).count() == 0


def test_table_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({oracle.BENCHMARK_WINDOWS})").fetchall()
    found = queries.benchmark_windows(spark, sf_dir).select(columns).collect()
    assert sorted(map(tuple, found)) == sorted(want) and any(w[5] for w in want)
