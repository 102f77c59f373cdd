"""Every stage of the pipeline against brute force, and the rule that nothing else imports the subpackage."""

import importlib.util
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from hitlytics.llm import decontaminate, pieces, pii, simhash, texts, toxicity
from pyspark.sql import functions as F

from corpora import docs, odd_texts
from test_decontaminate import brute as brute_hits
from test_simhash import brute_components, brute_print

ROOT = Path(corpus_pipeline.__file__).parent
STAGED = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf_dir = STAGED
    out, table = [], spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, table, sf_dir).write.parquet(path)
        before, table = table, spark.read.parquet(path)
        out.append((before.toPandas(), table.toPandas()))
    return out


def test_stages_keep_the_columns(spark, sf_dir, stages):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").dtypes
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "personal_data", "sampled_pieces"]
    assert all(list(after.columns) == [c for c, _ in columns] for _, after in stages[:-1])


def test_toxic_documents_go(spark, stages):
    (before, after), sf_dir = stages[0], STAGED
    model = toxicity.train(texts.table(spark, sf_dir, "documents"), texts.table(spark, sf_dir, "labels"), texts.remainder(F.col("doc_id"), 5) != 0)
    toxic = {i for i, t in zip(before.doc_id, before.text) if model.document(t)[0] >= 0.5}
    assert toxic and set(after.doc_id) == set(before.doc_id) - toxic


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    names = brute_components(before.doc_id.tolist(), [brute_print(t) for t in before.text])
    assert sorted(after.doc_id) == sorted(set(names)) and len(after) < len(before)


def test_contaminated_documents_go(spark, stages):
    (before, after), sf_dir = stages[2], STAGED
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    block = decontaminate.Block([(str(i), w.decode()) for i, t in items for w in dict.fromkeys(decontaminate.windows_of(decontaminate.words_of(t)))])
    gone = set()
    for i, text in zip(before.doc_id, before.text):
        words = decontaminate.words_of(text)
        hit = {at for a, z, _ in block.hits(words) for at in range(a, z)}
        if hit and 20 * len(hit) >= len(words):
            gone.add(i)
            assert len(text) > 20_000 or brute_hits(text, items)[1] == len(hit)
    assert gone and set(after.doc_id) == set(before.doc_id) - gone


def test_personal_data_is_replaced(stages):
    before, after = stages[3]
    want = {i: pii.redacted(t, pii.find(t)) for i, t in zip(before.doc_id, before.text)}
    assert dict(zip(after.doc_id, after.text)) == want and any(want[i] != t for i, t in zip(before.doc_id, before.text))
    assert (after.n_chars == after.text.str.len()).all()


def test_samples_decode_to_the_texts(stages):
    before, after = stages[4]
    table = dict(zip(before.doc_id, before.text))
    vocabulary = pieces.vocabulary(pieces.VOCABULARY)
    assert set(after.doc_id) == set(table)
    assert all(vocabulary.decode(list(s["ids"])) == table[i] for i, samples in zip(after.doc_id, after.samples) for s in samples)


def test_odd_rows_pass_every_stage(spark, sf_dir):
    for rows in (odd_texts(), []):
        table = docs(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, table, sf_dir)
            assert after.columns == table.columns
            table = spark.createDataFrame(after.collect(), after.schema)
        kept = {r.doc_id for r in table.collect()}
        assert kept >= ({9, 10, 14} if rows else set()) and not kept & {2, 5, 6}
        assert corpus_pipeline.STAGES[-1][1](spark, table, sf_dir).count() == table.count()


def test_one_row_of_each_group_stays_whatever_its_id(spark, sf_dir):
    x, y, z, w = (" ".join(f"{c}{n}" for n in range(80)) for c in "xyzw")
    rows = [(7, x), (9, x), (7, y), (3, y), (5, z), (5, z), (None, z), (None, w), (None, w), (None, "all alone here")]
    table = docs(spark, rows)
    found = corpus_pipeline.drop_near_duplicates(spark, table, sf_dir)
    assert found.columns == table.columns
    assert sorted((r.doc_id or 0, r.text) for r in found.collect()) == sorted([(7, x), (3, y), (5, z), (0, w), (0, "all alone here")])


def test_contaminated_rows_go_whatever_their_id(spark, sf_dir):
    passage = next(r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if len(r.text.split()) > 20)
    table = docs(spark, [(None, passage), (None, "clean words"), (4, passage), (4, "more clean words"), (5, None)])
    found = corpus_pipeline.drop_contaminated(spark, table, sf_dir)
    assert found.dtypes == table.dtypes
    assert {(r.doc_id, r.text) for r in found.collect()} == {(None, "clean words"), (4, "more clean words"), (5, None)}


def test_run_equals_its_stages(spark, stages):
    assert corpus_pipeline.run(spark, STAGED).count() == len(stages[-1][1])


def test_nothing_else_needs_the_subpackage():
    for path in [*ROOT.glob("hitlytics/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py", ROOT / "check_oracle.py"]:
        if "llm" not in path.parts:
            assert "hitlytics.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
    code = ("import sys; sys.modules['hitlytics.llm'] = None\n"
            "class Gone:\n def find_spec(self, name, *a):\n  if name in ('corpus_pipeline', 'hitlytics.llm'): raise ModuleNotFoundError(name=name)\n"
            "sys.modules.pop('hitlytics.llm'); sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); e.oracle_sql()")
    assert importlib.util.find_spec("corpus_pipeline")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
