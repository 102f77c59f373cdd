from pyspark.sql import functions as F

from corpora import docs, odd_texts
from hitlytics.llm import queries, texts, toxicity

LABELS = "doc_id long, quality int, toxic int, text string"


def test_noisy_or_and_location():
    model = toxicity.Model({b"idiot": 3.0, b"moron": 1.0}, -1.0, 0.1)
    p = 1 / (1 + 2.718281828459045 ** -2.0)
    score, found = model.document("Fine here. You IDIOT! fine\nnothing")
    assert abs(score - (1 - 0.9 * (1 - p))) < 1e-9 and found == [(1, found[0][1])]
    twice, _ = model.document("idiot. idiot")
    assert abs(twice - (1 - 0.9 * (1 - p) ** 2)) < 1e-9
    for text in (None, "", " . ! "):
        assert model.document(text) == (1 - 0.9, []) or abs(model.document(text)[0] - 0.1) < 1e-9


def test_learns_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    found = queries.toxic_documents(spark, sf_dir).toPandas()
    held = found[found.held_out].merge(texts.table(spark, sf_dir, "labels").toPandas())
    assert held[held.toxic == 1].predicted.mean() > 0.85 and held[held.toxic == 0].predicted.mean() < 0.02
    assert found.score.between(0, 1).all()


def test_odd_labels_and_rows(spark):
    table = docs(spark, odd_texts())
    labels = spark.createDataFrame([(1, 1, 1, "x"), (1, 1, 0, "x"), (2, 1, None, "x"), (None, 1, 1, "x"), (7, 0, 0, "x"), (99, 1, 1, "x")], LABELS)
    everything = F.lit(True)
    model = toxicity.train(table, labels, everything)
    rows = toxicity.score(table, model).collect()
    assert len(rows) == len(odd_texts()) and all(0 <= r.score <= 1 for r in rows)
    empty = toxicity.train(table, labels.limit(0), everything)
    assert empty.weights == {} and {r.score for r in toxicity.score(table, empty).collect()} == {0.0}
    assert toxicity.score(docs(spark, []), model).count() == 0
    assert toxicity.train(docs(spark, []), labels, everything).weights == {}


def test_labels_of_held_out_rows_teach_nothing(spark, sf_dir):
    table, labels = texts.table(spark, sf_dir, "documents"), texts.table(spark, sf_dir, "labels")
    trained = texts.remainder(F.col("doc_id"), 5) != 0
    flipped = labels.withColumn("toxic", F.when(trained, F.col("toxic")).otherwise(1 - F.col("toxic")))
    assert toxicity.train(table, labels, trained) == toxicity.train(table, flipped, trained)
