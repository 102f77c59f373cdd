"""A corpus pipeline of five stages; each is written and read again before the next.

Toxic documents go, one document of each near-duplicate group stays, contaminated documents go, personal data is replaced,
and what is left is encoded. Every row is judged for itself, whatever its doc_id: ids may be absent or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlytics import session
from hitlytics.llm import decontaminate, pieces, pii, simhash, texts, toxicity

#: The toxicity model is not expressible in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity, learned from the labels of these documents, is below the threshold."""
    labels = texts.table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, texts.remainder(F.col("doc_id"), 5) != 0)
    return docs.filter(toxicity.probability(spark, model, docs["text"]) < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the smallest doc_id, rows without one last; of several, any one of them."""
    texts.prepare(spark)
    # Row numbers are written, so that both reads see the same ones.
    rows = session.written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc"), F.col("__row").alias("row"))
    found = simhash.near_duplicates(rows.select(key.alias("id"), "text"), "id")
    gone = found.filter(F.col("id.row") != F.col("component.row")).select(F.col("id.row").alias("__row"))
    return rows.join(gone, "__row", "left_anti").select(*[F.col(f"`{n}`") for n in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than a twentieth lie in windows of the benchmark; they stay as they are."""
    return decontaminate.removed(docs, texts.table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, n_chars brought up to date."""
    texts.prepare(spark)
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document."""
    texts.prepare(spark)
    return pieces.encode(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("sampled_pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written to the shared folder and read again."""
    docs = texts.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = session.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
