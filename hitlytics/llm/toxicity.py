"""Toxicity by multiple-instance learning: labels mark documents, the model scores sentences.

A document is toxic if any of its sentences is: its probability is the noisy-or of the sentences' and of a small share
that no sentence explains. A sentence is judged by words of a lexicon that is tested against the labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlytics.llm import texts

#: Labelled documents that the classifier is fitted on, whole, those with the smallest hash of their id.
SAMPLE_DOCS = 20_000
#: Words of the lexicon at most, those that tell most.
LEXICON_WORDS = 512
LEAST_DOCS = 3
STEPS, RATE, DECAY = 200, 0.1, 1e-3
THRESHOLD = 0.5

#: Lower-cases A-Z; sentence ends become line ends, other ASCII signs spaces, other bytes stay.
_SENTENCES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 10 if chr(b) in ".!?\n" else 32 for b in range(256))


def sentences(text: str | None) -> list[bytes]:
    """The sentences, normalised; they end at `.`, `!`, `?` and line ends."""
    return (text or "").encode().translate(_SENTENCES).split(b"\n")


@dataclass(frozen=True)
class Model:
    weights: dict[bytes, float]
    bias: float
    leak: float

    def sentence(self, words: set[bytes]) -> float:
        """Probability that a sentence is toxic; 0 without a word of the lexicon."""
        found = [self.weights[w] for w in words if w in self.weights]
        return 1 / (1 + math.exp(-max(-500.0, self.bias + sum(found)))) if found else 0.0

    def document(self, text: str | None) -> tuple[float, list[tuple[int, float]]]:
        """Probability of a document, and its suspicious sentences (number from 0, probability)."""
        clean, located = 1 - self.leak, []
        for n, sentence in enumerate(sentences(text)):
            words = sentence.split()
            if not self.weights.keys().isdisjoint(words):
                p = self.sentence(set(words))
                clean *= 1 - p
                if p >= THRESHOLD:
                    located.append((n, p))
        return 1 - clean, located


def _labelled(docs: DataFrame, labels: DataFrame, trained: Column) -> DataFrame:
    """(id, toxic, text) of a bounded number of labelled documents. Only ids are ranked; the texts stay where they are."""
    chosen = labels.filter(trained & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    chosen = chosen.select(F.col("doc_id").alias("id"), "toxic")
    # At most SAMPLE_DOCS rows of two numbers.
    return docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id")


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [sorted({w.decode() for s in sentences(t) for w in s.split()}) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["toxic", "words"])


def lexicon(sample: DataFrame) -> list[str]:
    """Words whose documents are labelled toxic more often than chance allows, by likelihood ratio over all words."""
    docs, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < docs:
        return []
    base = toxic / docs
    counts = sample.select("toxic", "text").mapInArrow(_word_batches, "toxic int, words array<string>").select(
        "toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).filter(
        F.col("n") >= LEAST_DOCS)
    term = lambda part, share: F.when(part > 0, part * F.log(part / F.col("n") / share)).otherwise(0.0)
    told = counts.withColumn("ratio", 2 * (term(F.col("k"), F.lit(base)) + term(F.col("n") - F.col("k"), F.lit(1 - base)))).filter(
        F.col("k") > base * F.col("n"))
    told = texts.checkpointed(told)
    tested = told.count()
    least = 2 * math.log(max(tested, 1)) + 3
    return [r["word"] for r in told.filter(F.col("ratio") >= least).orderBy(F.desc("ratio"), "word").limit(LEXICON_WORDS).collect()]


def _evidence(sample: DataFrame, words: list[str]) -> list:
    """Per document of the sample its label and the lexicon words of each sentence that has any."""
    number = {w.encode(): n for n, w in enumerate(words)}

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = []
            for text in batch.column(1).to_pylist():
                bags = {tuple(sorted({number[w] for w in s.split() if w in number})) for s in sentences(text)}
                found.append(sorted(bags - {()}))  # equal sentences tell nothing new
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.list_(pa.int32())))], ["toxic", "bags"])

    return sample.select("toxic", "text").mapInArrow(batches, "toxic int, bags array<array<int>>").collect()


def train(docs: DataFrame, labels: DataFrame, trained: Column) -> Model:
    """Fits the model on labelled documents that `trained` (a condition on labels) admits.

    Without labels, or with labels of one kind only, the score is the share of toxic ones. A document labelled more than
    once is toxic if any label says so; null labels and ids teach nothing.
    """
    sample = texts.checkpointed(_labelled(docs, labels, trained).select("id", "toxic", "text"))
    words = lexicon(sample)
    rows = _evidence(sample, words)
    y = np.array([r["toxic"] for r in rows], float)
    if not words:
        return Model({}, 0.0, float(y.mean()) if len(y) else 0.0)
    doc = np.array([d for d, r in enumerate(rows) for _ in r["bags"]], int)
    bags = [b for r in rows for b in r["bags"]]
    entry_bag, entry_word = np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.array([w for b in bags for w in b], int)
    theta = np.r_[np.ones(len(words)), -1.0, -3.0]
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, bias, leak = theta[:-2], theta[-2], 1 / (1 + np.exp(-theta[-1]))
        p = 1 / (1 + np.exp(-(bias + np.bincount(entry_bag, w[entry_word], len(bags)))))
        clean = (1 - leak) * np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)))
        toxic = np.clip(1 - clean, 1e-9, 1)
        # d loss / d log(clean): clean documents lose 1, toxic ones gain clean / toxic
        slope = np.where(y > 0, clean / toxic, -1.0)
        by_bag = -slope[doc] * p
        gradient = np.r_[np.bincount(entry_word, by_bag[entry_bag], len(words)) + DECAY * w, by_bag.sum(), (-slope * leak).sum()] / len(y)
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient ** 2
        theta -= RATE * first / (1 - 0.9 ** step) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-9)
    return Model({x.encode(): float(v) for x, v in zip(words, theta)}, float(theta[-2]), float(1 / (1 + np.exp(-theta[-1]))))


def probability(spark: SparkSession, model: Model, text: Column) -> Column:
    """The toxicity of a text column, for filters that keep rows where they are."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judged(column: pd.Series) -> pd.Series:
        return pd.Series([sent.value.document(None if pd.isna(t) else t)[0] for t in column], dtype=float)

    return judged(text)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score, sentences): toxicity of each whole text, and its offending sentences (number, probability).

    Null, empty and wordless texts have the score of a text without evidence. Repeated rows each give a row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [sent.value.document(t) for t in batch.column(1).to_pylist()]
            located = [[{"number": n, "score": p} for n, p in f[1]] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.float64()),
                 pa.array(located, pa.list_(pa.struct([("number", pa.int64()), ("score", pa.float64())])))], ["id", "score", "sentences"])

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        batches, f"id {texts.kind(docs, id_column)}, score double, sentences array<struct<number:long,score:double>>")
