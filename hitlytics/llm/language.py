"""Language identification by multilingual mixture inference.

A text's letter trigrams are draws from a mixture of languages. Expectation-maximisation estimates the proportions from
the languages' trigram distributions; the set of languages is chosen by a likelihood penalised for its size, dropping
the least one as long as that does not cost more than it saves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitlytics.llm import texts

BUCKETS = 1 << 16
#: Languages whose counts a counting task gathers before it passes them on.
GATHERED = 200
SMOOTHING = 0.5
FIRST_STEPS, NEXT_STEPS = 12, 6
#: Trigrams overlap: so many count as one independent draw.
OVERLAP = 3
UNDETERMINED = "und"

#: Letters a-z are 1 to 26, bytes of other scripts 27 to 154, all else 0.
_CLASS = np.zeros(256, np.uint32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around every letter of the rows, and where each row's buckets start."""
    data, offsets = texts.flat(pc.utf8_lower(column.cast(pa.large_string())))
    own = _CLASS[data]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    inner = offsets[(offsets > 0) & (offsets < len(own))]
    before[inner], after[inner - 1] = 0, 0
    code = (before * np.uint32(155) + own) * np.uint32(155) + after
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)
    letter = own > 0
    return bucket[letter], np.r_[0, np.cumsum(letter)][offsets]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(found[at])],
                                             ["lang", "bucket", "n"])

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        bucket, starts = trigrams(batch.column(1))
        row = np.repeat(np.arange(len(langs)), np.diff(starts))
        for lang in set(langs):
            if lang not in counts and len(counts) >= GATHERED:  # bounds the task's memory; sums are added up later
                yield from rows()
                counts.clear()
            found = np.bincount(bucket[(langs == lang)[row]], minlength=BUCKETS)
            counts[lang] = counts[lang] + found if lang in counts else found
    yield from rows()


@dataclass(frozen=True)
class Languages:
    """What was learned, by bucket: languages and probabilities of bucket b lie from starts[b] to starts[b + 1].

    Its size follows the different pairs of bucket and language, whatever the number of documents.
    """

    names: list[str]
    starts: np.ndarray
    lang: np.ndarray
    probability: np.ndarray
    #: By language, the probability of a trigram that it never had.
    unseen: np.ndarray

    def likely(self, buckets: np.ndarray) -> np.ndarray:
        """Probability of each bucket in each language."""
        out = np.tile(self.unseen, (len(buckets), 1))
        size = self.starts[buckets + 1] - self.starts[buckets]
        at = np.repeat(self.starts[buckets] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out[np.repeat(np.arange(len(buckets)), size), self.lang[at]] = self.probability[at]
        return out


def learn(docs: DataFrame, lang_column: str = "lang", text_column: str = "text") -> Languages:
    """Trigram probabilities of every language from all rows with a language.

    Rows with a null language or text teach nothing; without any, there is no language.
    """
    rows = docs.filter(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text"))
    # As many rows as there are different pairs of language and bucket.
    found = rows.mapInArrow(_count_batches, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names, lang = np.unique(found["lang"].to_numpy(object), return_inverse=True)
    bucket, n = found["bucket"].to_numpy(np.int64), found["n"].to_numpy(np.float64)
    order = np.lexsort((lang, bucket))
    bucket, lang, n = bucket[order], lang[order], n[order]
    total = np.bincount(lang, n, len(names)) + SMOOTHING * BUCKETS
    return Languages(names.tolist(), np.searchsorted(bucket, np.arange(BUCKETS + 1)), lang.astype(np.int32),
                     ((n + SMOOTHING) / total[lang]).astype(np.float32), (SMOOTHING / total).astype(np.float32))


def _fit(counts: np.ndarray, likely: np.ndarray, shares: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    total = counts.sum()
    for _ in range(steps):
        shares = shares * ((counts / (likely @ shares)) @ likely) / total
    return shares, float(counts @ np.log(likely @ shares)) / OVERLAP


def proportions(counts: np.ndarray, likely: np.ndarray) -> np.ndarray:
    """Shares of the languages: counts of different trigrams, and their probability in each language.

    Languages that account for less than one trigram are dropped together, where that costs less than it saves.
    """
    chosen = np.arange(likely.shape[1])
    shares, value = _fit(counts, likely, np.full(len(chosen), 1 / len(chosen), np.float32), FIRST_STEPS)
    price = 0.5 * np.log(max(2.0, counts.sum() / OVERLAP))
    while len(chosen) > 1:
        keep = shares * counts.sum() >= 1
        if 1 < (~keep).sum() < len(keep):
            fewer, less = _fit(counts, likely[:, chosen[keep]], shares[keep] / shares[keep].sum(), NEXT_STEPS)
            if less + price * (~keep).sum() >= value:
                chosen, shares, value = chosen[keep], fewer, less
                continue
        keep = np.arange(len(chosen)) != shares.argmin()
        fewer, less = _fit(counts, likely[:, chosen[keep]], shares[keep] / max(shares[keep].sum(), 1e-30), NEXT_STEPS if keep.sum() > 1 else 0)
        if less + price < value:
            break
        chosen, shares, value = chosen[keep], fewer, less
    out = np.zeros(likely.shape[1])
    out[chosen] = shares / shares.sum()
    return out


def identify(docs: DataFrame, model: Languages, id_column: str = "doc_id", text_column: str = "text",
             passed: dict[str, Column] | None = None) -> DataFrame:
    """(id, lang_pred, score, mixture): the main language of each whole text, its share, and all chosen shares.

    Null texts and those without a letter, and all texts if nothing was learned, are `und` with score 0. A text whose
    trigrams fit all languages equally well gets the first of them. `passed` adds columns that are carried along.
    """
    langs, sent = model.names, docs.sparkSession.sparkContext.broadcast(model)
    passed = passed or {}
    types = {n: docs.select(c.alias(n)).schema[n].dataType.simpleString() for n, c in passed.items()}

    names_passed = list(passed)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in rows:
            bucket, starts = trigrams(batch.column(1))
            names, scores, mixtures = [], [], []
            for n, letters in enumerate(batch.column(2).to_pylist()):
                shares = np.zeros(0)
                if letters and langs:
                    own, counts = np.unique(bucket[starts[n]:starts[n + 1]], return_counts=True)
                    shares = proportions(counts.astype(np.float32), known.likely(own.astype(np.int64))) if len(own) else np.full(len(langs), 1 / len(langs))
                best = int(shares.argmax()) if len(shares) else -1
                names.append(langs[best] if best >= 0 else UNDETERMINED)
                scores.append(min(1.0, float(shares[best])) if best >= 0 else 0.0)
                mixtures.append([(langs[i], float(shares[i])) for i in np.flatnonzero(shares)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[3:], pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(mixtures, pa.map_(pa.string(), pa.float64()))],
                ["id", *names_passed, "lang_pred", "score", "mixture"])

    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"),
                         F.coalesce(F.col(text_column).rlike(r"\p{L}"), F.lit(False)).alias("letters"), *[c.alias(n) for n, c in passed.items()])
    carried = "".join(f"{n} {t}, " for n, t in types.items())
    return chosen.mapInArrow(batches, f"id {texts.kind(docs, id_column)}, {carried}lang_pred string, score double, mixture map<string,double>")
