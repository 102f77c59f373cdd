"""Benchmark decontamination: token windows of a corpus are looked up in a broadcast hash set of test n-grams.

The set is broadcast in blocks of at most BLOCK_WINDOWS windows, one after another; rows are written with their hits
between blocks, so a larger benchmark costs more passes but no shuffle of texts and no more memory. Only runs of words that all occur in the block
are looked up, and a lookup compares the words themselves, not hashes alone.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlytics import session
from hitlytics.llm import texts

WINDOW_WORDS = 13
#: Windows of one broadcast block, about 200 bytes each.
BLOCK_WINDOWS = 500_000
#: A document is contaminated when at least one word in so many is hit.
CLEAN_SHARE = 20

#: Lower-cases A-Z and turns every ASCII byte but letters and digits into a space; other bytes stay.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

HITS = "n_words long, spans array<struct<first:long,last:long>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def windows_of(words: list[bytes]) -> Iterator[bytes]:
    """Runs of WINDOW_WORDS words; fewer words, but not none, are one window."""
    if words:
        for at in range(max(1, len(words) - WINDOW_WORDS + 1)):
            yield b" ".join(words[at:at + WINDOW_WORDS])


def windows(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item, window): the different windows of every item."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(dict.fromkeys(windows_of(words_of(text))))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array([w.decode() for w in found], pa.string())], ["item", "window"])

    return items.select(F.col(id_column).cast("string").alias("item"), F.col(text_column).alias("text")).mapInArrow(
        batches, "item string, window string").distinct()


class Block:
    """Windows by length and by their words' numbers, for lookups of word sequences."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.number: dict[bytes, int] = {}
        self.items: dict[int, dict[tuple[int, ...], list[str]]] = defaultdict(lambda: defaultdict(list))
        for item, window in rows:
            key = tuple(self.number.setdefault(w, len(self.number) + 1) for w in window.encode().split())
            self.items[len(key)][key].append(item)
        self.items = {n: dict(found) for n, found in self.items.items()}

    def hits(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """Verified occurrences: first word, one past the last, items with that window."""
        number = self.number.get
        numbers = [number(w, 0) for w in words]
        known = np.concatenate([[0], np.cumsum(np.array(numbers, np.int64) > 0)])
        for size, found in self.items.items():
            if len(words) >= size:
                for at in np.flatnonzero(known[size:] - known[:-size] == size).tolist():
                    if (items := found.get(tuple(numbers[at:at + size]))) is not None:
                        yield at, at + size, items


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], last)
        else:
            out.append((first, last))
    return out


def _scan(rows: DataFrame, block: Block, id_type: str, keep_text: bool) -> DataFrame:
    """Adds a block's hits to the spans and items found so far."""
    sent = rows.sparkSession.sparkContext.broadcast((block.number, block.items))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Block([])
        own.number, own.items = sent.value
        for batch in parts:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            counts, spans, items = [], [], []
            before = zip(column["spans"].to_pylist(), column["items"].to_pylist())
            for text, (old, seen) in zip(column["text"].to_pylist(), before):
                words = words_of(text)
                found = list(own.hits(words))
                counts.append(len(words))
                spans.append([{"first": a, "last": b} for a, b in _joined([(s["first"], s["last"]) for s in old] + [x[:2] for x in found])])
                items.append(sorted(set(seen).union(*(x[2] for x in found)), key=lambda i: (i is None, i)))
            arrays = [column["id"], *([column["text"]] if keep_text else []), pa.array(counts, pa.int64()),
                      pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", *(["text"] if keep_text else []), "n_words", "spans", "items"])

    return rows.mapInArrow(batches, f"id {id_type}, {'text string, ' if keep_text else ''}{HITS}")


def scan(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
         item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, spans, items): per row of `docs`, the word ranges hit and the items (as text, sorted) that hit them.

    Null and empty texts have no words and no hits. Items without words are left out; items repeated under one id count
    once, and so do those without an id, which stand last, as null. An empty benchmark gives rows without hits. Each row of
    `docs` is judged for itself.
    """
    found = texts.checkpointed(windows(items, item_id, item_text))
    total = found.count()
    n_blocks = max(1, -(-total // BLOCK_WINDOWS))
    id_type = texts.kind(docs, id_column)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"),
                       F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<first:long,last:long>>)").alias("spans"),
                       F.expr("cast(array() as array<string>)").alias("items"))
    for n in range(n_blocks):
        # A window and all its items stay in one block; distinct (item, window) pairs bound its size.
        part = found.filter(F.pmod(F.xxhash64("window", "item"), F.lit(n_blocks)) == n).select("item", "window").collect()
        rows = _scan(rows, Block([tuple(r) for r in part]), id_type, n < n_blocks - 1)
        if n < n_blocks - 1:  # a stage of its own, so that workers hold one block at a time
            rows = session.written(rows, "spans")
    return rows


def n_hit() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])


def contaminated() -> F.Column:
    return (n_hit() > 0) & (CLEAN_SHARE * n_hit() >= F.col("n_words"))


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """A text without the given word ranges and the separators inside them."""
    if not text or not spans:
        return text
    data = text.encode()
    starts, ends, _ = texts.word_spans(np.frombuffer(data.translate(_NORMAL), np.uint8) != 32, np.array([0, len(data)]))
    out, at = [], 0
    for first, last in spans:
        out.append(data[at:starts[first]])
        at = ends[last - 1]
    return b"".join([*out, data[at:]]).decode()


def removed(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", spans: bool = False) -> DataFrame:
    """`docs` without its contaminated documents or, with `spans`, with all hit passages cut out of the texts.

    Each row is judged and cut by its own text, whatever its id; null texts stay, as null.
    """
    @F.pandas_udf("string")
    def cut(text: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([without_spans(t, list(zip(a, z))) for t, a, z in zip(text, first, last)], dtype=object)

    # The whole row stands for its id, so that nothing is joined back; fields are named by place, whatever the columns are called.
    whole = F.struct(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(docs.columns)])
    found = scan(docs.select(whole.alias("id"), F.col(text_column).alias("text")), items, "id", "text")
    own = [F.col(f"id.c{i}") for i in range(len(docs.columns))]
    if not spans:
        return found.filter(~contaminated()).select(*[c.alias(n) for n, c in zip(docs.columns, own)])
    return found.select(*[(cut(c, "spans.first", "spans.last") if n == text_column else c).alias(n) for n, c in zip(docs.columns, own)])
