"""Shared helpers: text columns as byte arrays, words and their hashes, shared-folder tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlytics import session

#: Rows of an Arrow batch: bounds what a Python worker holds at once.
BATCH_ROWS = "2000"

#: The white space that separates words (space and U+0009 to U+000D).
SPACES = b" \t\n\x0b\x0c\r"

_BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
MIXES = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_M1, _M2 = map(np.uint64, MIXES)


def prepare(spark: SparkSession) -> SparkSession:
    session.configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key's text modulo `modulus`; -1 for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus, F.lit(-1))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage through a checkpoint in the folder all executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(session.shared_path(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one after another, and where each row starts (nulls are empty)."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of `inside` bytes that cross no row boundary: starts, ends, row of each."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


_VALUES = _byte_values()
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; blocks of about a megabyte bound the memory."""
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + _BLOCK_BYTES, "right")))
        first, last = starts[low], ends[high - 1]
        size = int(last - first)
        powers = np.full(size + 1, _BASE, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_VALUES[data[first:last]] * powers[:-1], out=sums[1:])
        powers.fill(_UNBASE)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        s, e = starts[low:high] - first, ends[low:high] - first
        out[low:high] = mix((sums[e] - sums[s]) * powers[s] + (e - s).astype(np.uint64))
        low = high
    return out
