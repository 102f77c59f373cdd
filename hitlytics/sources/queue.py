"""Queue messages as files: JSON lines or parquet with the `MESSAGE` columns.

Any other streaming source that gives these columns can feed the tables in the same way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..schema import MESSAGE

#: A gibibyte of queue files.
MAX_BYTES = 1 << 30


def read(spark: SparkSession, *paths: str, fmt: str = "parquet") -> DataFrame:
    """All messages of the given folders."""
    return spark.read.schema(MESSAGE).format(fmt).load(list(paths))


def read_stream(
    spark: SparkSession, *paths: str, fmt: str = "parquet", max_bytes: int = MAX_BYTES, max_files: int | None = None
) -> DataFrame:
    """Messages as they arrive, at least once, bounded per folder and micro-batch by the size of the files (a larger file
    makes a batch of its own) or, if given, by their number.

    Give the folder of released retries as a further path to have retried messages come round again.
    """
    bound = ("maxBytesPerTrigger", max_bytes) if max_files is None else ("maxFilesPerTrigger", max_files)
    streams = [
        spark.readStream.schema(MESSAGE).format(fmt)
        .option(*bound).option("recursiveFileLookup", "true").load(path)
        for path in paths
    ]
    return reduce(DataFrame.unionByName, streams)
