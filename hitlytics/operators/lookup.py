"""One row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def one_per(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First row per key. The rank filter becomes a per-task group limit ahead of the shuffle, so a
    key with any number of copies ships one row per task."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")
