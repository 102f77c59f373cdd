"""Runs of consecutive failures, reset by a success.

A key may own any share of the rows, so its timeline is never put into one task: rows are range-partitioned by
(key, order), which cuts a hot key into chunks of about equal size. A run inside a chunk is final; only the two
islands at a chunk's ends can continue in a neighbour, and only they are stitched together per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import POISON_THRESHOLD


def segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], failed: Column) -> DataFrame:
    """Failure islands per chunk: (keys, chunk, island, closed, failures, started_at, ended_at).

    An island is a success followed by failures; island 0 has the failures before the chunk's first success.
    `closed` islands end and begin inside the chunk. The first column of `order` is the time.
    """
    chunked = (
        df.select(*keys, *order, F.coalesce(failed, F.lit(False)).alias("_failed"))
        .repartitionByRange(*keys, *order)
        .withColumn("chunk", F.spark_partition_id().cast("long"))
    )
    timeline = Window.partitionBy("chunk", *keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    island = F.sum(F.when(F.col("_failed"), 0).otherwise(1)).over(timeline)
    when_failed = F.when(F.col("_failed"), F.col(order[0]))
    islands = (
        chunked.withColumn("island", island)
        .groupBy("chunk", *keys, "island")
        .agg(
            F.count_if("_failed").alias("failures"),
            F.min(when_failed).alias("started_at"),
            F.max(when_failed).alias("ended_at"))
    )
    last = F.max("island").over(Window.partitionBy("chunk", *keys))
    return (
        islands.withColumn("_last", last)
        .withColumn("closed", (F.col("island") > 0) & (F.col("island") < F.col("_last")))
        .where(~F.col("closed") | (F.col("failures") > 0))
        .select(*keys, "chunk", "island", "closed", "failures", "started_at", "ended_at")
    )


def merge(parts: DataFrame, keys: Sequence[str], sequence: Sequence[str] = ("chunk",)) -> DataFrame:
    """Segments of neighbouring chunks as the segments of one: an open head, closed runs, an open tail.

    Chunks follow each other by `sequence`. A run keeps the label (`sequence`, island) of its first segment, so merging is
    associative: any batches that follow each other may be merged first. Closed runs pass through; of the open islands,
    two per chunk at most share a window group, and two per key are left.
    """
    label = [*sequence, "island"]
    ordered = Window.partitionBy(*keys).orderBy(*label)
    run = F.sum(F.when(F.col("island") > 0, 1).otherwise(0)).over(ordered.rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    joined = (
        parts.where(~F.col("closed")).withColumn("_run", run)
        .groupBy(*keys, "_run")
        .agg(
            F.min(F.struct(*label)).alias("_label"),
            F.sum("failures").alias("failures"),
            F.min("started_at").alias("started_at"),
            F.max("ended_at").alias("ended_at"))
        .withColumn("_last", F.max("_run").over(Window.partitionBy(*keys)))
        .withColumn("closed", (F.col("_run") > 0) & (F.col("_run") < F.col("_last")))
        .where(~F.col("closed") | (F.col("failures") > 0))
        .select(*keys, "_label.*", "closed", "failures", "started_at", "ended_at")
    )
    return joined.unionByName(parts.where("closed").select(*joined.columns))


def stitch(parts: DataFrame, keys: Sequence[str], sequence: Sequence[str] = ("chunk",)) -> DataFrame:
    """Whole runs from segments whose chunks follow each other by `sequence`."""
    return merge(parts, keys, sequence).where(F.col("failures") > 0).select(*keys, "failures", "started_at", "ended_at")


def failure_runs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    failed: Column,
    threshold: int = POISON_THRESHOLD,
) -> DataFrame:
    """Every maximal run of failures with its length, bounds and whether it reaches the alarm threshold."""
    runs = stitch(segments(df, keys, order, failed), keys)
    return runs.withColumn("poison", F.col("failures") >= threshold)
