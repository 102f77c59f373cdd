"""Hits folded into mergeable metrics per client, service, endpoint, method and time bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times, values
from ..schema import ROLLUP_KEY

# Widths of the roll-up's text columns.
WIDTHS = {"service_name": 255, "endpoint": 500, "method": 10, "client_id": 24}


def reject_reason() -> Column:
    """Why a stored hit cannot enter the roll-up; null when it can."""
    problems = F.concat_ws(
        ", ",
        *[F.when(F.length(F.col(c)) > width, F.lit(f"{c} is longer than {width}")) for c, width in WIDTHS.items()],
        F.when(values.microseconds(F.col("latency_ms")).isNull(), F.lit("latency_ms is out of range")),
    )
    return F.nullif(problems, F.lit(""))


def split_rejects(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits that fit the roll-up, rejected hits with `reject_reason`)."""
    judged = hits.withColumn("reject_reason", reject_reason())
    return (
        judged.where(F.col("reject_reason").isNull()).drop("reject_reason"),
        judged.where(F.col("reject_reason").isNotNull()),
    )


def fold(hits: DataFrame, grain: str = "hour") -> DataFrame:
    """One partial row per key and bucket. Map-side combine absorbs hot keys.

    Hits that cannot enter the roll-up are left out, as `split_rejects` lists them.
    """
    contribution = split_rejects(hits)[0].select(
        "client_id", "service_name", "endpoint", "method",
        times.time_bucket(F.col("hit_ts"), grain).alias("time_bucket"),
        values.is_error(F.col("status_code")).cast("int").alias("_error"),
        values.microseconds(F.col("latency_ms")).alias("_us"))
    return contribution.groupBy(*ROLLUP_KEY).agg(
        F.count("*").alias("total_hits"),
        F.sum("_error").alias("error_hits"),
        F.sum("_us").alias("latency_us"),
        F.min("_us").alias("min_latency_us"),
        F.max("_us").alias("max_latency_us"))


def totals() -> list[Column]:
    """Merging of partial rows: counts and sums add up, extremes stay extremes."""
    return [
        F.sum("total_hits").alias("total_hits"),
        F.sum("error_hits").alias("error_hits"),
        F.sum("latency_us").alias("latency_us"),
        F.min("min_latency_us").alias("min_latency_us"),
        F.max("max_latency_us").alias("max_latency_us"),
    ]


def merge(partials: DataFrame, *extra: Column) -> DataFrame:
    """Partial rows of any number of batches, merged; the order of arrival does not matter."""
    return partials.groupBy(*ROLLUP_KEY).agg(*totals(), *extra)


def present(rollup: DataFrame) -> DataFrame:
    """Roll-up rows with latencies in milliseconds."""
    def ms(c: str) -> Column:
        return F.col(c).cast("double") / F.lit(1000.0)

    return rollup.select(
        *ROLLUP_KEY, "total_hits", "error_hits",
        values.mean_ms(F.col("latency_us"), F.col("total_hits")).alias("avg_latency"),
        ms("min_latency_us").alias("min_latency"), ms("max_latency_us").alias("max_latency"))
