"""Request quota: at most N requests per address in each epoch-aligned window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import default_text
from ..schema import QUOTA_REQUESTS, QUOTA_WINDOW_SECONDS

QUOTA_MESSAGE = "Too many requests, please try again later"


def window_start(ts: Column, seconds: int) -> Column:
    epoch = F.unix_micros(ts)
    size = F.lit(seconds * 1_000_000)
    return F.timestamp_micros(epoch - F.pmod(epoch, size))


def flag_over_quota(
    hits: DataFrame,
    limit: int = QUOTA_REQUESTS,
    window_seconds: int = QUOTA_WINDOW_SECONDS,
    eligible: Column | None = None,
) -> DataFrame:
    """Adds `over_quota`: true for eligible requests after the first `limit` of their address and window.

    Order is (received_at, event_id). No address is ever collected into one task:

    1. requests are counted per (address, second), with map-side partial counts, and a running sum over the seconds of a
       window, at most `window_seconds` rows, finds the second in which the limit is passed;
    2. requests of earlier seconds are allowed, those of later ones over quota;
    3. only the requests of that second are ranked; all others are spread over groups of their own.
    """
    eligible = F.lit(True) if eligible is None else eligible
    keyed = (
        hits.withColumn("_ip", default_text(F.col("ip"), "unknown"))
        .withColumn("_window", window_start(F.col("received_at"), window_seconds))
        .withColumn("_second", F.date_trunc("second", "received_at"))
        .withColumn("_eligible", F.coalesce(eligible, F.lit(False)))
    )
    running = Window.partitionBy("_ip", "_window").orderBy("_second").rowsBetween(Window.unboundedPreceding, 0)
    passed = (
        keyed.where("_eligible").groupBy("_ip", "_window", "_second").agg(F.count("*").alias("_n"))
        .withColumn("_through", F.sum("_n").over(running))
        .where((F.col("_through") > limit) & (F.col("_through") - F.col("_n") <= limit))
        .select("_ip", "_window", F.col("_second").alias("_cut"), (limit - F.col("_through") + F.col("_n")).alias("_left"))
    )
    joined = keyed.join(passed, ["_ip", "_window"], "left")
    crossing = F.col("_eligible") & F.coalesce(F.col("_second") == F.col("_cut"), F.lit(False))
    order = [F.col("received_at"), F.col("event_id")]
    spread = F.when(~crossing, F.xxhash64(*order))
    rank = F.row_number().over(Window.partitionBy("_ip", "_second", "_spread").orderBy(*order))
    over = F.when(F.col("_crossing"), rank > F.col("_left")).otherwise(
        F.col("_eligible") & F.coalesce(F.col("_second") > F.col("_cut"), F.lit(False)))
    return (
        joined.withColumn("_crossing", crossing).withColumn("_spread", spread).withColumn("over_quota", over)
        .drop("_ip", "_window", "_second", "_eligible", "_cut", "_left", "_crossing", "_spread")
    )
