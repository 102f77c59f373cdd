"""Queries on the raw hits: list, count, expire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import DAY_MS, at
from ..schema import RETENTION_DAYS


def find(
    hits: DataFrame,
    *predicates: Column,
    limit: int = 100,
    skip: int = 0,
    sort: list[Column] | None = None,
) -> DataFrame:
    """Matching hits, newest first. For deep paging pass `older_than` of the last row instead of a large skip."""
    for predicate in predicates:
        hits = hits.where(predicate)
    newest_first = [F.col("hit_ts").desc(), F.col("event_id")]
    return hits.orderBy(*(sort or newest_first)).offset(skip).limit(limit)


def older_than(hit_ts_ms: int, event_id: str) -> Column:
    """Rows after the given one in newest-first order."""
    ts = at(hit_ts_ms)
    return (F.col("hit_ts") < ts) | ((F.col("hit_ts") == ts) & (F.col("event_id") > event_id))


def count(hits: DataFrame, *predicates: Column) -> DataFrame:
    for predicate in predicates:
        hits = hits.where(predicate)
    return hits.agg(F.count("*").alias("hits"))


def cutoff_ms(now_ms: int, days: int = RETENTION_DAYS) -> int:
    return now_ms - days * DAY_MS


def kept(hits: DataFrame, cutoff: int) -> DataFrame:
    return hits.where(F.col("hit_ts") >= at(cutoff))


def expired_count(hits: DataFrame, cutoff: int) -> DataFrame:
    return count(hits, F.col("hit_ts") < at(cutoff))
