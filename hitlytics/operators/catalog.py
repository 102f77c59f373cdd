"""Catalogue search and parent-child reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import any_contains_ignoring_case, contains_ignoring_case

DEFAULT_LIMIT = 10


def parse_limit(value: str | int | None, fallback: int = DEFAULT_LIMIT) -> int:
    """Positive whole number at the start of the text, else the fallback."""
    digits = ""
    for ch in str(value if value is not None else "").strip().removeprefix("+"):
        if not ch.isdigit():
            break
        digits += ch
    return int(digits) if digits and int(digits) > 0 else fallback


def search(
    posts: DataFrame,
    order: Column,
    author: str | None = None,
    tag: str | None = None,
    limit: str | int | None = None,
) -> DataFrame:
    """Posts whose author, and any of whose tags, contain the given texts, ignoring case."""
    if author:
        posts = posts.where(contains_ignoring_case(F.col("author"), author))
    if tag:
        posts = posts.where(any_contains_ignoring_case(F.col("tags"), tag))
    return posts.orderBy(order).limit(parse_limit(limit))


def child_counts(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Every parent with the number of its children; a parent a child names but nobody knows is an error row."""
    counted = children.groupBy(key).agg(F.count("*").alias("children"))
    known = parents.select(key, F.lit(True).alias("_known"))
    return known.join(counted, key, "full").select(
        key,
        F.coalesce("children", F.lit(0)).alias("children"),
        F.when(F.col("_known").isNull(), "Post not found").alias("error"))


def with_children(parents: DataFrame, children: DataFrame, key: str, title: str) -> DataFrame:
    """Child rows with their parent's title and the number of siblings."""
    counted = children.groupBy(key).agg(F.count("*").alias("total"))
    heads = parents.select(key, title).join(counted, key)
    return children.join(heads, key)
