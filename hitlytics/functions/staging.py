"""Expressions that must be evaluated once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns through a one-element generator.

    A plain projection is repeated inside every later filter on its columns (predicates are pushed through it by
    substitution), which multiplies costly expressions such as JSON parsing. Predicates stop at a generator.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
