"""Concatenation and value sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def concat(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, columns matched by name."""
    return reduce(DataFrame.unionByName, frames)


def distinct_values(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """The set of values of one column; null is a value."""
    return df.select(df[column].alias(name or column)).distinct()


def union_values(*columns: DataFrame) -> DataFrame:
    """Set union of one-column frames."""
    return reduce(DataFrame.union, columns).distinct()


def difference_values(left: DataFrame, right: DataFrame) -> DataFrame:
    """Values of ``left`` that are not in ``right``, as a set; null equals null."""
    return left.subtract(right)
