"""Ordered reports: top-k, whole sorts and pages, always in a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def descending(metric: str, ties: Sequence[str]) -> list[Column]:
    """Metric descending with nulls first, then ``ties`` ascending."""
    return [F.desc_nulls_first(metric), *[F.asc_nulls_first(name) for name in ties]]


def top_k(df: DataFrame, metric: str, ties: Sequence[str], k: int | None) -> DataFrame:
    """First ``k`` rows by ``metric``; every task keeps only ``k``. ``None`` sorts all rows."""
    ordered = df.orderBy(*descending(metric, ties))
    return ordered if k is None else ordered.limit(k)


def page(df: DataFrame, order: Sequence[str], offset: int, size: int) -> DataFrame:
    """Rows ``offset`` to ``offset + size`` by ``order``, which has to be total.

    For walking a whole table read it partitioned instead: this keeps
    ``offset + size`` rows per task.
    """
    return df.orderBy(*order).offset(offset).limit(size)


def sample_rows(df: DataFrame, n: int) -> DataFrame:
    """Any ``n`` rows, in no order: the row cap of a sampled read."""
    return df.limit(n)
