"""Parts of a table with about equal numbers of rows, for partitioned reads of uneven keys."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ledgerlens.sources.tables import Source, jdbc_options, read_table

#: Quantiles are exact to one in this many rows; an aggregate's buffer holds about as many values.
ACCURACY = 10_000


def _ranges(column: str, bounds: Sequence[int]) -> dict[int | None, str]:
    """Disjoint conditions for every value of ``column`` by their least value, nulls in the first one."""
    bounds = sorted(set(bounds))
    if not bounds:
        return {None: "TRUE"}
    middle = {a: f"{column} >= {a} AND {column} < {b}" for a, b in zip(bounds, bounds[1:])}
    return {None: f"({column} < {bounds[0]} OR {column} IS NULL)", **middle, bounds[-1]: f"{column} >= {bounds[-1]}"}


def balanced_predicates(df: DataFrame, column: str, parts: int, spread: str | None = None) -> list[str]:
    """SQL conditions, about ``parts`` of them, of which each row meets exactly one.

    Bounds are quantiles of the integer ``column``, from one aggregate with bounded buffers;
    strides of equal width would put most rows of an uneven column into one part. A value
    that fills several parts gets conditions of its own, divided at quantiles of the integer
    column ``spread``; without ``spread`` it stays one part. Nulls count to the first part of
    their column, and an empty table or one value gives the single condition ``TRUE``.
    """
    for name in filter(None, (column, spread)):
        if not isinstance(df.schema[name].dataType, IntegralType):
            raise ValueError(f"{name} is not an integer column")
    if parts < 1:
        raise ValueError("a table has at least one part")
    if parts == 1:
        return ["TRUE"]
    shares = [i / parts for i in range(1, parts)]
    quantiles = df.agg(F.percentile_approx(column, shares, ACCURACY)).first()[0] or []
    # A value at k quantiles holds at least k - 1 parts.
    hot = {v: k for v, k in Counter(quantiles).items() if k > 1} if spread else {}
    if not hot:
        return list(_ranges(column, quantiles).values())
    found = dict(df.where(F.col(column).isin(*hot)).groupBy(column).agg(
        F.percentile_approx(spread, [i / (2 * parts) for i in range(1, 2 * parts)], ACCURACY)).collect())
    predicates = []
    for least, condition in _ranges(column, [*quantiles, *[v + 1 for v in hot]]).items():
        inner, pieces = found.get(least) or [], hot.get(least, 0) + 1
        bounds = [inner[len(inner) * i // pieces] for i in range(1, pieces)] if inner else []
        if bounds:
            predicates += [f"{condition} AND {c}" for c in _ranges(spread, bounds).values()]
        else:
            predicates.append(condition)
    return predicates


def read_balanced(
    spark: SparkSession, source: Source, parts: int, column: str, spread: str | None = None
) -> DataFrame:
    """The table with one read partition for each balanced part.

    Only the key columns are read to find the parts, by the source's own split. Files are
    split by size already, so they are read as ever.
    """
    if source.format != "jdbc":
        return read_table(spark, source)
    keys = read_table(spark, source, [c for c in (column, spread) if c])
    options = jdbc_options(source)
    properties = {k: v for k, v in options.items() if k not in (
        "url", "dbtable", "partitionColumn", "lowerBound", "upperBound", "numPartitions")}
    return spark.read.jdbc(
        options["url"], options["dbtable"], properties=properties,
        predicates=balanced_predicates(keys, column, parts, spread))
