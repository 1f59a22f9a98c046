"""Group aggregates, all of them partial before the shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ledgerlens.functions.numeric import exact_sum


def trade_rollup(trades: DataFrame, keys: Sequence[str], scale: int) -> DataFrame:
    """Mergeable trade measures by ``keys``; unused ones are pruned by the planner."""
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        F.count("price_value").alias("eth_prices"),
        exact_sum("price_value", scale).alias("eth"),
        F.count("price_usd").alias("usd_prices"),
        exact_sum("price_usd", scale).alias("usd"),
        F.max("price_value").alias("price_max"),
        F.min("price_value").alias("price_min"),
        F.min("block_number").alias("first_block"),
    )


def merge_rollup(rollup: DataFrame, keys: Sequence[str], **others: Column) -> DataFrame:
    """Roll measures up to fewer ``keys``; without keys, to one row. ``others`` are further aggregates."""
    return rollup.groupBy(*keys).agg(
        F.coalesce(F.sum("trades"), F.lit(0)).alias("trades"),
        F.coalesce(F.sum("eth_prices"), F.lit(0)).alias("eth_prices"),
        F.sum("eth").alias("eth"),
        F.coalesce(F.sum("usd_prices"), F.lit(0)).alias("usd_prices"),
        F.sum("usd").alias("usd"),
        F.max("price_max").alias("price_max"),
        F.min("price_min").alias("price_min"),
        F.min("first_block").alias("first_block"),
        *[c.alias(name) for name, c in others.items()],
    )


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], **others: Column
) -> DataFrame:
    """``values`` of the last row of each key by ``order``, ties broken by the values.

    Nulls come before all else. ``others`` are further aggregates of the same pass.
    Each input partition passes on one row a key, so a hot key is small before the
    shuffle. As fast as a rank filter (3.5 to 4.8 s against 3.4 to 4.0 s for the
    holders at sf0.1), which cannot aggregate beside it.
    """
    ranked = list(dict.fromkeys([*order, *values]))
    last = df.groupBy(*keys).agg(
        F.max(F.struct(*ranked)).alias("last"), *[c.alias(name) for name, c in others.items()]
    )
    return last.select(*keys, *[F.col("last")[v].alias(v) for v in values], *others)


def group_count(df: DataFrame, keys: Sequence[str], name: str = "count") -> DataFrame:
    """Rows by group; nulls count as rows and as a key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def distinct_count(df: DataFrame, keys: Sequence[str], name: str = "count") -> DataFrame:
    """Number of distinct key values as one row; null counts as a value."""
    return df.select(*keys).distinct().agg(F.count(F.lit(1)).alias(name))


def aggregate_all(
    df: DataFrame, keys: Sequence[str], function: Callable[[str], Column]
) -> DataFrame:
    """``function`` (such as ``F.max``) of every other column by ``keys``."""
    rest = [name for name in df.columns if name not in keys]
    return df.groupBy(*keys).agg(*[function(name).alias(name) for name in rest])


def sum_all(df: DataFrame, keys: Sequence[str], scale: int) -> DataFrame:
    """Sum of every other numeric column by ``keys``; the rest is left out."""
    numeric = [
        f.name for f in df.schema.fields
        if f.name not in keys and isinstance(f.dataType, NumericType)
    ]
    whole = {"tinyint", "smallint", "int", "bigint"}
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.groupBy(*keys).agg(*[
        (F.sum(name) if kinds[name] in whole else exact_sum(name, scale).cast("double"))
        .alias(name)
        for name in numeric
    ])


def price_stats(df: DataFrame, keys: Sequence[str], column: str, scale: int) -> DataFrame:
    """Minimum, maximum, mean and row count of one column by ``keys``."""
    value = F.col(column)
    return df.groupBy(*keys).agg(
        F.min(value).alias(f"min_{column}"),
        F.max(value).alias(f"max_{column}"),
        F.try_divide(exact_sum(column, scale).cast("double"), F.count(value)).alias(f"avg_{column}"),
        F.count(F.lit(1)).alias("count"),
    )
