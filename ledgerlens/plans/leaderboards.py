"""Ranked reports by collection, token and market."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numeric import mean, money
from ledgerlens.operators.aggregates import aggregate_all, sum_all
from ledgerlens.operators.topk import top_k
from ledgerlens.plans.views import ALL, SCOPES, TOKEN, MarketView

# Fixed value: length of a leaderboard.
TOP = 10

COLLECTION = ["contract_address"]


def collection_volume(view: MarketView, scope: str = ALL, k: int | None = TOP) -> DataFrame:
    """Collections by USD volume."""
    measured = view.measures(COLLECTION, scope).select(
        *COLLECTION, "contract_name", money("usd", 4).alias("price_usd")
    )
    return top_k(measured, "price_usd", COLLECTION, k)


def market_volume(view: MarketView, scope: str = ALL, k: int | None = None) -> DataFrame:
    """Markets (venues) by USD volume."""
    measured = view.measures(["market"], scope).select("market", money("usd").alias("price_usd"))
    return top_k(measured, "price_usd", ["market"], k)


def collection_trades(view: MarketView, scope: str = ALL, k: int | None = TOP) -> DataFrame:
    """Collections by number of trades."""
    measured = view.measures(COLLECTION, scope).select(
        *COLLECTION, "contract_name", F.col("trades").alias("count")
    )
    return top_k(measured, "count", COLLECTION, k)


def token_trades(view: MarketView, scope: str = ALL, k: int | None = TOP) -> DataFrame:
    """Tokens by number of trades."""
    measured = view.measures(TOKEN, scope).select(
        *TOKEN, "contract_name", F.col("trades").alias("count")
    )
    return top_k(measured, "count", TOKEN, k)


def _price_stats(view: MarketView, keys: list[str], scope: str) -> DataFrame:
    return view.measures(keys, scope).select(
        *keys,
        "contract_name",
        mean(F.col("eth"), F.col("eth_prices")).alias("price_value_avg"),
        F.col("price_max").alias("price_value_max"),
        F.col("price_min").alias("price_value_min"),
        F.col("trades").alias("count"),
    )


def collection_prices(view: MarketView, scope: str = ALL, k: int | None = TOP) -> DataFrame:
    """Collections by mean price, with the price range."""
    return top_k(_price_stats(view, COLLECTION, scope), "price_value_avg", COLLECTION, k)


def token_prices(view: MarketView, scope: str = ALL, k: int | None = TOP) -> DataFrame:
    """Tokens by mean price, with the price range."""
    return top_k(_price_stats(view, TOKEN, scope), "price_value_avg", TOKEN, k)


def price_extremes(view: MarketView) -> DataFrame:
    """Highest and lowest token of each scope by maximum and by mean price, in one pass.

    "Lowest maximum" looks at positive prices only. As in a descending sort with
    nulls first, a token without any price is the highest, and never the lowest
    while another has one. Tokens are formed once, with the figures of both scopes side
    by side; one aggregate without a key then holds the eight extremes, so tokens are
    neither shuffled again nor sorted.
    """
    named = [*TOKEN, "contract_name"]
    picks, rows = [], []
    for scope in SCOPES:
        traded = F.col(f"{scope}_trades") > 0
        for metric, name in (("top", "max"), ("mean", "avg")):
            value = F.col(f"{scope}_{metric}")
            # Place in the leaderboard: nulls first, then descending, then by key.
            place = F.struct(value.isNotNull(), -value, *TOKEN)
            found = F.struct(*named, value.alias("price"))
            low = traded & (value > 0) if metric == "top" else traded
            picks += [
                F.min_by(found, F.when(traded, place)).alias(f"{scope}_highest_{name}"),
                F.max_by(found, F.when(low, place)).alias(f"{scope}_lowest_{name}"),
            ]
            rows += [
                F.struct(F.lit(scope).alias("scope"), F.lit(f"{side}_{name}").alias("extreme"),
                         *[F.col(f"{scope}_{side}_{name}")[c].alias(c) for c in [*named, "price"]])
                for side in ("highest", "lowest")
            ]
    # Without such a token there is no row to pick.
    return view.token_extents().agg(*picks).select(F.inline(F.array(*rows))).where(
        F.col("contract_address").isNotNull())


def token_columns(view: MarketView, function: Callable[[str], Column], scope: str = ALL) -> DataFrame:
    """``function`` (such as ``F.max``) of every trade column by token, cheapest token first.

    Tokens are formed before the collection's columns are joined on. The other way
    round the grouping would reuse the join's partitioning, with all trades of a hot
    collection in one task.
    """
    tokens = aggregate_all(view.trades(scope), TOKEN, function)
    named = tokens.join(view.snapshot.contracts, "contract_address")
    return named.orderBy(F.asc_nulls_first("price_value"), *TOKEN)


def token_sums(view: MarketView, scope: str = ALL) -> DataFrame:
    """Sum of every numeric trade column by token of a known collection."""
    tokens = sum_all(view.trades(scope), TOKEN, view.scale)
    return tokens.join(view.labels, "contract_address")
