"""Single-figure reports: market cap, volumes, counts, means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numeric import exact_sum, mean, money
from ledgerlens.functions.text import report_line
from ledgerlens.operators.sets import concat
from ledgerlens.plans import cohorts
from ledgerlens.plans.views import SCOPES, MarketView
from ledgerlens.sources.tables import row_count

# Least number of decimals for sums over means.
MEAN_SCALE = 8


def every_scope(view: MarketView, figures: DataFrame, counts: list[str]) -> DataFrame:
    """``figures`` with a row for each scope; where there were no trades, counts are 0."""
    scopes = view.snapshot.trades.sparkSession.createDataFrame([(s,) for s in SCOPES], "scope STRING")
    filled = scopes.join(figures, "scope", "left")
    return filled.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def market_cap(view: MarketView, weight: str = "transfers") -> DataFrame:
    """Mean trade price of each collection times its weight, added up in ETH and USD.

    The weight is the number of ``transfers`` of the collection, or with
    ``"tokens"`` the number of tokens that were ever transferred.
    """
    if weight == "transfers":
        weights = view.transfers_by(["contract_address"]).withColumnRenamed("transfers", "weight")
    elif weight == "tokens":
        weights = view.tokens_by_contract().withColumnRenamed("tokens", "weight")
    else:
        raise ValueError(f"unknown weight: {weight}")
    return capped(view, weights, {"": "weight"})


def capped(view: MarketView, weights: DataFrame, names: dict[str, str]) -> DataFrame:
    """Market caps by the columns of ``weights`` (one row a collection) that ``names`` maps their infixes to."""
    prices = view.measures(["contract_address"]).select(
        "contract_address",
        mean(F.col("eth"), F.col("eth_prices")).alias("eth_avg"),
        mean(F.col("usd"), F.col("usd_prices")).alias("usd_avg"),
    )
    # A mean has more digits than the prices it comes from; cutting the products to
    # the price scale would move the total by some of its cents.
    scale = max(view.scale, MEAN_SCALE)
    return weights.join(prices, "contract_address").agg(*[
        money(exact_sum(f"({weight} * {unit}_avg)", scale)).alias(f"market_cap_{infix}{unit}")
        for infix, weight in names.items() for unit in ("eth", "usd")])


def volume_totals(view: MarketView) -> DataFrame:
    """Volume in ETH and USD and the number of collections behind it."""
    figures = view.scoped(["contract_address"]).groupBy("scope").agg(
        money(F.sum("eth")).alias("volume_eth"),
        money(F.sum("usd")).alias("volume_usd"),
        F.count(F.lit(1)).alias("collections"),
    )
    return every_scope(view, figures, ["collections"])


def contributors(view: MarketView) -> DataFrame:
    """Traded collections and traded tokens."""
    figures = view.scoped_tokens().groupBy("scope").agg(
        F.count(F.lit(1)).alias("collections"), F.sum("tokens").alias("tokens")
    )
    return every_scope(view, figures, ["collections", "tokens"])


def transfer_totals(view: MarketView) -> DataFrame:
    """Number of transfers."""
    return view.scoped_transfers()


def trade_totals(view: MarketView) -> DataFrame:
    """Number of enriched trades."""
    return every_scope(view, view.scoped([]).select("scope", "trades"), ["trades"])


def market_mean(view: MarketView) -> DataFrame:
    """Mean trade price and total ETH volume of the whole market."""
    figures = view.scoped([]).select(
        "scope", mean(F.col("eth"), F.col("eth_prices")).alias("price_mean"),
        money("eth").alias("price_sum"),
    )
    return every_scope(view, figures, [])


def _line(df: DataFrame, template: str, *columns: str) -> DataFrame:
    """The rows of ``df`` as sentences; figures that are null read as 0."""
    kinds = dict(df.dtypes)
    shown = [F.col(c) if kinds[c] == "string" else F.coalesce(F.col(c), F.lit(0).cast(kinds[c]))
             for c in columns]
    return df.select(report_line(template, *shown).alias("line"))


def summary_lines(view: MarketView) -> DataFrame:
    """The headline figures as sentences, one per line."""
    return concat(
        _line(volume_totals(view), "%s: traded %.2f ETH / %.2f USD in %d collections",
              "scope", "volume_eth", "volume_usd", "collections"),
        _line(market_cap(view), "all: market cap %.2f ETH / %.2f USD",
              "market_cap_eth", "market_cap_usd"),
        _line(transfer_totals(view), "%s: %d transfers", "scope", "transfers"),
        _line(contributors(view), "%s: %d tokens traded", "scope", "tokens"),
        _line(trade_totals(view), "%s: %d trades", "scope", "trades"),
        _line(market_mean(view), "%s: mean price %.4f ETH, %.2f ETH in total",
              "scope", "price_mean", "price_sum"),
        _line(row_count(cohorts.new_collections(view), "n"), "week: %d new collections", "n"),
        _line(row_count(cohorts.new_mints(view), "n"), "week: %d collections minted", "n"),
        _line(cohorts.holder_summary(view), "all: %d holders with %.2f tokens each",
              "holders", "average_holding"),
        _line(row_count(cohorts.active_traders(view), "n"), "all: %d active traders", "n"),
    )
