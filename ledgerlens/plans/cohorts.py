"""New collections, holders and active traders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numeric import ratio
from ledgerlens.plans.views import MarketView


def new_collections(view: MarketView) -> DataFrame:
    """Collections traded in the window and never before it.

    The first trade decides: it lies in the window exactly when the collection is
    in this week's set and not in the earlier one. One aggregate, no set of names.
    """
    first = F.col("first_block").between(view.window.lo, view.window.hi)
    return view.first_trades().where(first).select("contract_address", "contract_name")


def new_mints(view: MarketView, bounded: bool = False) -> DataFrame:
    """Collections created since the window's start; ``bounded`` stops at its end."""
    created = F.col("init_block") >= view.window.lo
    if bounded:
        created = created & (F.col("init_block") <= view.window.hi)
    return view.snapshot.contracts.where(created).select("contract_address", "contract_name")


def _holdings(view: MarketView) -> DataFrame:
    """Tokens by holder."""
    return view.holders().groupBy("to_address").agg(F.count(F.lit(1)).alias("tokens"))


def holder_summary(view: MarketView) -> DataFrame:
    """Holders (an unknown one counts once), tokens and tokens per holder."""
    return _holdings(view).agg(
        F.count(F.lit(1)).alias("holders"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
    ).withColumn("average_holding", ratio(F.col("tokens"), F.col("holders")))


def active_traders(view: MarketView) -> DataFrame:
    """Sellers and buyers of the last sales after the cutoff."""
    both = F.explode(F.array("seller", "buyer")).alias("trader")
    return view.active_tokens().select(both).distinct()


def active_holding(view: MarketView) -> DataFrame:
    """Active traders, the tokens they hold and tokens per active trader.

    Holdings are counted by holder before the join, so each side has one row per
    address and no address is hot.
    """
    held = _holdings(view).withColumnRenamed("to_address", "trader")
    joined = active_traders(view).join(held, "trader", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("active_traders"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("held_tokens"),
    ).withColumn("average_holding", ratio(F.col("held_tokens"), F.col("active_traders")))
