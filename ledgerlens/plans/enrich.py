"""Enriched trades and the samples and pages of them."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.intervals import RangeTable, runs
from ledgerlens.operators.joins import BROADCAST_ROWS, broadcast_bounded
from ledgerlens.plans.snapshot import Snapshot
from ledgerlens.session import remove_path, scratch_path

#: Where trades find the date and rate of their block: by block, or by ranges of blocks.
Calendar = DataFrame | RangeTable


def price_calendar(snapshot: Snapshot) -> Calendar:
    """Date and ETH rate of every block that has one.

    Joining the two small tables first leaves one join on the trades, and no
    shuffle of them at all when the calendar is provably small, by itself or as ranges.
    """
    if snapshot.price_ranges is not None:
        return snapshot.price_ranges
    rates = broadcast_bounded(snapshot.rates.select("date", "eth_usd_rate"), snapshot.rate_bound)
    calendar = (
        snapshot.blocks.select("block_number", "date").join(rates, "date")
        .select("block_number", "date", F.col("eth_usd_rate").cast("double").alias("eth_usd_rate"))
    )
    return broadcast_bounded(calendar, snapshot.calendar_bound)


def with_price_ranges(snapshot: Snapshot, limit: int = BROADCAST_ROWS) -> Snapshot:
    """The snapshot with its calendar as stored ranges of blocks, if they are at most ``limit``.

    Dates change once in thousands of blocks, so this fits for any chain whose block
    table has no more gaps than that; otherwise the snapshot stays as it is. One pass over
    the blocks; the ranges are counted once written, and removed if they are too many.
    """
    spark = snapshot.blocks.sparkSession
    dated = runs(snapshot.blocks.select("block_number", "date"), "block_number", ["date"])
    rates = snapshot.rates.select("date", F.col("eth_usd_rate").cast("double").alias("eth_usd_rate"))
    ranges = dated.join(rates, "date")
    path = scratch_path(spark, "price-ranges")
    ranges.write.parquet(path)
    stored = spark.read.schema(ranges.schema).parquet(path)
    if stored.count() > limit:
        remove_path(spark, path)
        return snapshot
    return dataclasses.replace(snapshot, price_ranges=RangeTable(stored, path))


# A price beyond this many ETH, more than there are, or no number at all is malformed.
MOST_PRICE = 1e12


def _well_formed() -> Column:
    # NaN is larger than any number in comparisons.
    return F.col("price_value").isNull() | (F.abs(F.col("price_value").cast("double")) <= MOST_PRICE)


def eth_trades(snapshot: Snapshot, trades: DataFrame | None = None) -> DataFrame:
    """Trades paid in one of the accepted currencies, but for malformed prices.

    One such price would raise in the exact sums of its whole group; the rows left out
    are those of :func:`malformed_trades`, and their number is part of the report.
    """
    rows = snapshot.trades if trades is None else trades
    return rows.where(F.col("currency_address").isin(*snapshot.currencies) & _well_formed())


def malformed_trades(snapshot: Snapshot) -> DataFrame:
    """Trades in an accepted currency whose price is NaN, infinite or beyond ``MOST_PRICE``."""
    paid = snapshot.trades.where(F.col("currency_address").isin(*snapshot.currencies))
    return paid.where(~_well_formed())


def on_block(trades: DataFrame, calendar: Calendar, how: str = "inner") -> DataFrame:
    """The join of trades and calendar; a kind that adds no columns keeps or drops trades."""
    if isinstance(calendar, RangeTable):
        return calendar.join(trades, "block_number", how)
    return trades.join(calendar, "block_number", how)


def with_usd_price(trades: DataFrame, calendar: Calendar, how: str = "inner") -> DataFrame:
    """Trades with date, rate and USD price; those without block or rate drop out.

    With ``how="left"`` they stay, with nulls.
    """
    return (
        on_block(trades, calendar, how)
        .withColumn("price_value", F.col("price_value").cast("double"))
        .withColumn("price_usd", F.col("price_value") * F.col("eth_usd_rate"))
    )


def enriched_trades(snapshot: Snapshot) -> DataFrame:
    """Priced trades with the columns of their collection; unknown collections drop out."""
    priced = with_usd_price(eth_trades(snapshot), price_calendar(snapshot))
    return priced.join(snapshot.contracts, "contract_address")


def latest_blocks(snapshot: Snapshot, k: int = 500) -> DataFrame:
    """The latest ``k`` rows of blocks joined to trades: one row per trade of a block.

    The join repeats a block once per trade, so trades are counted by block first
    and only counts are shuffled. A block cannot fill more than ``k`` places.
    """
    counts = snapshot.trades.groupBy("block_number").agg(F.count(F.lit(1)).alias("copies"))
    blocks = snapshot.blocks.select("block_number", "date", "timestamp_of_block")
    order = [F.desc_nulls_first("date"), F.desc("block_number")]
    newest = blocks.join(counts, "block_number").orderBy(*order).limit(k)
    copies = F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k))))
    return (
        newest.withColumn("copy", copies).orderBy(*order, "copy").limit(k).drop("copy", "copies")
    )


def latest_trades(snapshot: Snapshot, k: int = 500) -> DataFrame:
    """The latest ``k`` trades by block date; trades without a block come first.

    Every block of a trade holds at least one, so the ``k`` newest blocks hold the
    answer. They are found from counts; the second scan keeps only their trades.
    No full trade row is shuffled; the blocks are broadcast if ``k`` rows may be.
    """
    trades = snapshot.trades
    used = trades.groupBy("block_number").agg(F.count(F.lit(1)).alias("n")).drop("n")
    dated = snapshot.blocks.select("block_number", "date").join(used, "block_number", "right")
    order = [F.desc_nulls_first("date"), F.desc_nulls_first("block_number")]
    newest = dated.orderBy(*order).limit(k).withColumnRenamed("block_number", "newest_block")
    rest = [name for name in trades.columns if name != "block_number"]
    return (
        trades.join(broadcast_bounded(newest, k), F.col("block_number").eqNullSafe(F.col("newest_block")))
        .orderBy(*order, *rest).limit(k)
        .select(*trades.columns)
    )


def paged_trades(snapshot: Snapshot, bounds: list[int]) -> DataFrame:
    """Priced trades with ``page``, the number of ``bounds`` up to their block.

    One scan for all pages. The first and the last page are open-ended, so the pages
    together hold every trade exactly once.
    """
    page = sum((F.col("block_number") >= b).cast("int") for b in sorted(set(bounds)))
    priced = with_usd_price(eth_trades(snapshot), price_calendar(snapshot))
    return priced.withColumn("page", page if bounds else F.lit(0))


def trade_page(snapshot: Snapshot, lo: int | None, hi: int | None) -> DataFrame:
    """One page by itself: priced trades of blocks from ``lo`` to before ``hi``.

    The bounds reach the scan where the block number is a stored column.
    """
    trades = eth_trades(snapshot)
    if lo is not None:
        trades = trades.where(F.col("block_number") >= lo)
    if hi is not None:
        trades = trades.where(F.col("block_number") < hi)
    return with_usd_price(trades, price_calendar(snapshot))
