"""Block windows: the block range of a span of dates, looked up inside the plan."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.dates import as_date, date_span


def _fitted(block: Column, kind: str) -> Column:
    """A block number as ``kind``; beyond its range the nearest number that it has."""
    digits = re.match(r"decimal\((\d+),0\)", kind)
    most = {"int": 2**31 - 1}.get(kind, 10 ** int(digits[1]) - 1 if digits else 2**63 - 1)
    if most < 2**63 - 1:
        block = F.greatest(F.least(block, F.lit(most).cast("bigint")), F.lit(-most).cast("bigint"))
    return block.cast(kind)


class BlockWindow:
    """Blocks dated within ``days`` days from ``start``, both ends included.

    ``lo`` and ``hi`` are scalar subqueries. They run before the main scan and
    reach it as pushed-down bounds, so row groups outside the window are not read.
    The two have different shapes (aggregate, top-1) on purpose: two aggregates
    would be merged into one struct-valued subquery, which is not pushed down.
    A window without blocks has null bounds and therefore holds no rows.
    """

    def __init__(
        self,
        blocks: DataFrame,
        start: str | datetime.date | Column | None = None,
        days: int = 7,
    ) -> None:
        first, last = date_span(start, days)
        self.first_day = first
        self.last_day = last
        self.blocks = blocks.where(
            F.col("date").between(first, last) & F.col("block_number").isNotNull()
        ).select("block_number")

    def low(self, kind: str = "bigint") -> Column:
        """The first block as ``kind``; cast within the subquery, so that it is pushed down."""
        return self.blocks.agg(_fitted(F.min("block_number"), kind)).scalar()

    def high(self, kind: str = "bigint") -> Column:
        last = self.blocks.orderBy(F.desc("block_number")).limit(1)
        return last.select(_fitted(F.col("block_number"), kind)).scalar()

    @property
    def lo(self) -> Column:
        return self.low()

    @property
    def hi(self) -> Column:
        return self.high()

    def frame(self) -> DataFrame:
        """The bounds as a one-row DataFrame."""
        return self.blocks.agg(
            F.min("block_number").alias("start_block"),
            F.max("block_number").alias("end_block"),
        )

    def holds(self, column: str = "block_number") -> Column:
        return F.col(column).between(self.lo, self.hi)

    def resolved(self) -> "FixedWindow":
        """The window with its two bounds looked up now; see :class:`FixedWindow`."""
        return FixedWindow(self)


class FixedWindow(BlockWindow):
    """A window whose bounds are literals, read back to the driver as one row.

    For sources that only take filters known when the query is planned, such as
    JDBC: the range then becomes part of the query the database runs.
    """

    def __init__(self, window: BlockWindow) -> None:
        self.__dict__.update(window.__dict__)
        self._lo, self._hi = window.frame().first()

    def low(self, kind: str = "bigint") -> Column:
        return _fitted(F.lit(self._lo).cast("bigint"), kind)

    def high(self, kind: str = "bigint") -> Column:
        return _fitted(F.lit(self._hi).cast("bigint"), kind)


def block_at(blocks: DataFrame, day: str | datetime.date | Column, resolve: bool = False) -> Column:
    """Last block dated on or before ``day``: a scalar subquery, or with ``resolve`` a literal."""
    last = blocks.where(F.col("date") <= as_date(day)).agg(F.max("block_number"))
    return F.lit(last.first()[0]).cast("bigint") if resolve else last.scalar()
