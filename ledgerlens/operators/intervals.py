"""Lookups by ranges of consecutive numbers instead of single ones.

A table with a row for every number (a block, say) often says the same of many numbers
in a row. As ranges it is a thousandth of its size, and small enough to broadcast where
the table itself is not, so the rows that look something up need not be shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers are cut into bins of 2 ** SHIFT; a range lies in one bin and is found by it.
SHIFT = 10

LOW, HIGH, BIN = "range_low", "range_high", "range_bin"


def runs(df: DataFrame, position: str, values: Sequence[str]) -> DataFrame:
    """Unbroken runs of integers with equal ``values``, cut at bins: bin, low, high and the values.

    A gap in the numbers ends a run. A number that occurs several times with the same
    values is in as many runs. No group has more rows than a bin has numbers.
    """
    counted = df.where(F.col(position).isNotNull()).groupBy(position, *values).agg(
        F.count(F.lit(1)).alias("copies"))
    binned = counted.withColumn(BIN, F.shiftright(position, SHIFT))
    alike = [BIN, "copies", *values]
    # Along a run the number grows as its rank does, so their difference names the run.
    rank = F.row_number().over(Window.partitionBy(*alike).orderBy(position))
    found = binned.withColumn("run", F.col(position) - rank).groupBy(*alike, "run").agg(
        F.min(position).alias(LOW), F.max(position).alias(HIGH))
    return found.select(BIN, LOW, HIGH, *values, F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy")).drop("copy")


@dataclass(frozen=True)
class RangeTable:
    """Ranges small enough to broadcast (see ``joins.BROADCAST_ROWS``), and where they are stored."""

    ranges: DataFrame
    path: str | None = None

    def join(self, rows: DataFrame, position: str, how: str = "inner") -> DataFrame:
        """``rows`` with the values of the ranges that hold their ``position``.

        A hash join on the bin; the bounds are checked on the few ranges of it. Also
        ``left``, ``left_semi`` and ``left_anti``. The rows are not shuffled.
        """
        ranges = F.broadcast(self.ranges)
        at = rows[position]
        inside = (F.shiftright(at, SHIFT) == ranges[BIN]) & at.between(ranges[LOW], ranges[HIGH])
        joined = rows.join(ranges, inside, how)
        return joined if how in ("left_semi", "left_anti") else joined.drop(BIN, LOW, HIGH)
