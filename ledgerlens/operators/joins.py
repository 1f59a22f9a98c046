"""Join helpers: size-checked broadcast, name collisions, membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lookup rows of a few fixed-width columns: at most some 200 MB per executor.
BROADCAST_ROWS = 4_000_000

# Rows a table can have at one row per calendar day (years 1 to 9999).
CALENDAR_DAYS = 3_652_059


def broadcast_bounded(df: DataFrame, row_bound: int | None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint ``df`` for broadcast only when it provably has no more than ``limit`` rows.

    Otherwise no hint is set: the join then shuffles, unless the planner's own
    size check finds the side small, and adaptive execution splits hot keys.
    """
    if row_bound is not None and row_bound <= limit:
        return F.broadcast(df)
    return df


def join_frames(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str] | dict[str, str],
    how: str = "inner",
    suffix: str = "_right",
) -> DataFrame:
    """Equi-join whose result never has two columns of one name.

    ``on`` names shared keys, or maps left keys to right keys (then both stay).
    Any other right-hand column that the left side also has gets ``suffix``.
    """
    if isinstance(on, dict):
        shared, pairs = [], on
    else:
        shared, pairs = ([on] if isinstance(on, str) else list(on)), {}
    taken = set(left.columns)
    renames = {c: c + suffix for c in right.columns if c in taken and c not in shared}
    right = right.withColumnsRenamed(renames)
    if shared:
        return left.join(right, shared, how)
    keys = [left[l] == right[renames.get(r, r)] for l, r in pairs.items()]
    return left.join(right, keys, how)


def members(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose ``column`` occurs in the only column of ``values`` (null never does)."""
    wanted = values.toDF(column).distinct()
    return df.join(wanted, column, "left_semi")


def non_members(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose ``column`` does not occur in ``values``; rows with null stay."""
    return df.join(values.toDF(column).distinct(), column, "left_anti")
