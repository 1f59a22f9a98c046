"""Arithmetic used by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits of one part of an exact sum.
DIGITS = 6


def exact(column: Column, scale: int) -> Column:
    """``column`` as a decimal, so that adding it up gives the same result in any order."""
    return column.cast(f"decimal(38,{scale})")


def exact_sum(number: str, scale: int) -> Column:
    """Sum of a DOUBLE column or SQL expression, the same in any order.

    Values count with ``scale`` decimals, at least one. They are cut into whole
    numbers of six decimal digits each, and these are added as BIGINT: a decimal
    cast of every row would cost more than the rest of a report. Nine trillion
    rows fit in one group; beyond, ANSI mode raises. It does so too for infinite
    values, NaN and values whose millions do not fit in a BIGINT.
    """
    if scale < 1:
        raise ValueError("an exact sum needs at least one decimal")
    millions = f"CAST({number} / 1e{DIGITS}D AS BIGINT)"
    rest = f"({number} - {millions} * 1e{DIGITS}D)"
    ones = f"CAST({rest} AS BIGINT)"
    parts = [(millions, str(10**DIGITS)), (ones, "1")]
    rest, done = f"({rest} - {ones})", 0
    for digits in _steps(scale):
        done += digits
        scaled = f"({rest} * 1e{digits}D)"
        # The casts cut towards zero, so what is left is exact for either sign.
        part = f"CAST(rint({scaled}) AS BIGINT)" if done == scale else f"CAST({scaled} AS BIGINT)"
        parts.append((part, f"0.{1:0{done}d}"))
        rest = f"({scaled} - {part})"
    # 37 digits, so that adding two of them keeps every decimal.
    kind = f"DECIMAL(37,{scale})"
    total = f"CAST(0 AS {kind})"
    for part, unit in parts:
        total = f"CAST({total} + CAST(CAST(sum({part}) AS DECIMAL(19,0)) * {unit} AS {kind}) AS {kind})"
    return F.expr(total)


def _steps(scale: int) -> list[int]:
    """Digits of the fractional parts, six at most: 18 is [6, 6, 6] and 4 is [4]."""
    return [min(DIGITS, scale - done) for done in range(0, scale, DIGITS)]


def mean(total: Column, count: Column) -> Column:
    """Mean from a sum and a count of the same non-null values; null when there are none."""
    return F.try_divide(total.cast("double"), count.cast("double"))


def money(column: Column, digits: int = 2) -> Column:
    """A decimal total rounded half-up to ``digits`` places, as DOUBLE for output."""
    return F.round(column, digits).cast("double")


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` of two counts; null instead of an error when ``whole`` is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def add(left: Column, right: Column) -> Column:
    """Sum of two columns; null on overflow."""
    return F.try_add(left, right)


def floor_div(left: Column, right: Column) -> Column:
    """Integer division rounding towards minus infinity; null for a zero divisor."""
    exact_multiple = F.try_mod(left, right) == 0
    signs_differ = (left < 0) != (right < 0)
    # Division truncates towards zero, which is one too high for inexact negative quotients.
    truncated = F.when(right != 0, F.call_function("div", left, right))
    return F.when(exact_multiple | ~signs_differ, truncated).otherwise(truncated - 1)


def page_count(rows: Column, page_size: Column) -> Column:
    """How many pages of ``page_size`` hold ``rows`` rows; the last may be short."""
    return F.when(page_size > 0, F.ceil(rows.cast("decimal(20,0)") / page_size).cast("bigint"))
