"""Date parsing, spans and text forms."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text forms of dates and timestamps in reports.
DATE_FORMAT = "yyyy-MM-dd"
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def as_date(value: str | datetime.date | Column) -> Column:
    """A DATE column from ISO text, a Python date or a column."""
    if isinstance(value, Column):
        return value.cast("date")
    if isinstance(value, datetime.date):
        return F.lit(value).cast("date")
    return F.to_date(F.lit(value), DATE_FORMAT)


def date_span(start: str | datetime.date | Column | None, days: int) -> tuple[Column, Column]:
    """First and last day of ``days`` days from ``start``; without one, the days up to today."""
    if start is None:
        today = F.current_date()
        return F.date_sub(today, days - 1), today
    first = as_date(start)
    return first, F.date_add(first, days - 1)


def date_text(column: Column) -> Column:
    return F.date_format(column, DATE_FORMAT)


def epoch_text(seconds: Column) -> Column:
    """Epoch seconds as UTC text, whatever the session time zone."""
    instant = F.timestamp_add("SECOND", seconds, F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")))
    return F.date_format(instant, TIMESTAMP_FORMAT)
