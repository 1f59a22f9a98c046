"""Text functions: number extraction, report lines, URL shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shape of an accepted URL. Scheme, optional user and password, a
# dotted host name, localhost or an IPv4 address, optional port, optional path or query.
URL_PATTERN = (
    r"^(https?|ftps?)://"
    r"([^\s/?#:@]+:[^\s/?#:@]*@)?"
    r"(([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z0-9-]*[A-Za-z][A-Za-z0-9-]*\.?"
    r"|localhost|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})"
    r"(:[0-9]+)?"
    r"([/?]\S*)?$"
)


def first_integer(column: Column) -> Column:
    """The first run of digits as BIGINT; null when there is none or it does not fit."""
    return F.regexp_extract(column, r"\d+", 0).try_cast("bigint")


def report_line(template: str, *columns: Column) -> Column:
    """A report sentence from a printf-style template."""
    return F.format_string(template, *columns)


def is_url(column: Column) -> Column:
    return column.rlike(URL_PATTERN)
