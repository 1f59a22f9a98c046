"""Row validation by declared rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import is_url


@dataclass(frozen=True)
class Rule:
    """A column and the test its values must pass. Null fails only when required."""

    name: str
    column: str
    passes: Callable[[Column], Column] | None = None
    required: bool = False

    def broken(self) -> Column:
        value = F.col(self.column)
        missing = value.isNull() if self.required else F.lit(False)
        if self.passes is None:
            return missing
        return missing | (value.isNotNull() & ~F.coalesce(self.passes(value), F.lit(False)))


def required_text(column: str) -> Rule:
    return Rule(f"{column}_required", column, required=True)


def integer(column: str, required: bool = False) -> Rule:
    return Rule(
        f"{column}_integer", column, lambda value: value.try_cast("bigint").isNotNull(), required
    )


def choice(column: str, values: Sequence[str], required: bool = False) -> Rule:
    return Rule(f"{column}_choice", column, lambda value: value.isin(*values), required)


def url(column: str, required: bool = False) -> Rule:
    return Rule(f"{column}_url", column, is_url, required)


def valid_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that pass every rule."""
    for rule in rules:
        df = df.where(~rule.broken())
    return df


def invalid_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that break a rule, with the names of all broken ones in ``violations``."""
    broken = F.concat_ws(",", *[F.when(rule.broken(), F.lit(rule.name)) for rule in rules])
    return df.withColumn("violations", broken).where(F.col("violations") != "")


def violation_counts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Broken and checked rows by rule, in one pass over the table."""
    totals = df.agg(
        F.count(F.lit(1)).alias("checked"),
        *[F.count_if(rule.broken()).alias(rule.name) for rule in rules],
    )
    return totals.unpivot(["checked"], [rule.name for rule in rules], "rule", "violations")
