"""Report sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

# Console size of a printed report table.
SHOW_ROWS = 20
SHOW_WIDTH = 100


def show(df: DataFrame) -> None:
    df.show(SHOW_ROWS, truncate=SHOW_WIDTH)


def write_report(df: DataFrame, path: str, format: str = "json") -> None:
    """Write a finished report, replacing an earlier one at ``path``."""
    df.write.format(format).mode("overwrite").save(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a table as parquet. Trades partitioned by date let weekly reports skip files.

    Rows of one value are brought together to avoid many small files; the rebalance
    hint still splits a hot value over several tasks and files.
    """
    if not partition_by:
        df.write.mode("overwrite").parquet(path)
        return
    balanced = df.hint("rebalance", *partition_by)
    balanced.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
