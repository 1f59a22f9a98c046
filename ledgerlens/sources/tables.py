"""Table readers: files or JDBC, with declared schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


FETCH_ROWS = "10000"


@dataclass(frozen=True)
class Source:
    """Where a table lives. Connection options come from the caller's configuration.

    ``partition_column`` with bounds splits a JDBC read into ``partitions`` range
    queries. The bounds only set the strides: rows outside them are read too, so
    the result equals the unsplit read. File sources are split by Spark itself.
    """

    format: str
    path: str | None = None
    table: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)
    partition_column: str | None = None
    lower: int | None = None
    upper: int | None = None
    partitions: int = 10


def jdbc_options(source: Source) -> dict[str, str]:
    """Reader options of a JDBC source, with the range split when one is asked for."""
    if not source.table:
        raise ValueError("a JDBC source needs a table")
    # Without a fetch size some drivers load a whole partition into memory at once.
    options = {"fetchsize": FETCH_ROWS, **source.options, "dbtable": source.table}
    if source.partition_column:
        if source.lower is None or source.upper is None:
            raise ValueError("a split JDBC read needs a lower and an upper bound")
        options |= {
            "partitionColumn": source.partition_column,
            "lowerBound": str(source.lower),
            "upperBound": str(source.upper),
            "numPartitions": str(source.partitions),
        }
    return options


def read_table(spark: SparkSession, source: Source, columns: Sequence[str] | None = None) -> DataFrame:
    """Scan a table. Columns and later filters are pushed to the source."""
    reader = spark.read.format(source.format)
    if source.format == "jdbc":
        df = reader.options(**jdbc_options(source)).load()
    else:
        df = reader.options(**source.options).load(source.path)
    return df.select(*columns) if columns else df


def conform(
    df: DataFrame, schema: StructType, optional: Sequence[str] = (), strict: bool = True
) -> DataFrame:
    """Exactly the columns of ``schema`` in its types; extra columns are dropped.

    Text that does not convert raises, or reads as null when not ``strict``.
    """
    picked = []
    for column in schema.fields:
        if column.name not in df.columns and column.name in optional:
            picked.append(F.lit(None).cast(column.dataType).alias(column.name))
            continue
        value = F.col(column.name)
        cast = value.cast(column.dataType) if strict else value.try_cast(column.dataType)
        picked.append(cast.alias(column.name))
    return df.select(*picked)


def where_in(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose ``column`` is one of ``values``; pushed to the source."""
    return df.where(F.col(column).isin(*values))


def row_count(df: DataFrame, name: str = "rows") -> DataFrame:
    """The row count as one row."""
    return df.agg(F.count(F.lit(1)).alias(name))


def frame(spark: SparkSession, rows: Mapping[str, Sequence], schema: str) -> DataFrame:
    """A small inline table from columns of values."""
    return spark.createDataFrame(list(zip(*rows.values(), strict=True)), schema)


def empty_frame(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)
