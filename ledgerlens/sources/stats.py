"""Table statistics from file listings and file footers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.numeric import page_count

TARGET_BYTES = 128 * 1024 * 1024


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """The data files below ``path``, also those without rows; no file is opened."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "[!._]*").load(path)


def file_stats(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """One row per file: file, bytes, rows.

    No column is read, so columnar formats are counted from their footers, each in the
    task that reads its file. Listing and counts meet in one aggregate by file.
    """
    nothing = F.lit(0).cast("bigint")
    files = _listed(spark, path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), nothing.alias("rows"))
    rows = spark.read.format(format).load(path).select(
        F.col("_metadata.file_path").alias("file"), nothing.alias("bytes"), F.lit(1).cast("bigint").alias("rows"))
    return files.unionByName(rows).groupBy("file").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))


def table_stats(
    spark: SparkSession, path: str, format: str = "parquet", target_bytes: int = TARGET_BYTES
) -> DataFrame:
    """Rows, files, bytes and a suggested partition count of a file-based table.

    A file counts once with its size, a row once as a row: one aggregate over both,
    combined in each task, so that one row a task is shuffled.
    """
    nothing = F.lit(0).cast("bigint")
    files = _listed(spark, path).select(
        nothing.alias("rows"), F.lit(1).cast("bigint").alias("files"), F.col("length").alias("bytes"))
    rows = spark.read.format(format).load(path).select(
        F.lit(1).cast("bigint").alias("rows"), nothing.alias("files"), nothing.alias("bytes"))
    totals = files.unionByName(rows).agg(*[
        F.coalesce(F.sum(c), nothing).alias(c) for c in ("rows", "files", "bytes")])
    return totals.select(
        "rows", "files", "bytes",
        page_count(F.col("bytes"), F.lit(target_bytes)).alias("suggested_partitions"),
    )


def table_pages(df: DataFrame, rows_per_page: int) -> DataFrame:
    """Rows, rows per page and the number of pages that hold them."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(rows_per_page).cast("bigint").alias("rows_per_page"),
        page_count(F.col("rows"), F.lit(rows_per_page)).alias("pages"),
    )
