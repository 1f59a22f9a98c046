"""Incremental enrichment: new trade files are priced and appended as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ledgerlens.plans.enrich import Calendar, on_block, with_usd_price


def trade_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None,
    format: str = "parquet",
) -> DataFrame:
    """A stream over the files of a folder or glob, ``files_per_batch`` of them at a time."""
    reader = spark.readStream.schema(schema).format(format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def append_trades(
    trades: DataFrame, calendar: Calendar, output: str, checkpoint: str
) -> StreamingQuery:
    """Append the waiting trades to ``output``, priced if the calendar can, then stop.

    A stateless left join with the static calendar. The folder ``priced=false`` holds
    the trades whose block or rate is not there yet, so none is lost. ``checkpoint``
    records which files are done: a rerun continues, and a failed batch is neither
    lost nor doubled.
    """
    joined = with_usd_price(trades, calendar, how="left")
    return (
        joined.withColumn("priced", F.col("date").isNotNull()).writeStream
        .format("parquet").outputMode("append").partitionBy("priced")
        .option("path", output).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def priced_output(trades: DataFrame, calendar: Calendar, output: str) -> DataFrame:
    """All priced trades in ``output``: those stored, and those that ``calendar`` prices by now."""
    schema = with_usd_price(trades, calendar).schema
    stored = trades.sparkSession.read.schema(schema.add("priced", "boolean")).parquet(output)
    waiting = stored.where("NOT priced").select(*trades.columns)
    return stored.where("priced").drop("priced").unionByName(with_usd_price(waiting, calendar))


def pending(trades: DataFrame, calendar: Calendar, output: str) -> DataFrame:
    """Trades in ``output`` that still lack a block or a rate."""
    schema = with_usd_price(trades, calendar).schema
    stored = trades.sparkSession.read.schema(schema.add("priced", "boolean")).parquet(output)
    waiting = stored.where("NOT priced").select(*trades.columns)
    return on_block(waiting, calendar, "left_anti")


def ingest(trades: DataFrame, calendar: Calendar, output: str, checkpoint: str) -> DataFrame:
    """Run :func:`append_trades` to its end and read everything that has a price.

    Trades appended earlier without a price are priced by the calendar as it is now.
    """
    append_trades(trades, calendar, output, checkpoint).awaitTermination()
    return priced_output(trades, calendar, output)
