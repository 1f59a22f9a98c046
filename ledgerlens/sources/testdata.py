"""The five report tables as selections on the star-schema test data.

One block per day keeps block numbers increasing with the date. Keys keep the
types of the test data; the operators do not depend on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.operators.joins import CALENDAR_DAYS
from ledgerlens.plans.snapshot import Snapshot
from ledgerlens.sources import layout

# Fixed values of the fixtures.
WEEK_START = "1995-03-06"
WEEK_DAYS = 7
WEEK_BEFORE = "1995-02-27"
LATE_CUTOFF = "1998-11-15"
FIRST_UPDATE = 9861  # the day 1996-12-31
CURRENCIES = ("A", "N")
FIRST_BLOCK = 9131  # the day 1995-01-01
SCALE = 4
SMALL_PART = 1 << 20  # rows


# Declared, so that building a plan reads no file footers.
SCHEMAS = {
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
            "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def day_number(column: str) -> str:
    """SQL text of the days since 1970-01-01."""
    return f"CAST(unix_date(CAST({column} AS DATE)) AS BIGINT)"


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size > 2").selectExpr(
        "p_partkey AS contract_address",
        "p_type AS contract_type",
        "p_name AS contract_name",
        "p_brand AS contract_symbol",
        f"{FIRST_BLOCK} + p_partkey AS init_block",
    )


def _days_as_blocks(table_: DataFrame, column: str) -> DataFrame:
    number = day_number("date")
    return table_.selectExpr(f"CAST({column} AS DATE) AS date").distinct().selectExpr(
        f"{number} AS block_number", f"{number} * 86400 AS timestamp_of_block", "date"
    )


def ship_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days_as_blocks(table(spark, sf_dir, "lineitem"), "l_shipdate")


def order_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days_as_blocks(table(spark, sf_dir, "orders"), "o_orderdate")


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_blocks(spark, sf_dir).selectExpr(
        "date", "CAST(1000 + block_number % 997 AS DOUBLE) AS eth_usd_rate"
    )


def _lines(spark: SparkSession, sf_dir: str, parties: bool) -> DataFrame:
    """Lines, with ``parties`` those that have an order, with its columns."""
    lines = table(spark, sf_dir, "lineitem")
    if parties:
        orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
        lines = lines.join(orders, "l_orderkey")
    return lines


def _sales(lines: DataFrame) -> DataFrame:
    """Lines as sales; those without an order have no buyer and market."""
    columns = [
        "'T' || l_orderkey AS transaction_hash",
        f"{day_number('l_shipdate')} AS block_number",
        "l_partkey AS contract_address",
        "l_suppkey AS token_id",
        "'S' || l_suppkey AS seller",
        "l_returnflag AS currency_address",
        "l_extendedprice AS price_value",
    ]
    if "o_custkey" in lines.columns:
        columns += ["'C' || o_custkey AS buyer", "o_orderpriority AS market"]
    return lines.selectExpr(*columns)


def trades(spark: SparkSession, sf_dir: str, parties: bool = True) -> DataFrame:
    """Sales. Buyer and market come from the order, which every line has exactly one of;
    without ``parties`` both columns are left out and the order table is not read."""
    return _sales(_lines(spark, sf_dir, parties))


def clustered_trades(spark: SparkSession, sf_dir: str, name: str, path: str) -> DataFrame:
    """Sales with ``parties`` as table ``name``, in buckets by collection, or by token if one is hot.

    For what asks for sales many times: lines meet their orders once, and groupings by token
    or collection move none of them. Buckets are measured on the lines alone, since the join
    leaves these as they are.
    """
    lines = _lines(spark, sf_dir, parties=True).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_extendedprice", "o_custkey", "o_orderpriority")
    keys = ["l_partkey", "l_suppkey"]
    layout.write_clustered(
        lines, name, [keys[:1], keys], keys, path=path, least=8, measured=table(spark, sf_dir, "lineitem"))
    return _sales(spark.table(name))


def transfers(sales: DataFrame) -> DataFrame:
    """The same rows as the trades, in any currency."""
    receiver = ["buyer AS to_address"] if "buyer" in sales.columns else []
    return sales.selectExpr(
        "transaction_hash", "contract_address", "token_id", "block_number",
        "seller AS from_address", *receiver,
    )


def snapshot(
    spark: SparkSession, sf_dir: str, parties: bool = False, blocks: DataFrame | None = None,
    sales: DataFrame | None = None,
) -> Snapshot:
    sales = trades(spark, sf_dir, parties) if sales is None else sales
    return Snapshot(
        contracts=contracts(spark, sf_dir),
        blocks=ship_blocks(spark, sf_dir) if blocks is None else blocks,
        rates=rates(spark, sf_dir),
        trades=sales,
        transfers=transfers(sales),
        currencies=CURRENCIES,
        scale=SCALE,
        # Distinct dates, so both are bounded by the calendar.
        block_bound=CALENDAR_DAYS,
        rate_bound=CALENDAR_DAYS,
        rates_per_day=1,
    )


def _minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "*", "CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 60000000) AS BIGINT) AS block_number", "CAST(ts AS DATE) AS date")


def minute_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades; a block is a minute."""
    return _minutes(spark, sf_dir).selectExpr("event_id", "block_number", "value AS price_value")


def minute_snapshot(spark: SparkSession, sf_dir: str) -> Snapshot:
    """Blocks with gaps and repeats, and days with no, one or two rates."""
    minutes = _minutes(spark, sf_dir)
    seen = minutes.where("user_id % 7 <> 0").select("block_number", "date").distinct()
    days = minutes.select("date").distinct().selectExpr("date", f"{day_number('date')} AS day")
    rates = days.where("day % 10 <> 0").selectExpr("date", "CAST(1000 + day % 997 AS DOUBLE) AS eth_usd_rate")
    trades = minute_trades(spark, sf_dir)
    return Snapshot(
        contracts=contracts(spark, sf_dir),
        blocks=seen.unionByName(seen.where("block_number % 3 = 0")),
        rates=rates.unionByName(days.where("day % 3 = 0").selectExpr("date", "1.5D AS eth_usd_rate")),
        trades=trades,
        transfers=trades,
        scale=SCALE,
    )
