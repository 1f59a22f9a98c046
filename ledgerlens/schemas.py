"""Declared schemas of the five source tables.

``token_id`` is text because 256-bit ids do not fit a BIGINT; block numbers are
BIGINT on every table so that joins and ranges compare numbers, never text.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DateType,
    DecimalType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

CONTRACTS = StructType([
    StructField("contract_address", StringType(), False),
    StructField("contract_type", StringType()),
    StructField("contract_name", StringType()),
    StructField("contract_symbol", StringType()),
    StructField("init_block", LongType()),
])

BLOCKS = StructType([
    StructField("block_number", LongType(), False),
    StructField("timestamp_of_block", LongType()),
    StructField("date_of_block", DateType()),
])

RATES = StructType([
    StructField("date_of_rate", DateType(), False),
    StructField("eth_usd_rate", DoubleType()),
])

TRADES = StructType([
    StructField("transaction_hash", StringType()),
    StructField("block_number", LongType()),
    StructField("contract_address", StringType()),
    StructField("token_id", StringType()),
    StructField("seller", StringType()),
    StructField("buyer", StringType()),
    StructField("currency_address", StringType()),
    StructField("price_value", DoubleType()),
    StructField("market", StringType()),
])

TRANSFERS = StructType([
    StructField("transaction_hash", StringType()),
    StructField("contract_address", StringType()),
    StructField("from_address", StringType()),
    StructField("to_address", StringType()),
    StructField("token_id", StringType()),
    StructField("block_number", LongType()),
    StructField("value", DecimalType(38, 0)),
])

TABLES = {
    "contract_info": CONTRACTS,
    "block_info": BLOCKS,
    "rate_info": RATES,
    "trade_record": TRADES,
    "transfer_record": TRANSFERS,
}

# Columns a source may lack; they read as null.
OPTIONAL = {"transfer_record": ("value",)}

# The currencies whose amounts are in ETH, that is the native
# coin (zero address) and wrapped ETH.
CURRENCIES = (
    "0x0000000000000000000000000000000000000000",
    "0xc02aaa39b223fe8d0a0e5c4f27ead9083c756cc2",
)
