"""The five tables a report reads, with the facts its plans rely on."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.intervals import RangeTable
from ledgerlens.schemas import CURRENCIES, OPTIONAL, TABLES
from ledgerlens.sources.tables import Source, conform, read_table

Bound = Callable[[str], Column]


@dataclass(frozen=True)
class Snapshot:
    """Tables under their report names: the dates of blocks and rates are both ``date``.

    ``block_bound`` and ``rate_bound`` are proven upper bounds of the row counts of
    ``blocks`` and ``rates``, and ``rates_per_day`` one of the rates of a date, or None
    when there is none. ``scale`` is the number of decimals in which money is added up.
    ``price_ranges`` is the price calendar as ranges of blocks, see
    ``enrich.with_price_ranges``. ``raw`` has tables as they are stored, before the casts of ``conform``, so that a
    block range can reach their scans; see :meth:`within`.
    """

    contracts: DataFrame
    blocks: DataFrame
    rates: DataFrame
    trades: DataFrame
    transfers: DataFrame
    currencies: Sequence[str] = CURRENCIES
    scale: int = 18
    block_bound: int | None = None
    rate_bound: int | None = None
    rates_per_day: int | None = None
    price_ranges: RangeTable | None = None
    raw: Mapping[str, DataFrame] = field(default_factory=dict)
    shapes: Mapping[str, tuple] = field(default_factory=dict)

    @property
    def calendar_bound(self) -> int | None:
        """Rows the price calendar can have at most: every block with every rate of its date."""
        if self.block_bound is None or self.rates_per_day is None:
            return None
        return self.block_bound * self.rates_per_day

    def within(self, name: str, lo: Bound, hi: Bound) -> DataFrame:
        """``trades`` or ``transfers`` of a range of blocks.

        A bound is a function of a type name, so that a block number stored as INT or
        DECIMAL is compared as such in the scan. Text is compared after its cast only: its
        order is not that of numbers.
        """
        table = getattr(self, name)
        stored = self.raw.get(name)
        column = F.col("block_number")
        kind = stored.schema["block_number"].dataType.simpleString() if stored is not None else ""
        if kind == "int" or re.match(r"decimal\(\d+,0\)", kind):
            table = conform(stored.where(column.between(lo(kind), hi(kind))), *self.shapes[name])
        return table.where(column.between(lo("bigint"), hi("bigint")))


def load_snapshot(
    spark: SparkSession, sources: Mapping[str, Source], strict: bool = True, count: bool = True
) -> Snapshot:
    """Read the five tables of ``TABLES`` from ``sources``.

    With ``count`` the rows of blocks and rates are counted once (a metadata read
    on columnar files), and the rates of a date, which decides whether the price
    calendar is broadcast.
    """
    stored = {name: read_table(spark, sources[name]) for name in TABLES}
    shapes = {name: (schema, OPTIONAL.get(name, ()), strict) for name, schema in TABLES.items()}
    tables = {name: conform(stored[name], *shapes[name]) for name in TABLES}
    blocks = tables["block_info"].withColumnRenamed("date_of_block", "date")
    rates = tables["rate_info"].withColumnRenamed("date_of_rate", "date")
    per_day = rates.groupBy("date").count().agg(F.max("count")) if count else None
    renamed = {"trades": "trade_record", "transfers": "transfer_record"}
    return Snapshot(
        contracts=tables["contract_info"],
        blocks=blocks,
        rates=rates,
        trades=tables["trade_record"],
        transfers=tables["transfer_record"],
        block_bound=blocks.count() if count else None,
        rate_bound=rates.count() if count else None,
        rates_per_day=(per_day.first()[0] or 0) if count else None,
        raw={name: stored[table] for name, table in renamed.items()},
        shapes={name: shapes[table] for name, table in renamed.items()},
    )
