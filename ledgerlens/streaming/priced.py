"""A store of priced trades whose waiting ones move over once their block and rate arrive.

``ingest.append_trades`` keeps unpriced trades in a folder that only grows, and every read
prices all of it again. Here micro-batches land in segments under a manifest, and
:meth:`PricedStore.reprice` moves what the calendar knows by now from the waiting rows to the
priced ones. The manifest names the rows in force, so that each trade is read exactly once
whichever write a failure falls between.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ledgerlens.plans.enrich import Calendar, on_block, with_usd_price
from ledgerlens.sources.manifest import Manifest


class Part(NamedTuple):
    """The priced or the waiting rows of a folder."""

    folder: str
    priced: bool
    rows: int


class PricedStore:
    """Trades in segments: priced rows with their date and rate, waiting rows as they came.

    ``trades`` gives the columns, streaming or not; ``calendar`` those of the prices. A
    waiting trade is one whose block or rate is unknown, nulls included. Repeated
    trades stay repeated, and a date with several rates gives a row for each, as in
    ``with_usd_price``.
    """

    #: A row is a part of a folder, or the newest batch of a stream (without a folder).
    COLUMNS = "folder STRING, priced BOOLEAN, rows BIGINT, stream STRING, batch BIGINT"

    def __init__(self, path: str, trades: DataFrame, calendar: Calendar) -> None:
        self.spark = trades.sparkSession
        self.path = path.rstrip("/")
        self.manifest = Manifest(self.spark, path, self.COLUMNS)
        self._trade_columns = trades.columns
        self._schema = with_usd_price(trades, calendar).schema

    # -- what is in force -----------------------------------------------------------

    def _state(self) -> tuple[list[Part], list[Part], dict[str, int]]:
        """The parts with priced rows, those with waiting rows, and the newest batch of each stream."""
        rows = self.manifest.rows()
        parts = [Part(r.folder, r.priced, r.rows) for r in rows if r.folder]
        return ([p for p in parts if p.priced], [p for p in parts if not p.priced],
                {r.stream: r.batch for r in rows if r.stream is not None})

    def parts(self, priced: bool) -> list[Part]:
        """The parts with priced or with waiting rows."""
        return self._state()[0 if priced else 1]

    def _commit(self, parts: Sequence[Part], progress: dict[str, int]) -> None:
        self.manifest.commit([
            *[(*part, None, None) for part in parts],
            *[(None, None, None, stream, batch) for stream, batch in progress.items()]])

    def _write(self, rows: DataFrame) -> list[Part]:
        """Write ``rows`` (with ``priced``) to a new folder; the parts that are not empty."""
        folder = f"segments/{uuid.uuid4().hex}"
        rows.write.partitionBy("priced").parquet(f"{self.path}/{folder}")
        counts = self._folder(folder).groupBy("priced").agg(F.count(F.lit(1)).alias("rows")).collect()
        return [Part(folder, r.priced, r.rows) for r in counts]

    # -- growing ----------------------------------------------------------------------

    def _priced_or_not(self, trades: DataFrame, calendar: Calendar) -> DataFrame:
        joined = with_usd_price(trades, calendar, how="left")
        return joined.withColumn("priced", F.col("date").isNotNull())

    def absorb(self, arrived: DataFrame, calendar: Calendar, stream: str, batch: int) -> bool:
        """Add batch number ``batch`` of a stream, whose numbers grow; one that is held changes nothing."""
        priced, waiting, progress = self._state()
        if batch <= progress.get(stream, -1):
            return False
        added = self._write(self._priced_or_not(arrived.select(*self._trade_columns), calendar))
        self._commit([*priced, *waiting, *added], progress | {stream: batch})
        return True

    def follow(self, trades: DataFrame, calendar: Calendar, checkpoint: str, stream: str = "trades") -> StreamingQuery:
        """Take up the waiting files of a stream, then stop.

        A batch that is replayed after a failure is held already or was never named,
        so it counts once. The name ``stream`` goes with its ``checkpoint``: a new checkpoint,
        which begins at batch 0 again, needs a new name.
        """
        def take(arrived: DataFrame, batch: int) -> None:
            self.absorb(arrived, calendar, stream, batch)

        writer = trades.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()

    def reprice(self, calendar: Calendar) -> bool:
        """Move the waiting trades that ``calendar`` knows to the priced ones; whether there were any.

        Reads waiting rows only and rewrites those that wait on. Nothing is written when
        no trade can move.
        """
        priced, waiting, progress = self._state()
        if not waiting or on_block(self._waiting(waiting), calendar, "left_semi").isEmpty():
            return False
        moved = self._write(self._priced_or_not(self._waiting(waiting), calendar))
        self._commit([*priced, *moved], progress)
        return True

    def compact(self, rows: int) -> bool:
        """Merge the priced parts of fewer than ``rows`` rows; whether there were several.

        Larger ones are left alone, so a trade is rewritten a few times, not at each call.
        """
        priced, waiting, progress = self._state()
        small = [p for p in priced if p.rows < rows]
        if len(small) < 2:
            return False
        merged = self._write(self._read(small).withColumn("priced", F.lit(True)).hint("rebalance"))
        self._commit([*[p for p in priced if p not in small], *waiting, *merged], progress)
        return True

    def vacuum(self) -> None:
        """Remove the folders that only older versions name; what still reads them will fail."""
        self.manifest.vacuum()

    # -- reading ----------------------------------------------------------------------

    def _folder(self, folder: str) -> DataFrame:
        schema = StructType(list(self._schema.fields)).add("priced", "boolean")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")

    def _read(self, parts: Sequence[Part]) -> DataFrame:
        """The rows of ``parts``, which are all priced or all waiting: one scan of their folders."""
        if not parts:
            return self.spark.createDataFrame([], self._schema)
        paths = [f"{self.path}/{p.folder}/priced={str(p.priced).lower()}" for p in parts]
        return self.spark.read.schema(self._schema).parquet(*paths)

    def _waiting(self, parts: Sequence[Part]) -> DataFrame:
        return self._read(parts).select(*self._trade_columns)

    def waiting(self) -> DataFrame:
        """The trades that had no block or rate when they were last looked at."""
        return self._waiting(self.parts(False))

    def priced(self, calendar: Calendar | None = None) -> DataFrame:
        """The priced trades; with ``calendar`` also the waiting ones that it prices by now."""
        stored = self._read(self.parts(True))
        if calendar is None:
            return stored
        return stored.unionByName(with_usd_price(self.waiting(), calendar))
