"""Rollups that grow with the chain: new blocks are rolled up once and kept.

A store holds segments, each the rollup of a range of blocks, and a manifest that names
them. Bringing it up to date scans the blocks that are new, and those of a segment that
a window's border cuts. A new manifest is written after its segments; until then the
old one stands, so a job that fails leaves rows that nobody reads. Repeating an update
changes nothing. One job at a time may write to a store.

Rollups merge: counts and sums add up, extremes and last rows are compared. So a report
over many segments equals one over all rows. Rows that arrive for a block already held
are not seen until ``refresh`` takes its segment up again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

from ledgerlens.functions.numeric import mean
from ledgerlens.operators.aggregates import merge_rollup, trade_rollup
from ledgerlens.operators.sets import concat
from ledgerlens.plans.enrich import eth_trades, price_calendar, with_usd_price
from ledgerlens.plans.snapshot import Snapshot
from ledgerlens.plans.views import ALL, SCOPES, TOKEN, WEEK, MarketView, by_scope
from ledgerlens.sources.manifest import Manifest

#: Where the first segment begins: it also holds rows without a block.
FIRST = -(2**63)

MANIFEST = "first_block BIGINT, last_block BIGINT, folder STRING, piece INT"


@dataclass(frozen=True)
class Segment:
    """The rollup of all blocks from ``first`` to ``last``: a part of a folder of the store."""

    first: int
    last: int
    folder: str
    piece: int


class SegmentStore:
    """Segments and manifest of one kind of rollup; the kinds say how rows are rolled up and merged."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.manifest = Manifest(spark, path, MANIFEST)

    def rows(self, snapshot: Snapshot) -> DataFrame:
        """The rows to roll up, with their ``block_number`` as it is stored."""
        raise NotImplementedError

    def rolled(self, snapshot: Snapshot, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """The rollup of ``rows`` by the store's keys and ``keys``."""
        raise NotImplementedError

    def merged(self, rollup: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        """One row for each of the store's keys and ``keys``."""
        raise NotImplementedError

    # -- manifest ----------------------------------------------------------------

    def version(self) -> int:
        """How often the store has changed."""
        return self.manifest.version()

    def segments(self) -> list[Segment]:
        """What the newest manifest holds, by block."""
        held = [Segment(r.first_block, r.last_block, r.folder, r.piece) for r in self.manifest.rows()]
        return sorted(held, key=lambda s: s.first)

    def _commit(self, segments: Sequence[Segment]) -> None:
        self.manifest.commit([(s.first, s.last, s.folder, s.piece) for s in segments])

    def _write(self, rollup: DataFrame, ranges: Sequence[tuple[int, int]]) -> list[Segment]:
        folder = f"segments/{uuid.uuid4().hex}"
        rollup.write.option("compression", "zstd").partitionBy("piece").parquet(f"{self.path}/{folder}")
        return [Segment(first, last, folder, i) for i, (first, last) in enumerate(ranges)]

    # -- growing -----------------------------------------------------------------

    def cover(self, snapshot: Snapshot, cuts: Sequence[int] = (), upto: int | None = None) -> bool:
        """Hold all blocks up to ``upto`` (the newest known); whether anything had to be done.

        No segment reaches over a block of ``cuts`` from below it: a window's first block
        and the one after its last make it a set of whole segments.
        """
        newest = snapshot.blocks.agg(F.max("block_number")).first()[0]
        if newest is None:
            return False
        newest = newest if upto is None else min(newest, upto)
        held = self.segments()
        split = [s for s in held if any(s.first < c <= s.last for c in cuts)]
        wanted = [(s.first, s.last) for s in split]
        begin = held[-1].last + 1 if held else FIRST
        if begin <= newest:
            wanted.append((begin, newest))
        return self._roll(snapshot, [r for first, last in wanted for r in _cut(first, last, cuts)],
                          [s for s in held if s not in split])

    def refresh(self, snapshot: Snapshot, first: int, last: int) -> bool:
        """Roll up again every segment with blocks from ``first`` to ``last``, for rows that came late."""
        held = self.segments()
        stale = [s for s in held if s.first <= last and s.last >= first]
        return self._roll(snapshot, [(s.first, s.last) for s in stale], [s for s in held if s not in stale])

    def _roll(self, snapshot: Snapshot, ranges: Sequence[tuple[int, int]], kept: Sequence[Segment]) -> bool:
        """Roll up ``ranges`` in one scan that the block bounds reach, and commit them beside ``kept``."""
        if not ranges:
            return False
        block = F.col("block_number")
        inside = [
            block.between(first, last) if first > FIRST else block.isNull() | (block <= last) for first, last in ranges]
        wanted, piece = inside[0], F.when(inside[0], 0)
        for i, test in enumerate(inside[1:], 1):
            wanted, piece = wanted | test, piece.when(test, i)
        rows = self.rows(snapshot).where(wanted).withColumn("piece", piece)
        self._commit([*kept, *self._write(self.rolled(snapshot, rows, ["piece"]), ranges)])
        return True

    def compact(self, before: int) -> bool:
        """Merge all segments that end before block ``before`` into one; whether there were several."""
        held = self.segments()
        old = [s for s in held if s.last < before]
        if len(old) < 2:
            return False
        merged = self.merged(self.read(old)).withColumn("piece", F.lit(0))
        (segment,) = self._write(merged, [(old[0].first, old[-1].last)])
        self._commit([segment, *[s for s in held if s not in old]])
        return True

    def vacuum(self) -> None:
        """Remove the folders that only older manifests name; reports that still read them will fail."""
        self.manifest.vacuum()

    # -- reading -----------------------------------------------------------------

    @property
    def schema(self) -> StructType:
        """The columns of a segment."""
        raise NotImplementedError

    def read(self, segments: Sequence[Segment], window: tuple[int, int] | None = None) -> DataFrame:
        """The rows of ``segments`` as they are stored, with ``in_week`` if there is a ``window``."""
        frames = []
        for folder in sorted({s.folder for s in segments}):
            own = [s for s in segments if s.folder == folder]
            rows = self.spark.read.schema(self.schema.add("piece", IntegerType())).parquet(f"{self.path}/{folder}")
            rows = rows.where(F.col("piece").isin([s.piece for s in own]))
            if window:
                lo, hi = window
                inside = [s.piece for s in own if lo <= s.first and s.last <= hi]
                rows = rows.withColumn("in_week", F.col("piece").isin(inside) if inside else F.lit(False))
            frames.append(rows.drop("piece"))
        if not frames:
            empty = self.schema.add("in_week", BooleanType()) if window else self.schema
            return self.spark.createDataFrame([], empty)
        return concat(*frames)


def _cut(first: int, last: int, cuts: Sequence[int]) -> list[tuple[int, int]]:
    borders = [first, *sorted({c for c in cuts if first < c <= last}), last + 1]
    return [(a, b - 1) for a, b in zip(borders, borders[1:])]


class TradeStore(SegmentStore):
    """Trade measures by token and market (where the trades have one)."""

    def __init__(self, spark: SparkSession, path: str, snapshot: Snapshot) -> None:
        super().__init__(spark, path)
        self.keys = [*TOKEN, *["market"] * ("market" in snapshot.trades.columns)]
        self._schema = self.rolled(snapshot, self.rows(snapshot), []).schema

    @property
    def schema(self) -> StructType:
        return StructType(list(self._schema.fields))

    def rows(self, snapshot: Snapshot) -> DataFrame:
        return eth_trades(snapshot)

    def rolled(self, snapshot: Snapshot, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        priced = with_usd_price(rows, price_calendar(snapshot))
        return trade_rollup(priced, [*self.keys, *keys], snapshot.scale)

    def merged(self, rollup: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        kinds = {f.name: f.dataType for f in self._schema.fields}
        return merge_rollup(rollup, [*self.keys, *keys]).select(
            *[F.col(c).cast(kinds[c]).alias(c) if c in kinds else c for c in [*kinds, *keys]])


class HoldingStore(SegmentStore):
    """The last transfer of every token and the number of its transfers."""

    _VALUES = ["block_number", "to_address", "from_address"]

    def __init__(self, spark: SparkSession, path: str, snapshot: Snapshot) -> None:
        super().__init__(spark, path)
        self._schema = self.rolled(snapshot, self.rows(snapshot), []).schema

    @property
    def schema(self) -> StructType:
        return StructType(list(self._schema.fields))

    def rows(self, snapshot: Snapshot) -> DataFrame:
        return snapshot.transfers

    def rolled(self, snapshot: Snapshot, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        return self._grouped(rows, keys)

    def _grouped(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        return rows.groupBy(*TOKEN, *keys).agg(
            F.max(F.struct(*self._VALUES)).alias("last"), F.count(F.lit(1)).alias("transfers"))

    def everything(self, snapshot: Snapshot, window: tuple[int, int]) -> DataFrame:
        """All segments, and the transfers of blocks beyond them, which the block table lacks so far."""
        held = self.segments()
        beyond = F.col("block_number") > held[-1].last if held else F.lit(True)
        rest = self._grouped(snapshot.transfers.where(beyond), []).withColumn("in_week", F.lit(False))
        return self.read(held, window).unionByName(rest)

    def merged(self, rollup: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        return rollup.groupBy(*TOKEN, *keys).agg(F.max("last").alias("last"), F.sum("transfers").alias("transfers"))


class ArrivalStore(HoldingStore):
    """Last transfers fed by batches of arriving rows, in whatever order their blocks come.

    A segment holds a range of batches here. The last transfer is the largest by block,
    not by arrival, so late blocks need no special case.
    """

    #: Segments beyond this many are merged, so a report reads few files a token.
    MOST_SEGMENTS = 32

    def __init__(self, spark: SparkSession, path: str, transfers: DataFrame) -> None:
        SegmentStore.__init__(self, spark, path)
        self._schema = self._grouped(transfers, []).schema

    def absorb(self, arrived: DataFrame, batch: int) -> bool:
        """Add the rows of batch number ``batch``; a batch that is held already changes nothing."""
        held = self.segments()
        if any(s.first <= batch <= s.last for s in held):
            return False
        rollup = self._grouped(arrived, []).withColumn("piece", F.lit(0))
        self._commit([*held, *self._write(rollup, [(batch, batch)])])
        if len(held) >= self.MOST_SEGMENTS:
            self.compact(self._unbroken())
        return True

    def _unbroken(self) -> int:
        """The first batch after those held without a gap; only these may become one range."""
        after = 0
        for i, s in enumerate(self.segments()):
            if i and s.first != after:
                break
            after = s.last + 1
        return after

    def holders(self) -> DataFrame:
        """Last receiver and sender of every token in the batches so far."""
        return self.merged(self.read(self.segments())).select(*TOKEN, "last.to_address", "last.from_address")


class RolledView(MarketView):
    """A market view that answers from stores which cover its window; only labels and
    what stores do not hold is read from the tables."""

    def __init__(
        self, view: MarketView, trades: TradeStore | None = None, holdings: HoldingStore | None = None
    ) -> None:
        """Bring the stores up to date and cut them at the view's window.

        Reports that ask for trades only, or for transfers only, need but that store.
        """
        self.__dict__.update(view.__dict__)
        bounds = view.window.frame().first()
        self._bounds = (0, -1) if bounds.start_block is None else (bounds.start_block, bounds.end_block)
        cuts = [] if bounds.start_block is None else [bounds.start_block, bounds.end_block + 1]
        for store in filter(None, (trades, holdings)):
            store.cover(view.snapshot, cuts)
        self._trades, self._holdings = trades, holdings

    def _rolled(self) -> DataFrame:
        return self._trades.read(self._trades.segments(), self._bounds)

    def in_week(self) -> Column:
        return F.col("block_number").between(*self._bounds)

    def measures(self, keys: Sequence[str], scope: str = ALL) -> DataFrame:
        if self._trades is None:
            return super().measures(keys, scope)
        fine = list(dict.fromkeys([*keys, "contract_address"]))
        rows = self._rolled().where("in_week") if scope == WEEK else self._rolled()
        labelled = merge_rollup(rows, fine).join(self.labels, "contract_address")
        return labelled if set(fine) == set(keys) else merge_rollup(labelled, keys)

    def finest(self, keys: Sequence[str]) -> DataFrame:
        if self._trades is None:
            return super().finest(keys)
        return merge_rollup(self._rolled(), [*keys, "in_week"]).join(self.labels, "contract_address")

    def token_extents(self) -> DataFrame:
        if self._trades is None:
            return super().token_extents()
        of_scope = {ALL: F.lit(True), WEEK: F.col("in_week")}

        def within(scope: str, column: str) -> Column:
            return F.when(of_scope[scope], F.col(column))

        tokens = self._rolled().groupBy(*TOKEN).agg(*[f for s in SCOPES for f in (
            F.sum(within(s, "trades")).alias(f"{s}_trades"), F.sum(within(s, "eth")).alias(f"{s}_sum"),
            F.sum(within(s, "eth_prices")).alias(f"{s}_prices"), F.max(within(s, "price_max")).alias(f"{s}_top"))])
        return tokens.join(self.labels, "contract_address").withColumns({
            f"{s}_mean": mean(F.col(f"{s}_sum"), F.col(f"{s}_prices")) for s in SCOPES})

    def scoped_tokens(self) -> DataFrame:
        if self._trades is None:
            return super().scoped_tokens()
        tokens = self._rolled().groupBy(*TOKEN).agg(F.max("in_week").alias("in_week"))
        counted = by_scope(tokens).groupBy("scope", "contract_address").agg(F.count(F.lit(1)).alias("tokens"))
        return counted.join(self.labels, "contract_address")

    def first_trades(self) -> DataFrame:
        if self._trades is None:
            return super().first_trades()
        first = self._rolled().groupBy("contract_address").agg(F.min("first_block").alias("first_block"))
        return first.join(self.labels, "contract_address")

    def rollups(self, stored: Callable[[str, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """The segments are stored already, so each rollup merges them, and only what it leaves meets the labels."""
        if self._trades is None:
            return super().rollups(stored)
        rows = by_scope(self._rolled())
        markets = merge_rollup(rows, ["scope", "contract_address", "market"]).join(self.labels, "contract_address")
        return (self._labelled(merge_rollup(rows, ["scope", *TOKEN]), ["scope", *TOKEN]),
                merge_rollup(markets, ["scope", "market"]))

    def _labelled(self, rollup: DataFrame, keys: Sequence[str]) -> DataFrame:
        """``rollup`` (one row for each of ``keys``) by ``keys`` and collection name.

        A collection that is listed several times under a name counts as often. Only such rows
        are merged after the join, so that it stays free to split a hot collection.
        """
        names = self.labels.groupBy("contract_address", "contract_name").agg(F.count(F.lit(1)).alias("copies"))
        found = rollup.join(names, "contract_address")
        copies = F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy")
        again = found.where("copies > 1").select("*", copies)
        every = found.where("copies = 1").select(*keys, "contract_name", *[c for c in rollup.columns if c not in keys])
        return every.unionByName(merge_rollup(again, [*keys, "contract_name"]))

    # -- transfers ---------------------------------------------------------------

    def held(self) -> DataFrame:
        if self._holdings is None:
            return super().held()
        merged = self._holdings.merged(self._holdings.everything(self.snapshot, self._bounds))
        return merged.select(*TOKEN, "last.to_address", "last.from_address", "transfers")

    def holders(self) -> DataFrame:
        return self.held().select(*TOKEN, "to_address", "from_address")

    def transfers_by(self, keys: Sequence[str], scope: str = ALL) -> DataFrame:
        if self._holdings is None or not set(keys) <= set(TOKEN):
            return super().transfers_by(keys, scope)
        rows = self._holdings.everything(self.snapshot, self._bounds)
        rows = rows.where("in_week") if scope == WEEK else rows
        return rows.groupBy(*keys).agg(F.coalesce(F.sum("transfers"), F.lit(0)).alias("transfers"))

    def scoped_transfers(self) -> DataFrame:
        if self._holdings is None:
            return super().scoped_transfers()
        return concat(*[
            self.transfers_by([], s).select(F.lit(s).alias("scope"), "transfers") for s in SCOPES])

    def tokens_by_contract(self) -> DataFrame:
        return self.held().groupBy("contract_address").agg(F.count(F.lit(1)).alias("tokens"))
