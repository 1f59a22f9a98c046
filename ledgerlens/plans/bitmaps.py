"""Exact distinct counts that merge: a bit for each collection, token or trader of a range of blocks.

``KeyNumbers`` gives every key ever seen a number, once. Numbers are dense, so 32768 keys
share a bitmap of 4 KB. ``MemberStore`` keeps the bitmaps of ranges of blocks under a
manifest; those of several ranges are merged by a bitwise or (distinct in any of them) or
and (in all of them), without going back to trades or keys. A report over all time reads
an eighth of a byte a key and range, where a rollup by token reads a row.

Counts include null as a value. A trade counts if its collection is known when its blocks are
rolled up; ``refresh`` takes a range up again for collections that came late.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.operators.sets import concat
from ledgerlens.plans.enrich import eth_trades, price_calendar, with_usd_price
from ledgerlens.plans.rollups import Segment, SegmentStore
from ledgerlens.plans.snapshot import Snapshot
from ledgerlens.plans.views import ALL, TOKEN, WEEK, MarketView
from ledgerlens.session import remove_path, scratch_path
from ledgerlens.sources.manifest import Manifest

#: What is counted: the key columns of each kind, as expressions on trades.
MEMBERS: dict[str, tuple[str, ...]] = {
    "collections": ("contract_address",),
    "tokens": tuple(TOKEN),
    "traders": ("explode(array(seller, buyer)) AS trader",),
}

#: New keys are numbered in groups of about this many.
KEYS_PER_GROUP = 1_000_000


class KeyNumbers:
    """A number from 1 for every key, kept in folders that a manifest names.

    Keys are dealt to groups by a hash, ranked in their group, and take every n-th number
    of n groups. So no task sees more than a group, and as groups are nearly equal, only
    the last few numbers of an update stay unused. A key that was numbered in a job which
    failed later keeps its number.
    """

    def __init__(self, spark: SparkSession, path: str, keys: StructType) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.names = keys.names
        self.schema = StructType(list(keys.fields)).add("number", "long")
        self.manifest = Manifest(spark, path, "folder STRING, first BIGINT, last BIGINT")

    def known(self) -> DataFrame:
        """Keys and numbers so far."""
        paths = [f"{self.path}/{r.folder}" for r in self.manifest.rows()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def numbered(self, keys: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
        """The distinct ``keys`` with their numbers; new keys get one first.

        The known keys are read once, joined with the keys asked for: adaptive execution broadcasts
        these where they are few, so that an update does not move all known keys. ``write``
        puts an intermediate table into scratch and reads it back.
        """
        known = self.known()
        found = write(keys.join(known, self._same(keys, known)).select(
            *[keys[c] for c in self.names], known["number"]), "known-keys")
        new = write(keys.join(found, self._same(keys, found), "left_anti"), "new-keys")
        learnt = self._learn(new)
        return found if learnt is None else found.unionByName(learnt)

    def _same(self, left: DataFrame, right: DataFrame) -> list[Column]:
        return [left[c].eqNullSafe(right[c]) for c in self.names]

    def _learn(self, new: DataFrame) -> DataFrame | None:
        size = new.count()
        if not size:
            return None
        held = self.manifest.rows()
        first = max((r.last for r in held), default=0) + 1
        groups = -(-size // KEYS_PER_GROUP)
        folder = f"keys/{uuid.uuid4().hex}"
        group = F.pmod(F.xxhash64(*self.names), F.lit(groups))
        place = F.row_number().over(Window.partitionBy("key_group").orderBy(*self.names))
        new.withColumn("key_group", group).select(
            *self.names, (F.lit(first) + (place - 1) * groups + F.col("key_group")).cast("long").alias("number")
        ).write.parquet(f"{self.path}/{folder}")
        learnt = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}")
        last = learnt.agg(F.max("number")).first()[0]
        self.manifest.commit([*[(r.folder, r.first, r.last) for r in held], (folder, first, last)])
        return learnt


class MemberStore(SegmentStore):
    """Bitmaps of what was traded, by kind and 32768 numbers, for ranges of blocks."""

    SCHEMA = "kind STRING, bucket BIGINT, bits BINARY"

    def __init__(self, spark: SparkSession, path: str, snapshot: Snapshot, kinds: Iterable[str] = ("collections", "tokens")) -> None:
        super().__init__(spark, path)
        self.kinds = tuple(kinds)
        rows = eth_trades(snapshot)
        self.numbers = {
            kind: KeyNumbers(spark, f"{self.path}/{kind}", rows.selectExpr(*MEMBERS[kind]).schema) for kind in self.kinds}
        self._scratch: list[str] = []

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.SCHEMA)

    def rows(self, snapshot: Snapshot) -> DataFrame:
        return eth_trades(snapshot)

    def rolled(self, snapshot: Snapshot, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Bitmaps by ``keys``. The members of each kind are written before they are numbered.

        Numbers are shuffled by bucket, not partial bitmaps: a task meets numbers of many buckets,
        and 4 KB for each would be more than the numbers themselves.
        """
        known = snapshot.contracts.select("contract_address").distinct()
        used = sorted({c for c in (*TOKEN, "seller", "buyer") if any(c in e for k in self.kinds for e in MEMBERS[k])})
        priced = self._written(
            with_usd_price(rows, price_calendar(snapshot)).join(known, "contract_address", "left_semi")
            .select(*used, *keys), "priced")

        def numbered(kind: str) -> DataFrame:
            numbers = self.numbers[kind]
            members = self._written(priced.selectExpr(*MEMBERS[kind], *keys).distinct(), kind)
            distinct = self._written(members.select(*numbers.names).distinct(), f"{kind}-keys")
            found = numbers.numbered(distinct, self._written)
            return members.join(found, numbers._same(members, found)).select(F.lit(kind).alias("kind"), *keys, "number")

        # The kinds do not depend on each other; run together they share the executors.
        with ThreadPoolExecutor(max_workers=len(self.kinds)) as pool:
            asked = [pool.submit(inheritable_thread_target(self.spark)(numbered), kind) for kind in self.kinds]
            frames = [a.result() for a in asked]
        placed = concat(*frames).withColumn("bucket", F.bitmap_bucket_number("number"))
        by = ["kind", "bucket", *keys]
        return placed.repartition(*by).groupBy(*by).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")).select("kind", "bucket", "bits", *keys)

    def merged(self, rollup: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        return rollup.groupBy("kind", "bucket", *keys).agg(F.bitmap_or_agg("bits").alias("bits"))

    def _written(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        self._scratch.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _roll(self, snapshot: Snapshot, ranges: Sequence[tuple[int, int]], kept: Sequence[Segment]) -> bool:
        try:
            return super()._roll(snapshot, ranges, kept)
        finally:
            while self._scratch:
                remove_path(self.spark, self._scratch.pop())

    # -- counts ------------------------------------------------------------------

    def of(self, scopes: Mapping[str, tuple[int, int] | None]) -> DataFrame:
        """One bitmap for each scope, kind and bucket. A scope is a range of blocks that is a set
        of whole segments (see ``cover``), or None for all."""
        held = self.segments()
        frames = []
        for scope, blocks in scopes.items():
            own = held if blocks is None else [s for s in held if blocks[0] <= s.first and s.last <= blocks[1]]
            # An empty range cuts nothing.
            cut = [s for s in held if blocks and s not in own and s.first <= blocks[1] and blocks[0] <= min(s.last, blocks[1])]
            if cut:
                raise ValueError(f"{scope} cuts the segment of blocks {cut[0].first} to {cut[0].last}")
            frames.append(self.read(own).withColumn("scope", F.lit(scope)))
        return self.merged(concat(*frames), ["scope"])

    def _counts(self, bitmaps: DataFrame, scopes: Sequence[str]) -> DataFrame:
        """Members by scope, a column for each kind; 0 where there are none."""
        none = self.spark.createDataFrame([(s, None, 0) for s in scopes], "scope STRING, kind STRING, n BIGINT")
        counts = bitmaps.select("scope", "kind", F.bitmap_count("bits").alias("n")).unionByName(none)
        return counts.groupBy("scope").agg(*[
            F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).alias(kind) for kind in self.kinds])

    def distinct(self, scopes: Mapping[str, tuple[int, int] | None]) -> DataFrame:
        """Distinct members of each scope."""
        return self._counts(self.of(scopes), list(scopes))

    def common(self, name: str, scopes: Mapping[str, tuple[int, int] | None]) -> DataFrame:
        """Members that every one of ``scopes`` has, as the scope ``name``."""
        both = self.of(scopes).groupBy("kind", "bucket").agg(
            F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("scopes"))
        shared = both.where(F.col("scopes") == len(scopes)).withColumn("scope", F.lit(name))
        return self._counts(shared, [name])


def _blocks(view: MarketView) -> tuple[int, int] | None:
    bounds = view.window.frame().first()
    return None if bounds.start_block is None else (bounds.start_block, bounds.end_block)


def _covered(store: MemberStore, views: Sequence[MarketView]) -> list[tuple[int, int]]:
    """The stores brought up to date and cut at the windows of ``views``; no block for an empty window."""
    windows = [_blocks(view) for view in views]
    store.cover(views[0].snapshot, [c for w in windows if w for c in (w[0], w[1] + 1)])
    return [w or (0, -1) for w in windows]


def members(store: MemberStore, view: MarketView) -> DataFrame:
    """Distinct members of the week and of all time, from bitmaps alone."""
    (week,) = _covered(store, [view])
    return store.distinct({WEEK: week, ALL: None})


def returning(store: MemberStore, view: MarketView, before: MarketView) -> DataFrame:
    """Distinct members of two windows, of either (``any``) and of both (``both``)."""
    week, earlier = _covered(store, [view, before])
    scopes = {WEEK: week, "before": earlier}
    merged = store.merged(store.of(scopes)).withColumn("scope", F.lit("any"))
    return concat(store.distinct(scopes), store._counts(merged, ["any"]), store.common("both", scopes))
