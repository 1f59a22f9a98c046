"""Shards of near equal size by sampled splitters.

Method: a size-weighted sample of keys gives quantile splitters, many ranges a
shard. The ranges are measured on all rows. An overfull range is divided: a key that
alone fills a range gets a range of its own, the others get splitters from a sample
within the range. A key larger than a whole shard is dealt over several pieces by
row. Pieces are then given to shards, largest first, each to the lightest shard. A
piece of many small rows stays in its shard, but is ranked in several subpieces.

The key of the query is the hash of the text, so equal texts share a piece and a
shard unless they outweigh one. Keys are compared as signed 64-bit numbers.

Scale: rows are carried without their texts. The driver sees the sample
(``SAMPLE`` rows), and one row for each range; both bounds are parameters, neither
grows with a hot key. A slot is a rank within a subpiece of about ``ROWS_PER_RANGE``
rows at most, and these grow in number with the table.

Defined cases: a null text has size 1 (no bytes, plus one) and the checksum of the
empty text. Null ids sort first. Repeated rows are placed each on its own. No rows
give no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import staged, text_or_empty

SAMPLE = 20_000
RANGES_PER_SHARD = 32
ROWS_PER_RANGE = 500_000
MOST_RANGES = 65_536
ROUNDS = 4


def weighted_sample(rows: DataFrame, most: int, total: int) -> np.ndarray:
    """Keys of up to ``most`` rows drawn with odds that follow their sizes, in order.

    Each row draws an exponential time with its size as rate; the earliest are
    taken. About twice as many rows as needed come before the time limit, so tasks
    send few, whatever their number. The draw is a hash of the row, so reruns agree.
    """
    u = (F.pmod(F.xxhash64(F.lit(11), "key", "doc_id", "row"), F.lit(1 << 52)) + 1) / float(1 << 52)
    drawn = rows.select("key", (-F.log(u) / F.col("size")).alias("at"), "row")
    early = drawn.where(F.col("at") <= 2 * most / max(total, 1))
    taken = early.orderBy("at", "key", "row").limit(most).select("key").collect()
    return np.sort(np.array([r.key for r in taken], dtype=np.int64))


def quantiles(sample: np.ndarray, parts: int) -> np.ndarray:
    if not len(sample) or parts < 2:
        return np.empty(0, np.int64)
    at = (np.arange(1, parts) * len(sample)) // parts
    return np.unique(sample[at])


def in_range(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    """``rows`` with ``range``: the number of splitters below the key."""

    @F.pandas_udf("int")
    def find(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, key.to_numpy(), "left").astype(np.int32))

    return rows.withColumn("range", find("key"))


def splitters_of(rows: DataFrame, total: int, ranges: int, sample: int) -> tuple[np.ndarray, set]:
    """Splitters, and the keys that have a range of their own."""
    goal = total / ranges
    splitters, alone = quantiles(weighted_sample(rows, sample, total), ranges), set()
    for _ in range(ROUNDS):
        measured = in_range(rows, splitters)
        full = measured.groupBy("range").agg(F.sum("size").alias("bytes")).where(
            F.col("bytes") > 2 * goal).collect()
        own = {int(np.searchsorted(splitters, k, "left")) for k in alone}
        full = {r.range: r.bytes for r in full if r.range not in own}
        if not full:
            break
        inside = measured.where(F.col("range").isin(list(full)))
        # At most ``ranges`` keys can each hold more than a range's share.
        heavy = [r.key for r in inside.groupBy("key").agg(F.sum("size").alias("bytes"))
                 .where(F.col("bytes") > goal).collect()]
        alone |= set(heavy)
        rest = inside.where(~F.col("key").isin(heavy)) if heavy else inside
        parts = sum(math.ceil(b / goal) for b in full.values())
        edges = [k for h in heavy for k in (max(h - 1, -(1 << 63)), h)]
        splitters = np.unique(np.concatenate([
            splitters, np.array(edges, np.int64), quantiles(
                weighted_sample(rest, sample, sum(full.values())), 2 * parts),
        ]))
    return splitters, alone


def subdivided(placed: DataFrame, rows_of: dict[tuple[int, int], int]) -> DataFrame:
    """``placed`` with ``sub``: pieces (range, part) of many rows are dealt by row."""
    wide = [(*piece, -(-n // ROWS_PER_RANGE)) for piece, n in rows_of.items() if n > ROWS_PER_RANGE]
    if not wide:
        return placed.withColumn("sub", F.lit(0).cast("bigint"))
    subs = placed.sparkSession.createDataFrame(wide, "range INT, part BIGINT, subs BIGINT")
    sub = F.pmod(F.xxhash64(F.lit(13), "doc_id", "row"), F.coalesce("subs", F.lit(1)))
    return placed.join(F.broadcast(subs), ["range", "part"], "left").withColumn("sub", sub).drop("subs")


def shard(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
    sample: int = SAMPLE,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot."""
    text = text_or_empty(text_col)
    rows = staged(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    ), "shard-rows")
    total, count = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    total = total or 0
    ranges = min(MOST_RANGES, max(shards * RANGES_PER_SHARD, count // ROWS_PER_RANGE))
    splitters, alone = splitters_of(rows, total, ranges, sample)

    placed = in_range(rows, splitters)
    own = [(int(np.searchsorted(splitters, k, "left"))) for k in alone]
    bytes_of = {r.range: r.bytes for r in placed.groupBy("range").agg(
        F.sum("size").alias("bytes")).collect()}
    spread = {r: math.ceil(bytes_of[r] * ranges / total) for r in own
              if bytes_of.get(r, 0) > total / shards}
    part = F.lit(0).cast("bigint")
    for r, k in spread.items():  # at most one key a shard is this large
        part = F.when(F.col("range") == r, F.pmod(F.xxhash64("doc_id", "row"), F.lit(k))).otherwise(part)
    placed = staged(placed.withColumn("part", part), "shard-placed")

    pieces = placed.groupBy("range", "part").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    rows_of = {(p.range, p.part): p.n for p in pieces}
    placed = subdivided(placed, rows_of)
    inside = {piece: {0: n} for piece, n in rows_of.items() if n <= ROWS_PER_RANGE}
    if len(inside) < len(rows_of):
        for r in placed.groupBy("range", "part", "sub").count().collect():
            inside.setdefault((r.range, r.part), {})[r.sub] = r["count"]
    load, filled, table = [(0, s) for s in range(shards)], [0] * shards, []
    for p in sorted(pieces, key=lambda p: (-p.bytes, p.range, p.part)):
        held, s = heapq.heappop(load)
        heapq.heappush(load, (held + p.bytes, s))
        for sub, n in sorted(inside[p.range, p.part].items()):
            table.append((p.range, p.part, sub, s, filled[s]))
            filled[s] += n
    # One row for each range, part of a key above a shard's share and subpiece.
    deal = docs.sparkSession.createDataFrame(
        table, "range INT, part BIGINT, sub BIGINT, shard INT, base BIGINT")
    order = Window.partitionBy("range", "part", "sub").orderBy("key", F.col("doc_id").asc_nulls_first(), "row")
    ranked = placed.withColumn("rank", F.row_number().over(order) - 1)
    return ranked.join(F.broadcast(deal), ["range", "part", "sub"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank")).alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """The rows of ``docs`` with a folder for each shard (ids must be unique here)."""
    where = placed.select(F.col("doc_id").alias(id_col), "shard", "slot")
    joined = docs.join(where, id_col)
    joined.repartition("shard", F.floor(F.col("slot") / ROWS_PER_RANGE)).sortWithinPartitions(
        "shard", "slot").write.partitionBy("shard").parquet(path)
