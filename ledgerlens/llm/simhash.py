"""SimHash near-duplicates by a forest of vantage-point trees.

Fingerprints: ASCII letters are lower-cased, words are runs of non-blanks, and each
four words in a row are hashed by XXH64; a bit is set if it is set in over half of the
hashes. Fingerprints within ``DISTANCE`` bits are linked.

Vantage-point trees cut a set by distance to a chosen fingerprint. Over all 64 bits
nearly everything lies near distance 32, so a radius of 4 prunes little. Hence three
trees, each over a band of the bits: of 4 differing bits at most one lies in some
band, so a tree only needs the radius 1 of its band, and its triangle bounds prune
well. The upper levels come from a bounded sample of fingerprints and name shards; a
fingerprint is stored in the shard of its path and asked in every shard whose
boundary lies within the radius. Each shard grows its own tree below and compares all
64 bits at the leaves, so the links are exact. A link found in several bands counts
in the first.

Points whose band is equal, or nearly, cannot be parted by that band's tree: a family of
near copies would be compared all to all. Their other bits are cut into ``BLOCKS`` blocks, of
which four differing bits leave two untouched, so only points that agree in some two
blocks are compared. Where many do, they are joined through hubs, and only what is then
still apart is compared with the rest. Shards are counted once dealt, and one of more
than ``MOST_POINTS`` is dealt again by those pairs of blocks.

Of the links of a shard only a spanning forest is returned, at most one for each
fingerprint, which loses no connection and keeps dense groups from emitting all their
pairs. Components are then joined by stars of smallest labels, in shuffles of links;
no links, fingerprints or components go to the driver.

Defined cases: a null or empty text, or one of blanks only, has fingerprint zero and is
linked like any other. A text of fewer than four words is one shingle. Rows with
equal fingerprints are one point, so copies cost nothing. Null ids are ignored by the
smallest id of a component, which is null if all its ids are. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import fresh, staged

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Masks of the bands of bits; the trees' radius is DISTANCE over their number.
BANDS = (0x1FFFFF, 0x1FFFFF << 21, 0x3FFFFF << 42)
RADIUS = DISTANCE // len(BANDS)
SAMPLE = 65_536
SHARD_POINTS = 65_536
MOST_LEVELS = 16
LEAF = 128
PAIRS_AT_ONCE = 1 << 21
#: A branch of more points is searched by blocks if its band does not part it.
DENSE = 1024
UNPARTED = 1.7
BLOCKS = 6
HUBS = 16
MOST_POINTS = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


# -- fingerprints ---------------------------------------------------------------


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
        return hashes[0]
    counts, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for first in range(0, n, 65_536):
        last = min(first + 65_536, n)
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(
                starts[first:last].tolist(), ends[first + shingle - 1:last + shingle - 1].tolist())),
            np.uint64, last - first)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(docs: DataFrame, text_col: str = "text", to: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit number."""

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint((t or "").encode()) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return docs.withColumn(to, of(F.col(text_col).cast("string")))


# -- vantage-point trees --------------------------------------------------------


def distances(points: np.ndarray, vantage: np.uint64, mask: int) -> np.ndarray:
    return np.bitwise_count((points ^ vantage) & np.uint64(mask)).astype(np.int64)


def upper_levels(sample: np.ndarray, levels: int, mask: int) -> list[tuple[np.uint64, int]]:
    """Vantage point and boundary of each inner node of a complete tree, top down.

    A node without enough of the sample keeps its parent's vantage and boundary.
    """
    nodes: list[tuple[np.uint64, int]] = []
    parts = [sample]
    for _ in range(levels):
        below = []
        for part in parts:
            if len(part):
                # The point that spreads the others most, of a few.
                tried = [(distances(part, v, mask), v) for v in part[:16]]
                d, vantage = max(tried, key=lambda x: x[0].var())
                boundary = int(np.median(d))
                nodes.append((vantage, boundary))
                below += [part[d <= boundary], part[d > boundary]]
            else:
                nodes.append(nodes[(len(nodes) - 1) // 2] if nodes else (np.uint64(0), 32))
                below += [part, part]
        parts = below
    return nodes


def descend(points: np.ndarray, nodes: list[tuple[np.uint64, int]], levels: int, mask: int,
            radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and leaves: of the path (radius 0), or of all within the radius of it."""
    rows, leaf = np.arange(len(points)), np.zeros(len(points), np.int64)
    for level in range(levels):
        out_rows, out_leaf = [], []
        for node in np.unique(leaf):
            mine = rows[leaf == node]
            vantage, boundary = nodes[(1 << level) - 1 + node]
            d = distances(points[mine], vantage, mask)
            near, far = mine[d - radius <= boundary], mine[d + radius > boundary]
            out_rows += [near, far]
            out_leaf += [np.full(len(near), 2 * node), np.full(len(far), 2 * node + 1)]
        rows, leaf = (np.concatenate(out_rows), np.concatenate(out_leaf)) if out_rows else (rows, leaf)
    return rows, leaf


def links_within(points: np.ndarray, asked: np.ndarray, band: int,
                 dense: Callable[[np.ndarray], None] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (asked, point) of links whose first band within the radius is ``band``.

    Grows a vantage-point tree over the points and takes all askers down together; a
    branch is left out for those whose distance proves it too far. Branches that the band
    does not part go to ``dense``, if there is one, as positions of askers.
    """
    mask = BANDS[band]
    todo = [(np.arange(len(points)), np.arange(len(asked)))]
    while todo:
        p, q = todo.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > LEAF:
            d = distances(points[p], points[p[len(p) // 2]], mask)
            boundary = int(np.median(d))
            near = d <= boundary
            if near.all():  # ties at the median: cut below it
                boundary -= 1
                near = d <= boundary
            if near.any() and not near.all():
                dq = distances(asked[q], points[p[len(p) // 2]], mask)
                inner, outer = q[dq - RADIUS <= boundary], q[dq + RADIUS > boundary]
                if dense is None or len(p) <= DENSE or len(inner) + len(outer) < UNPARTED * len(q):
                    todo.append((p[near], inner))
                    todo.append((p[~near], outer))
                    continue
            if dense is not None and len(p) > DENSE:
                dense(q)
                continue
        step = max(1, PAIRS_AT_ONCE // len(p))
        for i in range(0, len(q), step):
            part = q[i:i + step]
            apart = asked[part][:, None] ^ points[p][None, :]
            a, b = np.nonzero(np.bitwise_count(apart) <= DISTANCE)
            diff = apart[a, b]
            first = np.full(len(diff), len(BANDS))
            for k in range(len(BANDS) - 1, -1, -1):
                first[np.bitwise_count(diff & np.uint64(BANDS[k])) <= RADIUS] = k
            keep = first == band
            yield part[a[keep]], p[b[keep]]


class Forest:
    """Labels of connected positions; links come in blocks."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(self.label, high, low)
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up


def block_pairs(band: int) -> list[int]:
    """Masks of any two blocks of the bits outside a band."""
    rest = [i for i in range(64) if not BANDS[band] >> i & 1]
    masks = [sum(1 << int(i) for i in block) for block in np.array_split(rest, BLOCKS)]
    return [a | b for i, a in enumerate(masks) for b in masks[i + 1:]]


def join_by_blocks(points: np.ndarray, own: np.ndarray, band: int, forest: Forest) -> None:
    """Join all links among ``own`` (positions), found by two equal blocks outside the band."""
    for mask in block_pairs(band):
        join_equal(points, own, mask, forest)


def join_equal(points: np.ndarray, own: np.ndarray, mask: int, forest: Forest) -> None:
    """Join the links among those of ``own`` that agree in the bits of ``mask``."""
    key = points[own] & np.uint64(mask)
    order = np.argsort(key, kind="stable")
    key, at = key[order], own[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    for start, size in zip(starts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist()):
        join_through_hubs(points, at[start:start + size], forest)
    left = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= LEAF), sizes))
    for step in range(1, LEAF):  # each with the one ``step`` places on, while that has its key
        left = left[left + step < len(key)]
        left = left[key[left] == key[left + step]]
        if not len(left):
            break
        a, b = at[left], at[left + step]
        near = np.bitwise_count(points[a] ^ points[b]) <= DISTANCE
        forest.join(a[near], b[near])


def join_through_hubs(points: np.ndarray, own: np.ndarray, forest: Forest) -> None:
    """Join all links among ``own``: through hubs first, then what is apart from the largest tree."""
    for _ in range(HUBS):
        trees, of, sizes = np.unique(forest.label[own], return_inverse=True, return_counts=True)
        if len(trees) == 1:
            return
        outside = np.flatnonzero(of != sizes.argmax())
        hub = own[outside[len(outside) // 2]]
        near = own[np.bitwise_count(points[own] ^ points[hub]) <= DISTANCE]
        forest.join(near, np.full(len(near), hub))
    _, of, sizes = np.unique(forest.label[own], return_inverse=True, return_counts=True)
    apart = own[of != sizes.argmax()]
    step = max(1, PAIRS_AT_ONCE // len(own))
    for i in range(0, len(apart), step):
        part = apart[i:i + step]
        a, b = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[own][None, :]) <= DISTANCE)
        forest.join(part[a], own[b])


def _shard_links(frame: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links of one shard, or of a part of a large one: pairs of fingerprints."""
    band = int(frame["band"].iloc[0])
    fp = frame["fp"].to_numpy(np.int64)
    stored = frame["stored"].to_numpy(bool)
    every = fp.view(np.uint64)
    point_at = np.flatnonzero(stored)
    forest = Forest(len(fp))
    pair = int(frame["pair"].iloc[0])
    if pair >= 0:
        join_equal(every, np.arange(len(fp)), block_pairs(band)[pair], forest)
        return _forest_links(fp, forest)
    # Askers include the points themselves: each stored point is asked in its own shard.
    for q, p in links_within(every[point_at], every, band, lambda own: join_by_blocks(every, own, band, forest)):
        other = point_at[p]
        apart = q != other
        forest.join(q[apart], other[apart])
    return _forest_links(fp, forest)


def _forest_links(fp: np.ndarray, forest: Forest) -> pd.DataFrame:
    linked = np.flatnonzero(forest.label != np.arange(len(fp)))
    return pd.DataFrame({"a": fp[linked], "b": fp[forest.label[linked]]})


def links(points: DataFrame) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints in ``fp`` whose closure is all links."""
    count = points.count()
    levels = min(MOST_LEVELS, max(0, int(np.ceil(np.log2(max(1, count / SHARD_POINTS))))))
    # About two samples pass the first filter, so tasks send few points each.
    early = F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < (2 * SAMPLE << 40) // max(1, count)
    chosen = points.where(early).orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect() if levels else []
    sample = np.array([r.fp for r in chosen], np.int64).view(np.uint64)
    trees = [upper_levels(sample, levels, mask) for mask in BANDS]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            every = fp.view(np.uint64)
            for band, (nodes, mask) in enumerate(zip(trees, BANDS)):
                home = np.zeros(len(fp), np.int64)
                rows, leaf = descend(every, nodes, levels, mask, 0)
                home[rows] = leaf
                rows, leaf = descend(every, nodes, levels, mask, RADIUS)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(rows), band, np.int32)), pa.array(leaf),
                    pa.array(fp[rows]), pa.array(home[rows] == leaf)], ["band", "shard", "fp", "stored"])

    dealt = staged(points.select("fp").mapInArrow(
        deal, "band INT, shard BIGINT, fp BIGINT, stored BOOLEAN"), "dealt-points")
    # Few rows: one for MOST_POINTS points each.
    large = staged(dealt.groupBy("band", "shard").count().where(F.col("count") > MOST_POINTS).select(
        "band", "shard", F.ceil(F.col("count") / SHARD_POINTS).alias("parts")), "large-shards")
    whole = F.array(F.struct(F.lit(-1).alias("pair"), F.lit(0).cast("bigint").alias("part")))
    again = whole
    for band in range(len(BANDS)):
        masks = np.array(block_pairs(band), np.uint64).view(np.int64).tolist()
        again = F.when(F.col("band") == band, F.array(*[
            F.struct(F.lit(i).alias("pair"), F.pmod(F.xxhash64(
                F.col("fp").bitwiseAND(F.lit(mask).cast("bigint"))), F.col("parts")).alias("part"))
            for i, mask in enumerate(masks)])).otherwise(again)
    keyed = dealt.join(large, ["band", "shard"], "left").select(
        "band", "shard", "fp", "stored", F.inline(F.when(F.col("parts").isNotNull(), again).otherwise(whole)))
    return keyed.groupBy("band", "shard", "pair", "part").applyInPandas(_shard_links, "a BIGINT, b BIGINT")


def components(edges: DataFrame) -> DataFrame:
    """The smallest point (root) reachable from each point of ``edges`` (a, b).

    Alternates large and small stars: every point's larger neighbours, then all its
    neighbours, move to the smallest it knows, until nothing moves. Each step is
    written, and so are the smallest neighbours before they are joined, so that
    adaptive execution can split the links of a hub.
    """
    def to_smallest(both: DataFrame) -> DataFrame:
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn(
            "low", F.least("a", "low"))
        return both.join(staged(low, "star-smallest"), "a")

    edges = staged(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = to_smallest(both).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = staged(large.where("a <> b").distinct(), "large-star")
        # Small star: a point and its smaller neighbours all point at the smallest.
        low = staged(large.groupBy("a").agg(F.min("b").alias("low")), "star-smallest")
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct("a", F.col("low").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")
        ).select("e.*").where("a <> b").distinct()
        edges = staged(small, "small-star")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        if state == before:
            return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        before = state


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed), component_id."""
    rows = staged(
        fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
        .select("doc_id", "fp"), "fingerprints")
    points = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "points")
    roots = components(links(points))
    rooted = points.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = staged(rooted.groupBy("root").agg(F.min("smallest").alias("component_id")), "component-ids")
    of_point = staged(rooted.join(least, "root").select("fp", "component_id"), "point-groups")
    return rows.join(of_point, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, of each near-duplicate group only the one with the smallest id.

    Among several rows of that id one stays; a group without ids keeps one row.
    """
    fp, root, row = (fresh(docs, c) for c in ("__fp", "__root", "__row"))
    rows = staged(fingerprints(docs, text_col, fp).withColumn(row, F.monotonically_increasing_id()), "near-rows")
    narrow = rows.select(F.col(fp).alias("fp"), F.col(id_col).alias("doc_id"), F.col(row).alias("row"))
    points = staged(narrow.select("fp").distinct(), "points")
    roots = components(links(points)).withColumnsRenamed({"fp": "of"})
    rooted = narrow.join(roots, F.col("fp") == F.col("of"), "left")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    kept = rooted.groupBy(F.coalesce("root", "fp").alias(root)).agg(first).select(
        F.col("first.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def hex_digits(fp: str = "fp"):
    """16 lowercase hex digits of a signed 64-bit column."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
