"""Nearest neighbours by collision-counting hashing with query-aware windows.

Method: each vector is projected on ``HASHES`` random directions; a projection is kept
as one sorted array. For a query, a window of half-width w opens around its own
projection in every array, and a vector collides in each window that holds it. All
windows grow together (virtual rehashing) until enough vectors collide in more
windows than the threshold; every vector beyond the threshold is verified by its
true inner product. No bucket or candidate is cut off.

Largest inner products become nearest points by one more coordinate: a vector gets
sqrt(M^2 - |v|^2), M the largest norm, and a query, scaled to norm M, gets 0. A few long
vectors must not make all others look alike, so a block is cut into ranges of norm, each
with the M of its own and with sorted arrays of its own. Ranges are searched by falling
norm; one whose |q| M is below the query's k-th score holds no better vector and is left
out, which loses nothing. A range of at most ``LEAST`` times k vectors is verified whole.

The table is dealt at random into blocks of about ``BLOCK`` vectors, with ranges and
arrays built by the task that searches them. The stated queries, in batches of
about ``QUERY_BATCH``, meet all blocks; a block returns its best k a query, and the best
of these are taken by a grouped merge. A task holds one block and one batch.

What the index saves: counting costs one small integer a window that holds a vector, verifying
one product a dimension. With ``HASHES`` windows and ``VERIFIED`` as they are, that pays for vectors of
some hundred dimensions and more; for short ones a search with ``verified=1.0`` is as fast, and exact.

Defined cases: vectors that are null, empty, of another length than most candidates, zero, or
hold null or non-finite components take no part, neither as query nor as candidate.
Rows with a null vec_id take no part either. Ties go to the smaller id. Fewer than k
candidates: all of them. Repeated rows are each a candidate; a query's own id is not.
Several query rows with one id give one answer, that of the vector first in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import staged

NEAREST = 20
HASHES = 64
BLOCK = 8192
QUERY_BATCH = 8192
#: Queries counted side by side in a task.
TOGETHER = 256
#: Share of the windows a vector must collide in.
THRESHOLD = 0.56
#: A range of norms ends below this share of its largest.
NORM_RANGE = 0.85
#: Windows grow until this share of a range's vectors, and ``LEAST`` times k, are verified.
VERIFIED = 0.45
LEAST = 16
FIRST_WINDOW = 0.6
GROWTH = 1.15


def finite(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and v (array of doubles) of the vectors of any length that could take part."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"),
                          F.col(vec_col).cast("array<double>").alias("v"))
    numbers = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(
        numbers & (F.size("v") > 0) & F.exists("v", lambda x: x != 0), F.lit(False)))


def usual_width(rows: DataFrame) -> int:
    """The length that most vectors have; of equally frequent ones the smallest."""
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return width.n if width else 0


def directions(width: int, hashes: int = HASHES, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width + 1, hashes))


def norms(vectors: np.ndarray) -> np.ndarray:
    """Lengths of vectors that are not zero, without squares out of range."""
    most = np.abs(vectors).max(1)
    return most * np.sqrt(((vectors / most[:, None])**2).sum(1))


class SortedProjections:
    """The sorted arrays of a range of norms, and the search in them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, hashes: int = HASHES):
        self.ids, self.vectors, self.norm = ids, vectors, lengths.max()
        self.directions = directions(vectors.shape[1], hashes)
        lift = np.sqrt(np.maximum(1 - (lengths / self.norm)**2, 0))
        values = np.column_stack([vectors / self.norm, lift]) @ self.directions
        self.order = np.ascontiguousarray(values.argsort(0).T)
        self.values = np.take_along_axis(values.T, self.order, 1)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, threshold: float,
               verified: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Position of each query, and the ids and scores of the best ``k`` found for it."""
        n, hashes = self.order.shape[::-1]
        if n <= LEAST * k or verified >= 1:
            for q in range(len(queries)):
                yield q, *self._verified(query_ids[q], queries[q], np.arange(n), k)
            return
        need = int(np.ceil(threshold * hashes))
        wanted = min(n, max(LEAST * k, int(verified * n)))
        projected = (queries / norms(queries)[:, None]) @ self.directions[:-1]
        counts = np.zeros((len(queries), n), np.int16)
        low = high = np.zeros((len(queries), hashes), np.int64)
        half, fresh, active = FIRST_WINDOW, True, np.arange(len(queries))
        while len(active):  # all windows grow together
            at = projected[active]
            new_low = np.column_stack([v.searchsorted(x) for v, x in zip(self.values, (at - half).T)])
            new_high = np.column_stack([v.searchsorted(x) for v, x in zip(self.values, (at + half).T)])
            still = []
            for i, q in enumerate(active):
                if fresh:
                    gained = [o[a:b] for o, a, b in zip(self.order, new_low[i], new_high[i])]
                else:
                    gained = [o[a:b] for o, a, b in zip(self.order, new_low[i], low[i])]
                    gained += [o[a:b] for o, a, b in zip(self.order, high[i], new_high[i])]
                counts[q] += np.bincount(np.concatenate(gained), minlength=n).astype(np.int16)
                found = np.flatnonzero(counts[q] >= need)
                whole = not new_low[i].any() and (new_high[i] == n).all()
                if len(found) >= wanted or whole:
                    yield q, *self._verified(query_ids[q], queries[q], found, k)
                else:
                    still.append(i)
            low, high, active, fresh = new_low[still], new_high[still], active[still], False
            half *= GROWTH

    def _verified(self, own: int, query: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        found = found[self.ids[found] != own]
        scores = self.vectors[found] @ query
        return best(self.ids[found], scores, k)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest scores and their ids, ties by the smaller id."""
    if len(ids) > k:  # all that reach the k-th score, so that ties are seen
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        ids, scores = ids[near], scores[near]
    first = np.lexsort((ids, -scores))[:k]
    return ids[first], scores[first]


class NormRanges:
    """A block cut into ranges of norm, the largest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, hashes: int = HASHES):
        lengths = norms(vectors)
        falling = np.argsort(-lengths, kind="stable")
        sizes, first, self.ranges = lengths[falling], 0, []
        while first < len(sizes):
            last = int(np.searchsorted(-sizes, -NORM_RANGE * sizes[first], "right"))
            at = falling[first:last]
            self.ranges.append(SortedProjections(ids[at], vectors[at], lengths[at], hashes))
            first = last

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int,
               threshold: float = THRESHOLD, verified: float = VERIFIED) -> pd.DataFrame:
        """The best ``k`` found for each query."""
        lengths = norms(queries)
        kept = [(np.empty(0, np.int64), np.empty(0))] * len(queries)
        reached = np.full(len(queries), -np.inf)
        for part in self.ranges:
            # The last digits of a score may lie beyond the bound.
            hopeful = np.flatnonzero(lengths * part.norm * (1 + 1e-9) >= reached)
            for i in range(0, len(hopeful), TOGETHER):
                asked = hopeful[i:i + TOGETHER]
                for at, ids, scores in part.search(query_ids[asked], queries[asked], k, threshold, verified):
                    q = asked[at]
                    kept[q] = best(np.concatenate([kept[q][0], ids]), np.concatenate([kept[q][1], scores]), k)
                    if len(kept[q][1]) == k:
                        reached[q] = kept[q][1][-1]
        return pd.DataFrame({
            "query_id": np.repeat(query_ids, [len(ids) for ids, _ in kept]),
            "vec_id": np.concatenate([ids for ids, _ in kept]),
            "score": np.concatenate([scores for _, scores in kept])})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, id_col: str = "vec_id",
            vec_col: str = "embedding", block: int = BLOCK, threshold: float = THRESHOLD,
            verified: float = VERIFIED) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query.

    A vector is verified if it collides in a ``threshold`` of the windows, and windows grow
    until a share ``verified`` of a range is; 1.0 verifies every vector and is exact.
    """
    rows = finite(vectors, id_col, vec_col)
    width = usual_width(rows)
    rows = staged(rows.where(F.size("v") == width), "ann-vectors")
    asked = finite(queries, id_col, vec_col).where(F.size("v") == width)
    asked = staged(asked.groupBy("vec_id").agg(F.min("v").alias("v")), "ann-queries")
    blocks = max(1, -(-rows.count() // block))
    batches = max(1, -(-asked.count() // QUERY_BATCH))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)))
    # Every batch of queries meets every block: the stated query set against all rows.
    pairs = F.sequence(F.lit(0).cast("bigint"), F.lit(batches - 1).cast("bigint"))
    dealt = dealt.withColumn("batch", F.explode(pairs))
    pairs = F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))
    posed = asked.withColumn("batch", F.pmod(F.xxhash64("vec_id"), F.lit(batches))).withColumn(
        "block", F.explode(pairs))
    shape = "query_id BIGINT, vec_id BIGINT, score DOUBLE"

    def find(held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(wanted):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        index = NormRanges(held["vec_id"].to_numpy(), np.stack(held["v"]))
        return index.search(wanted["vec_id"].to_numpy(), np.stack(wanted["v"]), k, threshold, verified)

    found = dealt.groupBy("block", "batch").cogroup(
        posed.groupBy("block", "batch")).applyInPandas(find, shape)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")

