"""Packing documents into sequences by first-fit decreasing with a tournament tree.

A document's ids, with an end id after them, are cut into pieces of the sequence
length; whole pieces are sequences by themselves. The remaining pieces are dealt at
random into groups of about ``GROUP`` and each group is packed alone: pieces in
falling length, each into the first bin that has room. The bins are the leaves of a
tournament tree whose inner nodes hold the largest room below, so the first bin
with room is found, and its path renewed, in logarithmic time.

Random groups hold a mixture of lengths, so hardly a bin stays open; their number
follows the table, and no key decides on them, so none is hot.

Defined cases: a null text counts as empty; an empty document is one piece, its end
id. Texts of any length are cut freely. Ids may be null or repeat: every row is
packed on its own. No rows give no rows. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType, LongType, StructField, StructType,
)

from ledgerlens.llm.common import cut, staged
from ledgerlens.llm.encoding import encoder, texts_of, with_ends

LENGTH = 2048
GROUP = 4096
BATCH_BYTES = 8 << 20
BATCH_IDS = 8 << 20


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``length`` ids: doc_id, start, length, ids, doc_tokens.

    ``ids`` are little-endian unsigned 32-bit integers.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([
        rows.schema["doc_id"], StructField("start", LongType()), StructField("length", LongType()),
        StructField("ids", BinaryType()), StructField("doc_tokens", LongType()),
    ])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in cut(batches, "text", BATCH_BYTES):
            flat, sizes = with_ends(*words.encode(texts_of(batch)), end_id)
            flat = flat.astype("<u4")
            count = -(-sizes // length)
            owner = np.repeat(np.arange(len(sizes)), count)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            start = number * length
            own = np.minimum(length, sizes[owner] - start)
            first = 0
            while first < len(own):  # batches of a bounded number of ids
                last = first + max(1, int(np.searchsorted(np.cumsum(own[first:]), BATCH_IDS)))
                at = slice(first, last)
                ends = np.concatenate([[0], np.cumsum(own[at])]) * 4
                skip = int(own[:first].sum())
                values = np.ascontiguousarray(flat[skip:skip + int(own[at].sum())])
                ids = pa.Array.from_buffers(pa.binary(), last - first if last < len(own) else len(own) - first, [
                    None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(owner[at])),
                    pa.array(start[at]), pa.array(own[at]), ids, pa.array(sizes[owner[at]]),
                ], names=schema.names)
                first = last

    return rows.mapInArrow(cut_up, schema)


class RoomTree:
    """Rooms of bins as leaves; each inner node holds the larger of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def take_first(self, need: int) -> tuple[int, int]:
        """Put ``need`` into the first bin with room: the bin and its room before."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < need:
                node += 1
        before = room[node]
        room[node] = before - need
        found = node - self.leaves
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return found, before


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; ties in the order given."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = RoomTree(len(lengths), capacity)
    for i in np.argsort(-np.asarray(lengths), kind="stable"):
        bins[i], before = tree.take_first(int(lengths[i]))
        offsets[i] = capacity - before
    return bins, offsets


def place(cut_pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``cut_pieces`` with sequence_id and offset; needs a column ``length``.

    Staged first, as the random groups must not change between attempts.
    """
    rows = staged(cut_pieces.withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    whole = rows.where(F.col("length") == length).select(
        *cut_pieces.columns, (F.col("row") * 2).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"))
    rest = rows.where(F.col("length") < length)
    groups = max(1, -(-rest.count() // group))
    schema = StructType([*rows.schema.fields, StructField("pack", LongType()),
                         StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row", kind="stable")
        bins, offsets = first_fit_decreasing(part["length"].to_numpy(), length)
        return part.assign(sequence_id=(part["pack"] * (1 << 20) + bins) * 2 + 1, offset=offsets)

    dealt = rest.withColumn("pack", F.pmod(F.xxhash64("row"), F.lit(groups)))
    packed = dealt.groupBy("pack").applyInPandas(pack, schema)
    return packed.select(*cut_pieces.columns, "sequence_id", "offset").unionByName(whole)


def sequences(placed: DataFrame) -> DataFrame:
    """One row per sequence from placed pieces with ids: sequence_id, length, ids, doc_ids."""
    part = F.array_sort(F.collect_list(F.struct("offset", "length", "ids", "doc_id")))
    return placed.groupBy("sequence_id").agg(part.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p.length).alias("length"),
        F.expr("aggregate(parts, CAST('' AS BINARY), (a, p) -> concat(a, p.ids))").alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
    )
