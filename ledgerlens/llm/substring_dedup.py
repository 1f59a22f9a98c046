"""Repeated passages by suffix arrays over shards, built by induced sorting.

A byte goes if it lies in a ``WINDOW``-byte string that starts anywhere else too. Such
strings must meet in one shard. Each window is therefore dealt by its smallest
``GRAM``-byte hash: equal windows have it at the same place, and neighbouring windows
share it, so they travel together as one segment. Hashes that occur once in the
corpus settle their segments at once; only segments of repeated hashes are cut out of
the texts. Equal segments are merged first (all their windows repeat), and the
different segments of a hash go to a shard, which builds its suffix array by induced
sorting and finds repeats as permuted common prefixes of ``WINDOW`` letters or more.

Scale: shards hold about ``SHARD_BYTES`` and are as many as the segments need. A hash
whose segments exceed ``HOT_BYTES`` is divided exactly: its windows are dealt again
by their place around the hash and by the bytes that all windows of that place
share, in ever narrower places; at the narrowest a segment is its window and merging
settles it. Equal texts are merged before anything else.

Defined cases: a null text counts as empty; texts shorter than a window lose nothing.
Repeated rows, and different rows of equal text, are occurrences of their own, so a
text of a window or more that occurs twice goes whole. Ids may be null or repeat. No
rows give no rows. Other columns are not read. Texts are bytes of UTF-8: what stays
need not be valid text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut, staged
from ledgerlens.llm.suffix_array import repeated_windows

WINDOW = 400
GRAM = 160
CHUNK = 1 << 19
BATCH_BYTES = 4 << 20
SHARD_BYTES = 4 << 20
HOT_BYTES = 4 << 20
#: Widths of the places in which a hot hash's windows are dealt again.
WIDTHS = (24, 1)

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_PLACE = np.uint64((1 << 20) - 1)  # positions within a chunk and its overlap


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP = _powers(_BASE, CHUNK + 2 * WINDOW)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), CHUNK + 2 * WINDOW)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A mixed hash of each ``gram`` bytes in a row."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * _DOWN[:n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def segments(data: np.ndarray, window: int = WINDOW, gram: int = GRAM
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, its position, and the first and last window that it is the smallest in."""
    parts = []
    for begin in range(0, len(data) - window + 1, CHUNK):
        part = data[begin:begin + CHUNK + window - 1]
        h = gram_hashes(part, gram)
        span = window - gram + 1
        # Leftmost smallest: the position breaks ties.
        packed = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(h) // span) * span, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[:len(h)] = packed
        rows = padded.reshape(-1, span)
        ahead = np.minimum.accumulate(rows, 1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        n = len(part) - window + 1
        place = (np.minimum(behind[:n], ahead[span - 1:span - 1 + n]) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], n) - 1
        at = place[first]
        parts.append((h[at].view(np.int64), at + begin, first + begin, last + begin))
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def outlines(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """Each row with a row number, the text, its size and digest, and its segments."""
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "text", BATCH_BYTES):
            found: list[list] = [[], [], [], [], []]
            for text in batch.column("text"):
                data = text.as_buffer()
                h, at, first, last = segments(np.frombuffer(data, np.uint8), window, gram)
                whole = memoryview(data)
                digests = [_digest(whole[a:b + window]) for a, b in zip(first.tolist(), last.tolist())]
                for values, own in zip(found, (h, digests, at - first, first, last - first)):
                    values.append(own)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            lists = [pa.array(values, pa.list_(kind)) for values, kind in zip(found, kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), *lists],
                ["doc_id", "text", *SEGMENT])

    shape = (f"doc_id {id_type}, text STRING, key ARRAY<BIGINT>, digest ARRAY<BIGINT>, at ARRAY<INT>, "
             "first ARRAY<INT>, hi ARRAY<INT>")
    return staged(rows.mapInArrow(outline, shape).withColumns({
        "n_bytes": F.octet_length("text").cast("bigint"), "sha": F.sha2("text", 256),
        "row": F.monotonically_increasing_id(),
    }), "passages", "zstd")


def _cut_out(wanted: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """The wanted segments (row, first, hi, key, digest, at) with their bytes."""

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "text", BATCH_BYTES):
            for text, parts in zip(batch.column("text"), batch.column("wanted").to_pylist()):
                data = text.as_buffer().to_pybytes()
                yield pa.RecordBatch.from_arrays([
                    *(pa.array([p[c] for p in parts], pa.int64()) for c in ("key", "digest", "at")),
                    pa.array([data[p["first"]:p["first"] + p["hi"] + window] for p in parts], pa.binary())],
                    ["key", "digest", "at", "content"])

    listed = wanted.groupBy("row").agg(F.collect_list(
        F.struct("key", "digest", "at", "first", "hi")).alias("wanted"))
    return texts.select("row", "text").join(listed, "row").mapInArrow(
        cut_out, "key BIGINT, digest BIGINT, at BIGINT, content BINARY")


def _merged(parts: DataFrame) -> DataFrame:
    """The different segments of a key and how often each occurs."""
    return staged(parts.groupBy("key", "digest").agg(
        F.count(F.lit(1)).alias("m"), F.first("content").alias("content"),
        F.first("at").alias("at")), "segments")


def _runs(at: np.ndarray) -> list[dict]:
    """Positions as inclusive ranges."""
    if not len(at):
        return []
    edge = np.flatnonzero(np.diff(at) != 1)
    first, last = at[np.concatenate([[0], edge + 1])], at[np.concatenate([edge, [len(at) - 1]])]
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(first, last)]


_FOUND = "key BIGINT, digest BIGINT, runs ARRAY<STRUCT<lo: BIGINT, hi: BIGINT>>"
#: Arrays of a text's segments: the smallest hash and a digest of all bytes, the place of the
#: hash in the segment, the first window, and how many windows follow it.
SEGMENT = ("key", "digest", "at", "first", "hi")


def _search_shards(contents: DataFrame, window: int) -> DataFrame:
    """Repeated windows among different segments, by one suffix array a shard."""
    total = contents.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        hits = repeated_windows(shard["content"].tolist(), window)
        some = [i for i, h in enumerate(hits) if len(h)]
        return pd.DataFrame({
            "key": shard["key"].iloc[some], "digest": shard["digest"].iloc[some],
            "runs": [_runs(hits[i]) for i in some]})

    dealt = contents.select("key", "digest", "content", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInPandas(search, _FOUND)


def _narrower(hot: DataFrame, window: int, width: int) -> DataFrame:
    """Hot segments cut by place: of, whole, base and the part's key, digest, at, content.

    All windows of a place share the bytes between the last's start and the first's end;
    equal windows share them too, so they are part of the new key.
    """

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "content", BATCH_BYTES):
            rows = []
            for key, digest, at, content in zip(*(batch.column(c).to_pylist() for c in (
                    "key", "digest", "at", "content"))):
                last = len(content) - window
                for place in range(max(0, at - last) // width, at // width + 1):
                    # Offsets of the hash in its windows, from low to high - 1.
                    low, high = place * width, (place + 1) * width
                    core = content[max(0, at - low):at - high + 1 + window]
                    lo, hi = max(0, at - high + 1), min(last, at - low)
                    new = _digest(b"%d,%d," % (key, place) + core)
                    part = content[lo:hi + window]
                    rows.append((key, digest, lo, new, _digest(part), at - lo, part))
            names = ["of", "whole", "base", "key", "digest", "at", "content"]
            kinds = [*[pa.int64()] * 6, pa.binary()]
            for i in range(0, len(rows), 20_000):
                columns = zip(*rows[i:i + 20_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return hot.select("key", "digest", "at", "content").mapInArrow(
        narrow, "of BIGINT, whole BIGINT, base BIGINT, key BIGINT, digest BIGINT, at BIGINT, content BINARY")


def repeated_runs(contents: DataFrame, window: int, widths: tuple[int, ...] = WIDTHS,
                  hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Ranges of windows that start elsewhere too, by (key, digest) of merged segments."""
    all_of = F.array(F.struct(F.lit(0).cast("bigint").alias("lo"),
                              (F.octet_length("content") - window).cast("bigint").alias("hi")))
    many = contents.where("m > 1").select("key", "digest", all_of.alias("runs"))
    # A key's only segment cannot repeat itself: its windows hold the hash at different places.
    sizes = staged(contents.groupBy("key").agg(
        F.sum(F.octet_length("content")).alias("bytes"), F.count(F.lit(1)).alias("n"),
    ).where("n > 1"), "segment-sizes")
    hot = sizes.where(F.col("bytes") > hot_bytes).select("key")
    cold = sizes.where(F.col("bytes") <= hot_bytes).select("key")
    found = many.unionByName(_search_shards(contents.join(cold, "key", "left_semi"), window))
    if widths and not hot.isEmpty():
        parts = staged(_narrower(contents.join(hot, "key", "left_semi"), window, widths[0]), "segment-parts")
        inner = repeated_runs(_merged(parts), window, widths[1:], hot_bytes)
        back = parts.select("of", "whole", "base", "key", "digest").join(inner, ["key", "digest"])
        found = found.unionByName(back.select(
            F.col("of").alias("key"), F.col("whole").alias("digest"),
            F.transform("runs", lambda r: F.struct(
                (r.lo + F.col("base")).alias("lo"), (r.hi + F.col("base")).alias("hi"))).alias("runs")))
    return found


def _spans(ranges: list[dict], window: int) -> list[tuple[int, int]]:
    """Maximal removed runs of bytes, end exclusive; overlapping and touching windows join."""
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"] + window) for r in ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def removed_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     window: int = WINDOW, gram: int = GRAM, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, spans, kept, kept_sha.

    ``spans`` are the removed runs (lo, hi), end exclusive. ``kept`` holds the bytes that
    stay of texts that lose some, and is null for the others, which stay as they are.
    """
    texts = outlines(docs, id_col, text_col, window, gram)
    copies = staged(texts.where(F.col("n_bytes") >= window).groupBy("sha").agg(
        F.min("row").alias("row"), F.count(F.lit(1)).alias("copies")), "passage-texts")
    # One row stands for equal texts. The list of the others is short where copies are few.
    spare = texts.select("row", "sha").join(
        copies.where("copies > 1").select("sha", F.col("row").alias("kept")), "sha"
    ).where(F.col("row") != F.col("kept")).select("row")
    single = texts.select("row", *SEGMENT).join(
        staged(spare, "passage-copies"), "row", "left_anti"
    ).select("row", F.inline(F.arrays_zip(*SEGMENT)))
    shared = staged(single.groupBy("key").count().where("count > 1").select("key"), "passage-shared")
    live = staged(single.join(shared, "key", "left_semi"), "passage-live")
    merged = staged(live.groupBy("key", "digest").agg(
        F.count(F.lit(1)).alias("m"), F.min(F.struct("row", "first", "at", "hi")).alias("one"),
    ).select("key", "digest", "m", "one.*"), "passage-merged")
    # Only keys with different segments need their bytes, and each segment once.
    varied = staged(merged.groupBy("key").count().where("count > 1").select("key"), "passage-varied")
    contents = staged(_cut_out(merged.join(varied, "key", "left_semi"), texts, window), "passage-bytes")
    every = F.array(F.struct(F.lit(0).cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi")))
    found = merged.where("m > 1").select("key", "digest", every.alias("runs")).unionByName(
        repeated_runs(contents.withColumn("m", F.lit(1)), window, hot_bytes=hot_bytes))
    ranges = live.join(found, ["key", "digest"]).select(
        "row", F.inline(F.transform("runs", lambda r: F.struct(
            (r.lo + F.col("first")).alias("lo"), (r.hi + F.col("first")).alias("hi")))))
    hit = staged(ranges.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")),
                 "passage-ranges")

    whole = copies.where("copies > 1").select("sha")
    gone = texts.select("row", "doc_id", "n_bytes", "sha").join(whole, "sha", "left_semi").select(
        "row", "doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"),
        F.array(F.struct(F.lit(0).cast("bigint").alias("lo"), F.col("n_bytes").alias("hi"))).alias("spans"),
        F.lit(b"").alias("kept"), F.sha2(F.lit(""), 256).alias("kept_sha"))
    others = copies.where("copies = 1").select("row")
    touched = hit.join(others, "row", "left_semi")
    id_type = texts.schema["doc_id"].dataType.simpleString()
    struct = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "text", BATCH_BYTES):
            spans, kept = [], []
            for text, ranges in zip(batch.column("text"), batch.column("ranges").to_pylist()):
                data = text.as_buffer().to_pybytes()
                own = _spans(ranges, window)
                edges = [0, *(x for span in own for x in span), len(data)]
                spans.append([{"lo": a, "hi": b} for a, b in own])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("doc_id"), batch.column("n_bytes"),
                pa.array([sum(s["hi"] - s["lo"] for s in own) for own in spans], pa.int64()),
                pa.array(spans, struct), pa.array(kept, pa.binary()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
                ["row", "doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha"])

    shape = (f"row BIGINT, doc_id {id_type}, n_bytes BIGINT, n_removed BIGINT, "
             "spans ARRAY<STRUCT<lo: BIGINT, hi: BIGINT>>, kept BINARY, kept_sha STRING")
    changed = texts.select("row", "doc_id", "n_bytes", "text").join(touched, "row").mapInArrow(strip, shape)
    touched_or_gone = touched.select("row")
    same = texts.select("row", "doc_id", "n_bytes", "sha").join(whole, "sha", "left_anti").join(
        touched_or_gone, "row", "left_anti").select(
        "row", "doc_id", "n_bytes", F.lit(0).cast("bigint").alias("n_removed"),
        F.array().cast("array<struct<lo: bigint, hi: bigint>>").alias("spans"),
        F.lit(None).cast("binary").alias("kept"), F.col("sha").alias("kept_sha"))
    return gone.unionByName(changed).unionByName(same).drop("row")
