"""Token files in Simple-8b words, in id order, with an offset for each block.

A 64-bit word is a 4-bit selector and 60 bits of ids: the selector says how many ids
of how many bits follow, so runs of small ids pack densely. An id of more than 60 bits
is escaped: a word that only says so, then the id itself. Blocks of ``BLOCK`` ids begin
on a word of their own; the offsets of the blocks let all of them be coded and decoded
side by side by numpy.

A file holds: the magic, the numbers of documents, ids, blocks and words; the ids and
validity of the documents and their lengths in ids; the block offsets; the words. All
numbers are little-endian. Document boundaries are the lengths: the end id may also
occur within a text.

Writing: rows are range-partitioned by document id, encoded, and written by each task
under names of its own; the table of files that the tasks return is what counts, so a
repeated task leaves a file that nobody reads. A hot id is divided by the hash of its
texts, and repeated rows by their numbers. Positions are sums over the table of files.

Defined cases: a null text counts as empty and still has its end id. Null ids come
first. Rows of the same id follow each other in the order of their texts' hashes. No
rows give no files and no rows. Document ids are integers.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut, filesystem, new_path, staged
from ledgerlens.llm.encoding import encoder, texts_of, with_ends

MAGIC = b"S8BTOK01"
BLOCK = 256
FILE_IDS = 4 << 20
BATCH_BYTES = 8 << 20

# Fixed values of Simple-8b: ids a word and bits an id, by selector. Selector 0 is the
# escape here; a run of zeros takes selector 1 or smaller counts.
LAYOUT = (
    (1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
ESCAPE = 0


# -- coding ---------------------------------------------------------------------


def _block_ends(n: int, block: int) -> np.ndarray:
    return np.minimum(np.arange(0, n, block) + block, n)


def _choices(ids: np.ndarray, block: int) -> np.ndarray:
    """The densest selector that fits from each id on, within its block."""
    n = len(ids)
    # Bits of each id; a float may round up to one more, which then takes a wider selector.
    bits = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    need = np.zeros((-(-n // block), block), np.uint8)
    need.ravel()[:n] = bits
    choice = np.full(need.shape, ESCAPE, np.uint8)
    widest, held = need.copy(), 1  # the widest of ``held`` ids from each place on
    for selector in range(len(LAYOUT) - 1, 0, -1):
        count, width = LAYOUT[selector]
        while held < min(count, block):
            step = min(count - held, held, block - held)
            np.maximum(widest[:, :-step], widest[:, step:].copy(), out=widest[:, :-step])
            held += step
        choice[widest <= width] = selector
    return choice.ravel()[:n]


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The words and the word offset of each block (and the end)."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.uint64)
    choice = _choices(ids, block)
    counts = np.array([c for c, _ in LAYOUT], np.int64)
    firsts = np.arange(0, n, block)
    begins, ends, is_start = firsts, _block_ends(n, block), np.zeros(n, bool)
    while len(begins):  # one word of every unfinished block
        is_start[begins] = True
        begins = begins + counts[choice[begins]]
        inside = begins < ends
        begins, ends = begins[inside], ends[inside]
    starts = np.flatnonzero(is_start)
    used = choice[starts]
    width = 1 + (used == ESCAPE)
    slot = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    limit = np.minimum((starts // block + 1) * block, n)
    for selector in np.unique(used):
        count, bits = LAYOUT[selector]
        mine = np.flatnonzero(used == selector)
        where, first, end = slot[mine], starts[mine], limit[mine]
        if selector == ESCAPE:
            words[where + 1] = ids[first]
            continue
        word = np.full(len(first), np.uint64(selector) << np.uint64(60))
        for i in range(count if bits else 0):
            part = ids[np.minimum(first + i, n - 1)] << np.uint64(i * bits)
            word |= np.where(first + i < end, part, np.uint64(0))
        words[where] = word
    offsets = np.append(slot[np.searchsorted(starts, firsts)], len(words))
    return words, offsets.astype(np.uint64)


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids; all words of a selector at once."""
    ids = np.zeros(n, np.uint64)
    if not n:
        return ids
    selector = (words >> np.uint64(60)).astype(np.int64)
    escaped = _escaped(selector, offsets)
    lead = np.ones(len(words), bool)
    lead[escaped + 1] = False
    counts = np.where(lead, np.array([c for c, _ in LAYOUT])[selector], 0)
    before = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets.astype(np.int64)))
    first = before - before[offsets[:-1].astype(np.int64)][owner] + owner * block
    last = _block_ends(n, block)[owner]
    ids[first[escaped]] = words[escaped + 1]
    for s in np.unique(selector[lead]):
        count, bits = LAYOUT[s]
        if s == ESCAPE or not bits:
            continue
        mine = lead & (selector == s)
        word, begin, end = words[mine], first[mine], last[mine]
        for i in range(count):
            inside = begin + i < end
            ids[begin[inside] + i] = (word[inside] >> np.uint64(i * bits)) & np.uint64((1 << bits) - 1)
    return ids


def _escaped(selector: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The words that are escapes: a raw word after one may look like anything."""
    found, at = [], np.flatnonzero(selector == ESCAPE)
    raw = -1
    for i in at:  # only words with selector 0, which token ids never need
        if i != raw:
            found.append(i)
            raw = i + 1
    return np.array(found, np.int64)


# -- files ----------------------------------------------------------------------


def to_bytes(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    words, offsets = encode(ids, block)
    valid = np.array([d is not None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    head = struct.pack("<8s5Q", MAGIC, len(doc_ids), len(ids), block, len(offsets) - 1, len(words))
    return b"".join([head, keys.tobytes(), valid.tobytes(), np.asarray(lengths, "<u8").tobytes(),
                     offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def from_bytes(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """The document ids, their lengths and all ids of a file."""
    magic, docs, n, block, blocks, size = struct.unpack_from("<8s5Q", data)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b token file")
    at = struct.calcsize("<8s5Q")

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    keys, valid, lengths = take("<i8", docs), take("u1", docs), take("<u8", docs)
    offsets, words = take("<u8", blocks + 1), take("<u8", size)
    doc_ids = [int(k) if v else None for k, v in zip(keys, valid)]
    return doc_ids, lengths.astype(np.int64), decode(words, offsets, n, block)


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` in id order under ``path``; the table of files, in order of (part, number).

    Columns: part, number, file, n_docs, n_ids.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # The row number parts rows that are equal, so that many of them fill several ranges.
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("row").asc()]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(path)
        part, number, held, pending = TaskContext.get().partitionId(), 0, 0, []

        def flush() -> pa.RecordBatch:
            nonlocal number, held, pending
            names = [d for ids, _, _ in pending for d in ids]
            lengths = np.concatenate([n for _, n, _ in pending])
            ids = np.concatenate([i for _, _, i in pending])
            file = f"{base}/{part:06d}-{number:06d}-{uuid.uuid4().hex}.s8b"
            store.create_dir(base, recursive=True)
            with store.open_output_stream(file) as out:
                out.write(to_bytes(names, lengths, ids))
            row = [part, number, file.rsplit("/", 1)[1], len(names), len(ids)]
            number, held, pending = number + 1, 0, []
            return pa.RecordBatch.from_arrays(
                [pa.array([v]) for v in row], ["part", "number", "file", "n_docs", "n_ids"])

        for batch in cut(batches, "text", BATCH_BYTES):
            flat, lengths = with_ends(*encoder(tokenizer).encode(texts_of(batch)), end_id)
            pending.append((batch.column("doc_id").to_pylist(), lengths, flat))
            held += len(flat)
            if held >= FILE_IDS:
                yield flush()
        if pending:
            yield flush()

    return staged(ranged.mapInArrow(
        write, "part BIGINT, number BIGINT, file STRING, n_docs BIGINT, n_ids BIGINT"), "s8b-files")


def read_files(files: DataFrame, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, ids (little-endian unsigned 32 bits).

    ``start`` counts the ids of all documents before. Sums over parts are one row a
    write task; within a part they are a window over its files.
    """
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("base"))
    placed = files.join(bases, "part").select(
        "file", (F.col("base") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(path)
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                with store.open_input_file(f"{folder}/{file}") as source:
                    doc_ids, lengths, ids = from_bytes(source.read())
                ids = ids.astype("<u4")
                starts = np.cumsum(lengths) - lengths
                step = max(1, len(doc_ids) // max(1, len(ids) // (1 << 20)))
                for i in range(0, len(doc_ids), step):
                    own = slice(i, i + step)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(doc_ids[own], pa.int64()),
                        pa.array(base + starts[own]),
                        pa.array([ids[a:a + n].tobytes() for a, n in zip(starts[own], lengths[own])],
                                 pa.binary()),
                    ], ["doc_id", "start", "ids"])

    tasks = max(1, min(files.count(), 100_000))
    return placed.repartition(tasks).mapInArrow(read, "doc_id BIGINT, start BIGINT, ids BINARY")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to the shared scratch folder and read the files back."""
    path = new_path(docs.sparkSession, "s8b")
    return read_files(write_files(docs, path, tokenizer, end_id), path)
