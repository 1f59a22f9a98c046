"""Token counts by a separator scan over flat token files without an index.

A flat file is nothing but ids, unsigned little-endian 16-bit, each document followed
by the separator. The files are cut into blocks of equal size whatever they hold; a
task finds a block's separators with one vectorised comparison and reports the ids
before the first one, between them, and after the last. A prefix scan over the small
block summaries of a file gives each block the number of documents before it and the
ids carried in from the blocks before, also across blocks without any separator.

Scale: blocks, not files, are the unit of work, so one file may hold everything. Only
the summaries (five numbers a block) are shuffled, and those of one file are scanned in
order. Files are written by tasks under names of their own and count only once the
task's rows are in the table of files.

Defined cases: a null text counts as empty and has 0 ids. Ids after the last separator
are a document that is not ended (``ended`` false); an empty file holds none. An odd
number of bytes is an error, and so is a text with an id that does not fit in 16 bits or
is the separator. Special-token strings in texts are ordinary text, so
the separator cannot occur in one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ledgerlens.llm.common import cut, filesystem, staged
from ledgerlens.llm.encoding import encoder, texts_of, with_ends

SEPARATOR = 50_256
WIDTH = 2
BLOCK_IDS = 4 << 20
FILE_IDS = 64 << 20
BATCH_BYTES = 8 << 20


def write_flat(docs: DataFrame, path: str, tokenizer: str, separator: int = SEPARATOR,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write flat files under ``path``; where each row went: file, ordinal, doc_id."""
    if not 0 <= separator < 1 << 8 * WIDTH:
        raise ValueError(f"a separator of {WIDTH} bytes cannot be {separator}")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([StructField("file", StringType()), StructField("ordinal", LongType()),
                         rows.schema["doc_id"]])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(path)
        out, name, held, ordinal = None, "", 0, 0
        for batch in cut(batches, "text", BATCH_BYTES):
            words = encoder(tokenizer, specials_as_text=True)
            flat, lengths = words.encode(texts_of(batch))
            if len(flat) and flat.max() >= 1 << 8 * WIDTH:
                raise ValueError(f"id {flat.max()} does not fit in {WIDTH} bytes")
            if (flat == separator).any():
                raise ValueError(f"the separator {separator} is an id of a text")
            flat, lengths = with_ends(flat, lengths, separator)
            if out is None:
                store.create_dir(base, recursive=True)
                name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
                out = store.open_output_stream(f"{base}/{name}")
            out.write(flat.astype("<u2").tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * n), pa.array(np.arange(ordinal, ordinal + n)),
                 batch.column("doc_id")], schema.names)
            ordinal, held = ordinal + n, held + len(flat)
            if held >= FILE_IDS:
                out.close()
                out, held, ordinal = None, 0, 0
        if out is not None:
            out.close()

    return staged(rows.mapInArrow(write, schema), "flat-rows")


def blocks(files: DataFrame, path: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The blocks of the files: file, block, first, n_ids."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(path)
        for batch in batches:
            names = batch.column("file").to_pylist()
            found = store.get_file_info([f"{base}/{name}" for name in names])
            for info in found:
                if info.size is None or info.size % WIDTH:
                    raise ValueError(f"{info.path} is missing or not a whole number of ids")
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array([info.size // WIDTH for info in found], pa.int64())],
                ["file", "ids"])

    sized = files.select("file").mapInArrow(sizes, "file STRING, ids BIGINT").where("ids > 0")
    step = F.lit(block_ids).cast("bigint")
    return sized.select(
        "file", "ids", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ids") - 1, step)).alias("first"),
    ).select("file", (F.col("first") / step).cast("bigint").alias("block"), "first",
             F.least(step, F.col("ids") - F.col("first")).alias("n_ids"))


def scan_block(ids: np.ndarray, separator: int) -> tuple[int, int, np.ndarray]:
    """Ids before the first separator, ids after the last, and where all separators are."""
    at = np.flatnonzero(ids == separator)
    if not len(at):
        return len(ids), len(ids), at
    return int(at[0]), len(ids) - int(at[-1]) - 1, at


def count_tokens(files: DataFrame, path: str, separator: int = SEPARATOR,
                 block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row per document in the files: file, ordinal, start, n_tokens, ended."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(path)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{base}/{row['file']}") as source:
                    data = source.read_at(row["n_ids"] * WIDTH, row["first"] * WIDTH)
                head, tail, at = scan_block(np.frombuffer(data, "<u2"), separator)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file"]]), pa.array([row["block"]]), pa.array([row["first"]]),
                     pa.array([row["n_ids"]]), pa.array([len(at)], pa.int64()), pa.array([head], pa.int64()),
                     pa.array([tail], pa.int64()), pa.array([at[:-1] + 1], pa.list_(pa.int64())),
                     pa.array([np.diff(at) - 1], pa.list_(pa.int64()))],
                    ["file", "block", "first", "n_ids", "found", "head", "tail", "starts", "lengths"])

    listed = blocks(files, path, block_ids)
    # Blocks are dealt evenly whatever the sizes of their files.
    tasks = max(1, min(100_000, listed.count()))
    scanned = staged(listed.repartition(tasks).mapInArrow(
        scan, "file STRING, block BIGINT, first BIGINT, n_ids BIGINT, found BIGINT, head BIGINT, "
              "tail BIGINT, starts ARRAY<BIGINT>, lengths ARRAY<BIGINT>"), "flat-blocks")

    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # Blocks since the last separator form a run; what they leave over is carried on.
    runs = scanned.drop("starts", "lengths").withColumns({
        "ordinal": F.coalesce(F.sum("found").over(before), F.lit(0)),
        "run": F.coalesce(F.sum(F.when(F.col("found") > 0, 1).otherwise(0)).over(before), F.lit(0)),
        "is_last": F.lead("block").over(order).isNull(),
    })
    seen = F.when(F.col("found") > 0, F.col("tail")).otherwise(F.col("n_ids"))
    prior = runs.select("file", "block", "ordinal", "run", "found", "head", "tail", "first", "n_ids",
                        "is_last", seen.alias("left"),
                        (F.col("run") + (F.col("found") > 0).cast("bigint")).alias("next_run"))
    chain = Window.partitionBy("file", "next_run").orderBy("block").rowsBetween(
        Window.unboundedPreceding, 0)
    # Carried out of a block: all ids since the last separator up to its end.
    out = prior.withColumn("out", F.sum("left").over(chain))
    carried = out.withColumn("carry", F.coalesce(F.lag("out").over(order), F.lit(0)))

    firsts = carried.where("found > 0").select(
        "file", "ordinal", (F.col("first") - F.col("carry")).alias("start"),
        (F.col("carry") + F.col("head")).alias("n_tokens"), F.lit(True).alias("ended"))
    open_ = carried.where("is_last AND out > 0").select(
        "file", (F.col("ordinal") + F.col("found")).alias("ordinal"),
        (F.col("first") + F.col("n_ids") - F.col("out")).alias("start"),
        F.col("out").alias("n_tokens"), F.lit(False).alias("ended"))
    inner = scanned.where("found > 1").join(
        carried.select("file", "block", "ordinal"), ["file", "block"]
    ).select("file", "ordinal", "first", F.posexplode(F.arrays_zip("starts", "lengths"))).select(
        "file", (F.col("ordinal") + F.col("pos") + 1).alias("ordinal"),
        (F.col("first") + F.col("col.starts")).alias("start"),
        F.col("col.lengths").alias("n_tokens"), F.lit(True).alias("ended"))
    return firsts.unionByName(inner).unionByName(open_)


def flat_files(spark: SparkSession, path: str) -> DataFrame:
    """The files under ``path``; names only, the list is as long as the folder."""
    from pyarrow import fs

    store, base = filesystem(path)
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
    names = sorted(i.base_name for i in found if i.is_file)
    return spark.createDataFrame([(n,) for n in names], "file STRING")
