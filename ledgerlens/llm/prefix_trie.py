"""The trie of conversation prefixes, screened by a count-min sketch.

A node is a distinct sequence of first turns; conversations that start with it are its
members. Prefixes are known by digests that run along each conversation: the exclusive
or of a 128-bit hash of each turn and its place, so a prefix's parent is known without its
neighbours, and a long conversation may lie in several partitions.

Screening: all prefix digests are counted in a sketch of two rows of ``CELLS`` counters,
of which only "more than one" is kept, a bit each. An estimate is never too small: one
proves that a prefix belongs to a single conversation, and then so do all that continue
it. Such tails become nodes where they are. Only prefixes that may be shared, and
the first turn after them, are shuffled and grouped exactly, so what the sketch
takes for shared by mistake costs time and no more. The sketch has the same size for any
table, 32 MB at most, which is what is broadcast.

Sums over a subtree need no walk down it. Of the conversations through a node, each
node below belongs to the one with the smallest id, and for a conversation these are
all its prefixes from some depth on; so leaves and bytes are sums over members.

Hot nodes: groupings are combined before their shuffles, and the tables joined to rows are
written first, so adaptive execution can split a frequent prefix. The ids that end at a
node are put together in bounded chunks, and one task streams the chunks of a node
through the digest, which has to see them in order.

Defined cases: null roles and texts count as empty. Null turns come first; rows of one
turn follow each other in the order of their hashes, repeated rows as often as they come.
Rows without a conversation id belong to none and are left out. Conversations without
turns are members of the root. An empty table has no nodes. Texts are only hashed
and measured, whatever their length; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ledgerlens.llm.common import staged
from ledgerlens.llm.ranks import numbered

#: Counters in a row of the sketch.
CELLS = 1 << 27
#: Bits in one of the built-in bitmaps.
BITMAP = 1 << 15
#: Ids put together in one piece before they are hashed.
CHUNK = 1 << 14

NODE = ["a", "b", "depth"]
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digested(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
             role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One narrow row per turn: conv_id, turn, two hashes of role and text, the text's bytes, tie."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    return staged(
        conversations.where(F.col(id_col).isNotNull()).select(
            F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"),
            F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), role, text).alias("t2"),
            F.octet_length(text).cast("bigint").alias("n_bytes"),
            F.monotonically_increasing_id().alias("tie")), "turns")


def in_order(turns: DataFrame) -> DataFrame:
    """The digested turns with ``depth``, their place in the conversation from 1 on."""
    placed = numbered(turns, ["conv_id"], ["turn", "t1", "t2", "tie"])
    return placed.select("conv_id", (F.col("pos") + 1).alias("depth"), "t1", "t2", "n_bytes")


def _prefixes(turns: DataFrame) -> DataFrame:
    """Turns with the digest (a, b) of the prefix they end, that of its parent, and bytes."""
    mixed = turns.withColumns({"m1": F.xxhash64("depth", "t1"), "m2": F.xxhash64("depth", "t2")})
    running = numbered(mixed.drop("t1", "t2"), ["conv_id"], ["depth"],
                       sums={"bytes_to": "n_bytes"}, xors={"a": "m1", "b": "m2"})
    lengths = staged(turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("length"), F.sum("n_bytes").alias("total")), "lengths")
    return running.join(lengths, "conv_id").select(
        "conv_id", "depth", "length", "total", "n_bytes", (F.col("bytes_to") - F.col("n_bytes")).alias("earlier"),
        "a", "b", F.col("a").bitwiseXOR(F.col("m1")).alias("pa"), F.col("b").bitwiseXOR(F.col("m2")).alias("pb"))


def sketch(prefixes: DataFrame, cells: int = CELLS) -> np.ndarray:
    """The sketch of the digests (a, b): a bit for each counter that has counted more than one.

    Counted in the shuffle; the driver gets the bits, ``cells / 4`` bytes at most.
    """
    each = prefixes.select(F.posexplode(F.array("a", "b")).alias("row", "digest")).select(
        "row", F.col("digest").bitwiseAND(F.lit(cells - 1).cast("bigint")).alias("cell"))
    many = each.groupBy("row", "cell").count().where("count > 1")
    bits = many.groupBy("row", F.expr(f"cell DIV {BITMAP}").alias("block")).agg(
        F.bitmap_construct_agg(F.col("cell") % BITMAP).alias("bits"))
    held = np.zeros((2, -(-cells // BITMAP), BITMAP // 8), np.uint8)
    for row in bits.toLocalIterator():
        held[row["row"], row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return held.reshape(2, -1)


def _alone(held: np.ndarray, a: np.ndarray, b: np.ndarray, cells: int) -> np.ndarray:
    """Where the estimate is one: the least of its counters has counted one."""
    shared = np.ones(len(a), bool)
    for bits, digest in zip(held, (a, b)):
        cell = digest & (cells - 1)
        shared &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    return ~shared


def screened(prefixes: DataFrame, cells: int = CELLS) -> DataFrame:
    """``prefixes`` with ``alone`` and ``below_alone``: a single member is proven, for it or its parent."""
    given = prefixes.sparkSession.sparkContext.broadcast(sketch(prefixes, cells))
    schema = StructType([*prefixes.schema.fields, StructField("alone", BooleanType()),
                         StructField("below_alone", BooleanType())])

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = given.value
        for batch in batches:
            a, b, pa_, pb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "pa", "pb"))
            # The root is taken as shared, so that every first turn is grouped or a head.
            below = _alone(held, pa_, pb, cells) & (batch.column("depth").to_numpy() > 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(_alone(held, a, b, cells)), pa.array(below)], schema.names)

    return staged(prefixes.mapInArrow(screen, schema), "screened")


def _tail_nodes(rows: DataFrame, parent: Column) -> DataFrame:
    """Nodes of a single conversation, straight from its rows."""
    ends = F.col("depth") == F.col("length")
    return rows.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), F.lit(1).cast("bigint").alias("n_convs"),
        (~ends).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"),
        F.sha2(F.when(ends, F.col("conv_id").cast("string")).otherwise(F.lit("")), 256).alias("ends_sha256"))


def _ends_digest(ends: DataFrame) -> DataFrame:
    """For each node the digest of the ids (a, b, depth, conv_id) that end there, ascending."""
    chunks = numbered(staged(ends, "ends"), NODE, ["conv_id"]).groupBy(
        *NODE, F.expr(f"pos DIV {CHUNK}").alias("chunk")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    schema = StructType([*[f for f in chunks.schema.fields if f.name in NODE], StructField("ends_sha256", StringType())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            for *node, ids in zip(*[batch.column(c).to_pylist() for c in [*NODE, "ids"]]):
                if node == key:
                    digest.update(b",")
                else:
                    done += [] if key is None else [(*key, digest.hexdigest())]
                    key, digest = node, hashlib.sha256()
                digest.update(ids.encode())
            yield _rows(done, schema)
        yield _rows([] if key is None else [(*key, digest.hexdigest())], schema)

    ordered = staged(chunks, "end-chunks").repartition(*NODE).sortWithinPartitions(*NODE, "chunk")
    return ordered.select(*NODE, "ids").mapInArrow(stream, schema)


def _rows(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    kinds = [pa.string() if isinstance(f.dataType, StringType) else pa.int64() for f in schema.fields]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], schema.names)


def trie(turns: DataFrame, conversations: DataFrame, cells: int = CELLS) -> DataFrame:
    """One row per node (``COLUMNS``); the text of a node is turn ``depth`` of ``conv_id``.

    ``turns`` has conv_id, depth (1, 2, ...), t1, t2 and n_bytes as ``in_order`` gives them;
    ``conversations`` the ids of all conversations in ``conv_id``, also of those without turns.
    ``saved_tokens`` counts the bytes that members need not repeat.
    """
    rows = screened(staged(_prefixes(staged(turns, "trie-turns")), "prefixes"), cells)
    tails = _tail_nodes(rows.where("below_alone"), F.col("conv_id"))
    heads = rows.where("NOT below_alone AND alone")
    shared = rows.where("NOT below_alone AND NOT alone")

    # Exact groups of what may be shared, and for every conversation the bytes before the
    # first prefix that belongs to it, and whether the node it ends at is a leaf of its own.
    ended = F.col("depth") == F.col("length")
    nodes = staged(shared.groupBy(*NODE, "pa", "pb").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("owner"), F.count_if(ended).alias("n_ends"),
    ), "trie-nodes")
    owned = shared.join(nodes.select(*NODE, "owner", "n_convs", "n_ends"), NODE).select(
        "conv_id", "total", F.when(F.col("owner") == F.col("conv_id"), F.col("earlier")).alias("since"),
        F.when(ended, ((F.col("owner") == F.col("conv_id")) & (F.col("n_ends") == F.col("n_convs"))).cast("bigint")).alias("leaf"))
    owned = owned.unionByName(heads.select("conv_id", "total", F.col("earlier").alias("since"), F.lit(None).cast("bigint").alias("leaf")))
    of_conv = staged(owned.groupBy("conv_id").agg(
        F.max("total").alias("total"), F.min("since").alias("since"), F.coalesce(F.max("leaf"), F.lit(1).cast("bigint")).alias("leaf"),
    ), "trie-conversations")
    # Bytes of members below a node, less those of the nodes there, each counted for its owner.
    own = F.coalesce(F.col("total") - F.greatest("earlier", "since"), F.lit(0).cast("bigint"))
    below = shared.join(of_conv.select("conv_id", "since", "leaf"), "conv_id").groupBy(*NODE).agg(
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.col("total") - F.col("earlier") - F.when(F.col("since").isNull(), 0).otherwise(own)).alias("saved_tokens"))

    children = staged(nodes.select("owner", "pa", "pb", "depth").unionByName(
        heads.select(F.col("conv_id").alias("owner"), "pa", "pb", "depth")), "trie-children")
    kids = children.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"))
    root = _root(conversations, of_conv, children, turns)
    ends = _ends_digest(shared.where(ended).select(*NODE, "conv_id").unionByName(
        root["ends"].select(*[F.lit(0).cast("bigint").alias(c) for c in NODE], "conv_id")))
    nothing = F.sha2(F.lit(""), 256)
    digests = staged(ends, "trie-ends")

    above = staged(nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), (F.col("depth") + 1).alias("depth"),
                                F.col("owner").alias("parent")), "trie-parents")
    first = F.when(F.col("depth") == 1, F.lit(root["owner"]).cast("bigint"))
    grouped = (
        nodes.join(above, ["pa", "pb", "depth"], "left").join(below, NODE).join(kids, NODE, "left")
        .join(digests, NODE, "left").select(
            F.col("owner").alias("conv_id"), "depth", F.coalesce(first, "parent", "owner").alias("parent_conv_id"),
            "n_convs", F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"), "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", nothing).alias("ends_sha256")))
    topped = _tail_nodes(
        heads.join(above, ["pa", "pb", "depth"], "left"), F.coalesce(first, "parent", "conv_id"))
    top = root["node"].join(digests.where("depth = 0").select("depth", "ends_sha256"), "depth", "left").select(
        *[c for c in COLUMNS if c != "ends_sha256"], F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    return top.unionByName(grouped).unionByName(topped).unionByName(tails).select(*COLUMNS)


def _root(conversations: DataFrame, of_conv: DataFrame, children: DataFrame, turns: DataFrame) -> dict:
    """The root's node without its digest, its smallest member, and the conversations that end there."""
    everyone = staged(conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).where(
        "conv_id IS NOT NULL").distinct(), "trie-members")
    sums = of_conv.agg(
        F.sum("leaf"), F.sum(F.col("total") - F.coalesce(F.col("total") - F.col("since"), F.lit(0)))).first()
    smallest, members = everyone.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    n_children = children.where("depth = 1").count()
    schema = ", ".join(f"{c} BIGINT" for c in COLUMNS if c != "ends_sha256")
    rows = [(smallest, 0, None, members, n_children, sums[0] or 1, sums[1] or 0)] if members else []
    return {
        "owner": smallest, "node": conversations.sparkSession.createDataFrame(rows, schema),
        "ends": everyone.join(of_conv.select("conv_id"), "conv_id", "left_anti"),
    }
