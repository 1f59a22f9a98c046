"""A Merkle manifest of a table: a digest for each row, group and table, and proofs.

Leaves ascend within their group; ``fanout`` consecutive nodes make their parent until one
is left, the group's root, and the groups' roots make the table's root in the same way.

Butterfly exchange: a partition holds an aligned block of ``fanout ** levels`` leaves
and climbs to the block's node by itself. Then, round by round, the aligned partitions
whose numbers differ in one digit (to the base of the fanout) swap the nodes of the
subtrees they belong to. Each of them hashes the common parent, so after the last round
every partition knows the root and all siblings on its way up; nothing is sent down
again. The last subtree of a level may hold fewer partitions than its partners: each
then answers for several, in turn, so that no partition serves all.

Scale: texts are hashed where they are read and not shuffled; what moves is some
hundred bytes a row. Positions come from range partitions, so a group that holds most
rows is spread like any other. A round moves one narrow row a block, and the number of
rounds is the logarithm of the blocks of the largest group.

Defined cases: null fields are written ``-``, empty ones ``0:``, so they differ. Null ids
and the null group come first. Rows of one id follow each other in the order of their
leaves; equal leaves are interchangeable. A text of any length is one leaf. No rows
give no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.llm.common import staged
from ledgerlens.llm.ranks import numbered

FANOUT = 3
#: Levels a partition climbs alone: 3 ** 7 leaves, some two megabytes of paths.
LEVELS = 7

PATH = "ARRAY<STRUCT<before: STRING, after: STRING>>"


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field with its length before it, so that none run together."""
    texts = [field.cast("string") for field in fields]
    framed = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*framed), 256)


def fold(node: Column, path: Column) -> Column:
    """The root that ``node`` leads to with the siblings of ``path``."""
    return F.aggregate(path, node, lambda below, step: F.sha2(F.concat(step["before"], below, step["after"]), 256))


def siblings(path: Column) -> Column:
    """The digests of a path one after another, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def climb(nodes: list[str], fanout: int, levels: int | None) -> list[tuple[list[str], list[str]]]:
    """What stands before and after each leaf's ancestor in its run, level by level.

    Without ``levels`` up to the only node.
    """
    found, width, first = [], len(nodes), list(range(len(nodes)))
    while levels is None and len(nodes) > 1 or levels is not None and len(found) < levels:
        runs = [nodes[i:i + fanout] for i in range(0, len(nodes), fanout)]
        around = [("".join(run[:k]), "".join(run[k + 1:])) for run in runs for k in range(len(run))]
        found.append(([around[i][0] for i in first], [around[i][1] for i in first]))
        nodes = [hashlib.sha256("".join(run).encode()).hexdigest() for run in runs]
        first = [first[i] // fanout for i in range(width)]
    return found


def _local_paths(rows: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``rows`` (key, block, pos, leaf and others) with their ``path`` within the block."""
    size = fanout**levels
    schema = StructType.fromDDL(f"path {PATH}")
    full = StructType([*rows.schema.fields, *schema.fields])

    def of_block(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        # An incomplete first block is the whole group, and ends at its root.
        alone = block.num_rows < size and block.column("block")[0].as_py() == 0
        steps = climb(block.column("leaf").to_pylist(), fanout, None if alone else levels)
        before, after = ([text for texts in zip(*[s[side] for s in steps]) for text in texts] for side in (0, 1))
        ends = pa.array(range(0, (block.num_rows + 1) * len(steps), len(steps)) if steps
                        else [0] * (block.num_rows + 1), pa.int32())
        path = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(
            [pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"]))
        return block.append_column("path", path)

    return rows.groupBy("key", "block").applyInArrow(of_block, full)


def butterfly(blocks: DataFrame, fanout: int) -> DataFrame:
    """Roots and upper paths of all ``blocks`` (key, block, node): key, block, node, path."""
    counts = staged(blocks.groupBy("key").agg((F.max("block") + 1).alias("n_blocks")), "block-counts")
    most = counts.agg(F.max("n_blocks")).first()[0] or 1
    state = blocks.join(counts, "key").withColumn("path", F.array().cast(PATH))
    step = 1
    while step < most:
        state = _swap(state, fanout, step)
        step *= fanout
    return state.select("key", "block", "node", "path")


def _swap(state: DataFrame, fanout: int, step: int) -> DataFrame:
    """One round: partners ``step`` blocks apart swap nodes; groups with one node left stay as they are.

    Partners meet by the number of their common parent and their place in the subtree.
    """
    def part(text: str) -> Column:
        return F.expr(text)

    placed = state.withColumns({
        "tree": part(f"block DIV {step}"), "place": part(f"block % {step}"),
        "going": part(f"n_blocks > {step}"),
    }).withColumns({
        "digit": part(f"tree % {fanout}"), "parent": part(f"tree DIV {fanout}"),
        "held": part(f"least({step}, n_blocks - tree * {step})"),
    })
    # In a short subtree the blocks take turns to answer for the places it does not have.
    answers = F.when(
        F.col("going") & (F.col("digit") > 0), part(f"sequence(place, {step - 1}L, held)")
    ).otherwise(F.array("place"))
    sent = placed.withColumn("at", F.explode(answers))
    met = sent.groupBy("key", "n_blocks", "going", "parent", "at", part("IF(going, -1L, block)").alias("apart")).agg(
        F.sort_array(F.collect_list(F.struct(
            "digit", "node", "block", "path", (F.col("at") == F.col("place")).alias("own")))).alias("met"))
    met = met.withColumn("nodes", F.transform("met", lambda m: m["node"]))
    each = met.select("key", "n_blocks", "going", "nodes", F.posexplode("met").alias("i", "mine")).where("mine.own")
    around = F.struct(
        F.array_join(part("slice(nodes, 1, i)"), "").alias("before"),
        F.array_join(part(f"slice(nodes, i + 2, {fanout})"), "").alias("after"))
    return each.select(
        "key", F.col("mine.block").alias("block"), "n_blocks",
        F.when(F.col("going"), F.sha2(F.array_join("nodes", ""), 256)).otherwise(F.col("mine.node")).alias("node"),
        F.when(F.col("going"), F.concat("mine.path", F.array(around))).otherwise(F.col("mine.path")).alias("path"))


def _trees(rows: DataFrame, fanout: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Leaves with their paths within a block, and the blocks with root and upper path."""
    size = fanout**levels
    low = staged(_local_paths(rows.withColumn("block", F.expr(f"pos DIV {size}")), fanout, levels), "merkle-paths")
    blocks = low.where(F.col("pos") % size == 0).select("key", "block", fold(F.col("leaf"), F.col("path")).alias("node"))
    return low, staged(butterfly(staged(blocks, "merkle-blocks"), fanout), "merkle-tops")


def prove(rows: DataFrame, order_col: str, group_col: str, leaf_col: str, carry: Sequence[str] = (),
          fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``rows``: the columns named, subroot, root and path.

    ``path`` holds what stands before and after each ancestor among its siblings, from the
    leaf to the table's root; see ``fold`` and ``siblings``.
    """
    named = {order_col: "order", group_col: "group", leaf_col: "leaf"} | {c: f"carry_{i}" for i, c in enumerate(carry)}
    given = rows.select(*[F.col(old).alias(new) for old, new in named.items()]).withColumns({
        # Groups in the order of their bytes, the null one first.
        "key": F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit("")),
        "tie": F.monotonically_increasing_id()})
    leaves = numbered(staged(given, "merkle-leaves"), ["key"], ["order", "leaf", "tie"]).drop("tie")
    low, tops = _trees(leaves, fanout, levels)

    subroots = tops.where("block = 0").select("key", F.col("node").alias("leaf"))
    ordered = numbered(staged(subroots, "merkle-subroots"), [], ["key"]).withColumnRenamed("key", "name")
    sub_low, sub_tops = _trees(ordered.withColumn("key", F.lit("")), fanout, levels)
    of_group = sub_low.join(sub_tops.select("block", F.col("node").alias("root"), F.col("path").alias("above")), "block")
    of_group = of_group.select(F.col("name").alias("key"), "root", F.concat("path", "above").alias("above"))
    upper = staged(tops.withColumnRenamed("node", "subroot").join(of_group, "key").select(
        "key", "block", "subroot", "root", F.concat("path", "above").alias("above")), "merkle-upper")
    return low.join(upper, ["key", "block"]).select(
        *[F.col(new).alias(old) for old, new in named.items()], "subroot", "root",
        F.concat("path", "above").alias("path"))
