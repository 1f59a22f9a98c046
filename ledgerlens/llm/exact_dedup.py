"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

Method: one narrow pass takes each text's length and the hash of its first
characters. Lengths that occur once are settled; of the rest, so are pairs of length
and prefix hash that occur once. Only texts that are still in doubt are read whole
and hashed by SHA-256.

Defined cases: a null text counts as empty; empty texts equal each other. Of equal
texts the row with the largest id stays, null ids are smallest, and among rows of
the same id exactly one stays. Every row counts, repeated rows too. An empty table
gives an empty result. Other columns are neither read nor returned by
``exact_groups``, and ``keep_one`` returns all columns as they came.

Scale: all groupings are combined before their shuffles, so a text that a third of
the rows share is one partial row a task. Texts ride a shuffle only when the list of
doubtful keys is too large to broadcast by its measured size. The tables joined to rows,
doubtful keys and groups of several rows, are written first, so neither join reuses the
partitions of a grouping and adaptive execution splits the hot keys of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import fresh, staged, text_or_empty

PREFIX_CHARS = 256


def _outline(text: Column) -> list[Column]:
    return [
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("prefix"),
    ]


def doubtful_keys(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The (n_bytes, prefix) that more than one row has; written, so its size is known."""
    # Counted before they are compared, so a hot length or text is one row a task.
    pairs = staged(
        docs.select(*_outline(text_or_empty(text_col))).groupBy("n_bytes", "prefix").count(),
        "dedup-outline",
    )
    lengths = pairs.groupBy("n_bytes").agg(F.sum("count").alias("n")).where("n > 1").select("n_bytes")
    keys = pairs.join(lengths, "n_bytes", "left_semi").where("count > 1")
    return staged(keys.select("n_bytes", "prefix"), "dedup-keys")


def _in_doubt(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    return rows.join(keys, ["n_bytes", "prefix"], how)


def _elect(hashed: DataFrame) -> DataFrame:
    """Per text the row that stays and the number of rows."""
    return hashed.groupBy("n_bytes", "prefix", "sha").agg(
        F.max(F.struct("id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size")
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, sha.

    ``sha`` is null for texts settled before the full hash, unless ``digests`` asks for
    all of them.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), *_outline(text), text.alias("text"))
    keys = doubtful_keys(docs, text_col)
    hashed = staged(
        _in_doubt(rows, keys, "left_semi").select(
            "id", "n_bytes", "prefix", F.sha2("text", 256).alias("sha"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "dedup-hashed",
    )
    # Written first, so that the join shuffles its rows anew and can split a hot text.
    several = staged(_elect(hashed).where("group_size > 1"), "dedup-groups")
    single = F.col("group_size").isNull()
    groups = hashed.join(several, ["n_bytes", "prefix", "sha"], "left").select(
        "id",
        F.when(single, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (single | (F.col("row") == F.col("best.row"))).alias("kept"),
        "sha",
    )
    sha = F.sha2("text", 256) if digests else F.lit(None).cast("string")
    alone = _in_doubt(
        rows.select("id", "n_bytes", "prefix", sha.alias("sha")), keys, "left_anti"
    ).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "sha",
    )
    return groups.unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, of equal texts only the one with the largest id."""
    keys = doubtful_keys(docs, text_col).toDF("n_bytes", "prefix")
    size, prefix, sha, row = (fresh(docs, c) for c in ("__bytes", "__prefix", "__sha", "__row"))
    text = text_or_empty(text_col)
    outlined = docs.withColumns(dict(zip((size, prefix), _outline(text))))
    match = keys.withColumnsRenamed({"n_bytes": size, "prefix": prefix})
    alone = outlined.join(match, [size, prefix], "left_anti").select(*docs.columns)
    doubt = staged(
        outlined.join(match, [size, prefix], "left_semi")
        .withColumns({sha: F.sha2(text, 256), row: F.monotonically_increasing_id()}),
        "dedup-doubt",
    )
    best = _elect(doubt.select(
        F.col(id_col).alias("id"), F.col(size).alias("n_bytes"), F.col(prefix).alias("prefix"),
        F.col(sha).alias("sha"), F.col(row).alias("row"),
    )).select(F.col("best.row").alias(row))
    return doubt.join(best, row, "left_semi").select(*docs.columns).unionByName(alone)
