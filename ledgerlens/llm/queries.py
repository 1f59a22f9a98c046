"""The registered queries: each operator over its whole table, as its contract asks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (
    ann, bpe, exact_dedup, merkle, mixing, packing, prefix_trie, quality_model, sharding, simhash,
    simple8b, substring_dedup, token_counts,
)
from ledgerlens.llm.common import new_path, ship, staged, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

#: The score from which a document counts as good.
GOOD = 0.3


def query(function: Query) -> Query:
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = shipped
    return shipped


def vocabulary(name: str) -> str:
    """The path of a public tokenizer file, the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_counts(spark, sf_dir):
    """Ids of each document, found by the separators of flat files."""
    path = new_path(spark, "flat")
    rows = token_counts.write_flat(
        table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    counted = token_counts.count_tokens(rows.select("file").distinct(), path)
    return rows.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens", "ended")


@query
def op2_ann(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


@query
def op3_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query
def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    return quality_model.scored(docs, model).select(
        "doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted"))


@query
def op5_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op6_simhash(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


@query
def op7_exact_dedup(spark, sf_dir):
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digests=True)
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                         F.col("sha").alias("text_sha256"))


@query
def op8_packing(spark, sf_dir):
    cut = packing.pieces(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 1)
    return packing.place(cut.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))


@query
def op9_simple8b(spark, sf_dir):
    read = simple8b.round_trip(
        table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))


@query
def op10_suffix_array(spark, sf_dir):
    return substring_dedup.removed_passages(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
        F.col("kept_sha").alias("kept_sha256"))


def spliced_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations of op11's contract: their turns in order, and all ids.

    Conversation c starts with the first h turns of c - c % 5 and goes on with its own
    after its first h. A conversation lends to five at most, and eight turns at most.
    """
    turns = staged(prefix_trie.in_order(prefix_trie.digested(conversations)), "own-turns")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    known = staged(sizes.select(
        "conv_id", "n", (F.crc32(F.col("conv_id").cast("string")) % 9).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % 5).alias("lender")), "conversations")
    lent = F.least("h", F.coalesce("lender_n", F.lit(0)))
    plan = staged(
        known.join(known.select(F.col("conv_id").alias("lender"), F.col("n").alias("lender_n")), "lender", "left")
        .select("conv_id", "h", "lender", lent.alias("lent")), "splices")
    own = turns.join(plan.select("conv_id", "h", "lent"), "conv_id").where("depth > h").withColumn(
        "depth", F.col("depth") - F.col("h") + F.col("lent"))
    given = turns.where("depth <= 8").withColumnRenamed("conv_id", "lender").join(
        plan.select("conv_id", "lender", "h"), "lender").where("depth <= h")
    columns = ["conv_id", "depth", "t1", "t2", "n_bytes"]
    return own.select(*columns).unionByName(given.select(*columns)), known.select("conv_id")


@query
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(*spliced_turns(table(spark, sf_dir, "conversations")))


@query
def op12_merkle(spark, sf_dir):
    """Proofs of every row, held against rows whose texts may have lost their line breaks."""
    docs = table(spark, sf_dir, "documents")
    broken = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = docs.withColumn("leaf", merkle.leaf(*fields, F.col("text"))).withColumn(
        "tampered", F.when(broken != F.col("text"), merkle.leaf(*fields, broken)).otherwise(F.col("leaf")))
    proven = merkle.prove(leaves, "doc_id", "source", "leaf", ["tampered"])
    folded = merkle.fold(F.col("tampered"), F.col("path"))
    return proven.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op13_bpe(spark, sf_dir):
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
