"""Proofs against trees built one node at a time."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import merkle
from ledgerlens.llm.queries import QUERIES

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, fanout=3):
    """The root, and for each leaf the runs it goes through with its place in them."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + fanout] for i in range(0, len(nodes), fanout)]
        for path, i in zip(paths, at):
            path.append((runs[i // fanout], i % fanout))
        at = [i // fanout for i in at]
        nodes = [digest(*run) for run in runs]
    return nodes[0], paths


def expected(rows, fanout=3):
    """doc_id, leaf, subroot, root, proof of each (doc_id, source, leaf); and the paths."""
    groups = defaultdict(list)
    for doc_id, source, leaf in rows:
        groups[source].append((doc_id, leaf))
    below, subroots = [], []
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        leaves = sorted(groups[source], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        subroot, paths = tree([leaf for _, leaf in leaves], fanout)
        subroots.append(subroot)
        below.append((leaves, paths, subroot))
    root, above = tree(subroots, fanout) if subroots else (None, [])
    found = []
    for (leaves, paths, subroot), upper in zip(below, above):
        for (doc_id, leaf), path in zip(leaves, paths):
            others = [n for run, k in path + upper for i, n in enumerate(run) if i != k]
            found.append((doc_id, leaf, subroot, root, digest(*others), path + upper))
    return found


def proven(df, **options):
    rows = df.withColumn("digest", merkle.leaf(*[F.col(c) for c in FIELDS]))
    return merkle.prove(rows, "doc_id", "source", "digest", **options).select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root",
        F.sha2(merkle.siblings(F.col("path")), 256).alias("proof"),
        merkle.fold(F.col("digest"), F.col("path")).alias("folded"))


def check(df, fanout=3, **options):
    rows = [(r.doc_id, r.source, leaf_of([r[c] for c in FIELDS])) for r in df.select(*FIELDS).collect()]
    got = proven(df, fanout=fanout, **options).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(e[:5] for e in expected(rows, fanout))
    assert all(r.folded == r.root for r in got)


@pytest.mark.parametrize("fanout, levels", [(3, 1), (2, 2)])
def test_groups_of_many_sizes(spark, fanout, levels):
    """Powers of the fanout and their neighbours; one level a block makes most rounds."""
    rnd = random.Random(levels)
    rows = [
        (rnd.randint(0, 200) if rnd.random() > 0.05 else None, rnd.choice(["t\n1", "t\n2", "", None]), "en", source, i % 3)
        for source, n in ((None, 5), ("a", 1), ("b", 82), ("é", 26), ("c", 27), ("", 9), ("B", 10)) for i in range(n)
    ]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    check(docs.repartition(5), fanout, levels=levels)


def test_rounds_with_a_short_last_subtree(spark):
    """The last block answers for all places its subtree does not have."""
    blocks = spark.range(3**4 + 1).selectExpr("'k' AS key", "id AS block", "sha2(string(id), 256) AS node")
    got = {r.block: r for r in merkle.butterfly(blocks, 3).collect()}
    nodes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(3**4 + 1)]
    root, paths = tree(nodes)
    assert len(got) == len(nodes) and {r.node for r in got.values()} == {root}
    for i, path in enumerate(paths):
        assert [(s.before, s.after) for s in got[i].path] == [
            ("".join(run[:k]), "".join(run[k + 1:])) for run, k in path]


def test_one_source_is_spread_over_partitions(spark):
    """Positions of a single group come from several partitions."""
    docs = spark.range(0, 3000, 1, 7).selectExpr(
        "(id * 7919) % 3000 AS doc_id", "string(id) AS text", "'en' AS lang", "'hot' AS source", "id AS n_chars")
    check(docs, levels=3)


def test_nasty_rows(nasty):
    check(nasty)


def test_empty_table(nothing):
    assert proven(nothing).collect() == []


def test_null_and_empty_fields_differ(spark):
    rows = spark.createDataFrame([(None, "a"), ("", "a"), ("-", "a"), ("1:a", None)], "x STRING, y STRING")
    found = [r[0] for r in rows.select(merkle.leaf(F.col("x"), F.col("y"))).collect()]
    assert found == [digest("-", "1:a"), digest("0:", "1:a"), digest("1:-", "1:a"), digest("3:1:a", "-")]


def test_query_equals_brute_force(spark, documents):
    rows = documents.collect()
    of_leaf = {}
    for r in rows:
        values = [r[c] for c in FIELDS]
        if zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and r.text is not None:
            values[4] = r.text.replace("\n", "")
        of_leaf[r.doc_id] = (leaf_of([r[c] for c in FIELDS]), leaf_of(values))
    want = set()
    for doc_id, leaf, subroot, root, proof, path in expected([(r.doc_id, r.source, of_leaf[r.doc_id][0]) for r in rows]):
        node = of_leaf[doc_id][1]
        for run, k in path:
            node = digest(*run[:k], node, *run[k + 1:])
        want.add((doc_id, leaf, subroot, root, proof, node, node == root))
    got = QUERIES["op12_merkle"](spark, "/root/testdata/sf0.001").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert 0 < sum(r.verified for r in got) < len(got)
