"""Nodes against a trie grown in memory."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import prefix_trie, ranks
from ledgerlens.llm.queries import QUERIES, spliced_turns

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, depth STRING, a STRING, tie STRING"


def talks(rows):
    """Turns (role, text) of each conversation in order; rows of one turn are equal here."""
    found = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            found[conv_id].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, x) for _, r, x in sorted(v, key=lambda t: t[0])] for c, v in found.items()}


def rebuilt(own):
    """The conversations of op11's contract."""
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
    return made


def expected(convs):
    members, kids = defaultdict(list), defaultdict(set)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    for prefix in members:
        if prefix:
            kids[prefix[:-1]].add(prefix)
    leaves, saved = defaultdict(int), defaultdict(int)
    for prefix, own in members.items():
        repeated = (len(own) - 1) * (len(prefix[-1][1].encode()) if prefix else 0)
        for d in range(len(prefix) + 1):
            saved[prefix[:d]] += repeated
            leaves[prefix[:d]] += not kids[prefix]
    return sorted(
        (own[0], len(p), members[p[:-1]][0] if p else None, len(own), len(kids[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in own if len(convs[c]) == len(p)).encode()).hexdigest())
        for p, own in members.items())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def nodes(spark, rows, cells=prefix_trie.CELLS):
    df = frame(spark, rows)
    return sorted(map(tuple, prefix_trie.trie(
        prefix_trie.in_order(prefix_trie.digested(df)), df.select("conv_id"), cells).collect()))


def random_rows(seed, convs=60):
    rnd = random.Random(seed)
    rows = []
    for c in range(convs):
        style = rnd.choice(["ab", "abcdefgh", "a"])
        rows += [(c, t, rnd.choice(["user", None]) if style == "ab" else "user", rnd.choice(style) * (t % 3 + 1))
                 for t in range(rnd.randint(1, 9))]
    return rows


@pytest.mark.parametrize("cells", [prefix_trie.CELLS, 8])
def test_irregular_conversations(spark, monkeypatch, cells):
    """Nulls, ties, repeats, long texts, one long conversation, and many ends at one node,
    whose ids lie in several chunks. A small sketch takes nearly all prefixes for shared."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    rows = random_rows(cells) + [
        (101, None, "user", "first"), (101, 0, None, None), (101, 3, "user", "x" * 100_000),
        (102, None, "user", "first"), (102, 0, "", ""), (102, 3, "user", "x" * 100_000), (102, 3, "user", "x" * 100_000),
        (-4, 1, "user", "first"), (107, 1, "us", "erfirst"), (None, 1, "user", "lost"), (None, None, None, None),
    ]
    rows += [(c, 1, "user", "same" if c % 3 else f"own {c}") for c in range(200, 300)]
    rows += [(400, t, "user", str(t)) for t in range(150)] + [(c, 0, "user", "0") for c in range(401, 410)]
    found = nodes(spark, rows, cells)
    assert found == expected(talks(rows)) and any(r[6] > 100_000 for r in found)


def test_screening_keeps_tails_out_of_the_groups(spark):
    rows = [(c, t, "user", f"{c} {t}" if t > 1 else str(t)) for c in range(50) for t in range(20)]
    turns = prefix_trie.in_order(prefix_trie.digested(frame(spark, rows)))
    found = prefix_trie.screened(prefix_trie._prefixes(turns)).groupBy("depth").agg(
        F.count_if("below_alone").alias("tails"), F.count_if("alone").alias("alone")).collect()
    assert {r.depth: (r.tails, r.alone) for r in found} == {
        d: (50 * (d > 3), 50 * (d > 2)) for d in range(1, 21)}


def test_conversations_without_turns_and_an_empty_table(spark):
    some = frame(spark, [(3, 1, "user", "a"), (4, 1, "user", "b")])
    turns = prefix_trie.in_order(prefix_trie.digested(some))
    bare = prefix_trie.trie(turns.where("false"), some.select("conv_id")).collect()
    assert sorted(map(tuple, bare)) == expected({3: [], 4: []})
    assert nodes(spark, []) == []


def test_query_equals_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_prefix_trie"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got)) == expected(rebuilt(talks(rows)))


def test_splices_of_absent_short_and_negative_conversations(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in [-7, -5, 1, 2, 5, 6, 9, 10, 12, 13] for t in range(1 + abs(c) % 6)]
    got = prefix_trie.trie(*spliced_turns(frame(spark, rows))).collect()
    assert sorted(map(tuple, got)) == expected(rebuilt(talks(rows)))


def test_positions_and_totals_across_partitions(spark):
    rows = spark.range(0, 4000, 1, 8).selectExpr(
        "IF(id % 3 = 0, NULL, IF(id % 7 = 0, id, 1)) AS g", "(id * 7919) % 4000 AS o", "id AS v")
    got = ranks.numbered(rows, ["g"], ["o"], sums={"total": "v"}, xors={"mixed": "v"}).collect()
    groups = defaultdict(list)
    for r in rows.collect():
        groups[r.g].append((r.o, r.v))
    want = set()
    for g, own in groups.items():
        total = mixed = 0
        for pos, (o, v) in enumerate(sorted(own)):
            total, mixed = total + v, mixed ^ v
            want.add((g, o, v, pos, total, mixed))
    assert {tuple(r) for r in got} == want and len(got) == 4000
