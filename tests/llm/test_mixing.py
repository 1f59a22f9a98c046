from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import mixing
from tests.llm.conftest import NASTY, SCHEMA, as_rows


def water_filling(sizes: dict, share=1.5, most=2, weights=(5, 2, 1)):
    """Targets by repeated resharing, as the contract words it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] >= most * sizes[s]}
        if not full:
            return target | {s: unit * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def check(rows, docs):
    words = Counter((i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in docs)
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == words
    sizes = defaultdict(int)
    for (_, source, size), n in words.items():
        sizes[source] += size * n
    target = water_filling(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    largest = defaultdict(int)
    for _, source, size in words:
        largest[source] = max(largest[source], size)
    for source in sizes:
        assert abs(taken[source] - target[source]) <= largest[source] / 2 + 1e-6
    return taken, target


def test_nasty_rows(nasty):
    check(mixing.mix(nasty).collect(), NASTY)


def test_several_levels_reach_the_targets(spark):
    docs = [(i, "w " * (1 + i * 37 % 211), "s" + str(min(i % 7, 2))) for i in range(9000)]
    rows = mixing.mix(spark.createDataFrame(as_rows(docs), SCHEMA)).collect()
    taken, target = check(rows, docs)
    assert all(abs(taken[s] - target[s]) < 60 for s in target)


def test_reruns_agree_whatever_the_partitioning(documents):
    def run(docs):
        return sorted((r.doc_id, r.taken) for r in mixing.mix(docs).collect())

    assert run(documents) == run(documents.repartition(13))


def test_expectations_are_kept(spark):
    docs = spark.createDataFrame(
        [(i, "w " * (1 + i % 9), "s") for i in range(400)], "doc_id BIGINT, text STRING, source STRING")
    runs = 40
    total = Counter()
    for seed in range(runs):
        for r in mixing.mix(docs, share=0.4, seed=seed).collect():
            total[r.size] += r.copies
    for size, copies in total.items():
        number = sum(1 for i in range(400) if 1 + i % 9 == size)
        assert copies / runs / number == pytest.approx(0.4, abs=0.05)


def test_rows_follow_the_decisions(nasty):
    decided = Counter()
    for r in mixing.mix(nasty).collect():
        decided[r.doc_id, r.source, r.size] += r.copies
    mixed = mixing.mixed_rows(nasty)
    assert mixed.columns == nasty.columns
    got = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in mixed.collect())
    assert got == +decided


def test_empty_table(nothing):
    assert mixing.mix(nothing).collect() == []
    assert mixing.mixed_rows(nothing).collect() == []


def test_only_native_operators(documents):
    plan = mixing.mix(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_many_repeated_rows_are_told_apart_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEATS", 50)
    docs = [(None, None, None)] * 700 + [(None, f"a b {i % 9}", "s") for i in range(900)]
    docs += [(i, "w " * (i % 7), "s" if i % 2 else "t") for i in range(300)]
    frame = spark.createDataFrame(as_rows(docs), SCHEMA).repartition(5)
    counted = mixing._counted(frame, "doc_id", "source", "text")
    apart = mixing._told_apart(counted)
    parts = [r["count"] for r in apart.where("doc_id IS NULL").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 1600 and max(parts) < 800
    ks = sorted(r.k for r in apart.where("doc_id IS NULL AND size = 3").collect())
    assert ks == list(range(1, 901))
    check(mixing.mix(frame).collect(), docs)
    decided = Counter()
    for r in mixing.mix(frame).collect():
        decided[r.doc_id, r.source, r.size] += r.copies
    rows = mixing.mixed_rows(frame)
    assert rows.columns == frame.columns
    texts = Counter((r.doc_id, r.source, r.text) for r in rows.collect())
    got = Counter()
    for (i, s, t), n in texts.items():
        got[i, s, len((t or "").split())] += n
    assert got == +decided
    # The same rows whatever the partitioning, and the same as without ranges.
    assert texts == Counter((r.doc_id, r.source, r.text) for r in mixing.mixed_rows(frame.repartition(9)).collect())
    monkeypatch.setattr(mixing, "REPEATS", 10_000)
    assert texts == Counter((r.doc_id, r.source, r.text) for r in mixing.mixed_rows(frame).collect())


def test_sources_are_ranked_across_ranges(spark):
    sizes = spark.createDataFrame([(f"s{i:04d}", 10, 1) for i in range(500)] + [(None, 10, 1)],
                                  "source STRING, size BIGINT, m BIGINT")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    want = water_filling({r.source: 10 for r in sizes.collect()})
    assert got == pytest.approx(want)
