from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import quality_model as qm


def test_nasty_rows_are_scored(nasty):
    model = qm.fit(np.random.default_rng(1).random((50, len(qm.FEATURES))), np.arange(50) % 2.0)
    rows = qm.scored(nasty, model, score_col="new").collect()
    assert len(rows) == nasty.count() and all(0 <= r.new <= 1 for r in rows)
    assert len({r.new for r in rows if not r.text}) == 1


def test_statistics_are_finite():
    for text in ("", " ", "\n\n", "a", "日本", "x " * 10_000):
        values = qm.statistics(text.encode())
        assert len(values) == len(qm.FEATURES) and all(map(math.isfinite, values))


def walk(model, row):
    """One row through the trees, node by node."""
    margin = float(model["base"])
    for feature, threshold, value in zip(model["feature"], model["threshold"], model["value"]):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
        margin += value[node - len(feature)]
    return 1 / (1 + math.exp(-margin))


def test_flat_trees_equal_a_walk_and_learn():
    rng = np.random.default_rng(3)
    x = rng.random((600, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = qm.fit(x[:400], y[:400])
    got = qm.score(model, x)
    assert got == pytest.approx([walk(model, r) for r in x])
    assert ((got[400:] > 0.5) == y[400:]).mean() > 0.95


def test_one_class_or_no_label(documents, spark):
    schema = "doc_id BIGINT, quality INT"
    for labels, score in (([], 0.5), ([(1, 1), (2, 1), (3, 1), (None, 0), (4, None), (6, 7)], 0.99)):
        model = qm.train(documents, spark.createDataFrame(labels, schema))
        assert qm.score(model, np.zeros((1, len(qm.FEATURES))))[0] == pytest.approx(score)


def test_held_out_documents(spark):
    ids = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id BIGINT")
    for r in ids.select("doc_id", qm.held_out(F.col("doc_id")).alias("out")).collect():
        assert r.out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = qm.train(docs, labels)
    rows = qm.scored(docs, model).join(labels, "doc_id").where(qm.held_out(F.col("doc_id"))).collect()
    assert np.mean([(r.score >= 0.3) == (r.quality == 1) for r in rows]) >= 0.95


def test_training_does_not_depend_on_partitions(documents, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    a, b = qm.train(documents, labels), qm.train(documents.repartition(7), labels.repartition(5))
    assert all(np.array_equal(a[k], b[k]) for k in a)


def test_empty_table(nothing, spark):
    model = qm.train(nothing, spark.createDataFrame([], "doc_id BIGINT, quality INT"))
    assert qm.scored(nothing, model, score_col="new").collect() == []


def test_repeated_documents_count_once(documents, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality IN (0, 1)")
    often = labels.where(~qm.held_out(F.col("doc_id"))).orderBy("doc_id").limit(1)
    copies = documents.join(often.select("doc_id"), "doc_id").crossJoin(spark.range(300)).select(documents.columns)
    once = qm.train(documents, labels)
    again = qm.train(documents.unionByName(copies), labels.unionByName(often).unionByName(often))
    assert all(np.array_equal(once[k], again[k]) for k in once)
