from __future__ import annotations

import corpus_pipeline
from ledgerlens.llm import packing, quality_model
from ledgerlens.llm.common import staged
from ledgerlens.llm.queries import GOOD
from pyspark.sql import functions as F
from tests.llm.test_exact_dedup import expected
from tests.llm.test_mixing import check
from tests.llm.test_packing import check_sequences, ids_of
from tests.llm.test_simhash import fingerprint, groups

FOLDER = "/root/testdata/sf0.001"


def test_stages_are_the_five_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "simhash near-dedup", "mixing sources", "packing"]


def test_each_stage_against_its_own_input(spark, documents):
    docs = documents
    outputs = []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, FOLDER)
        if name != "packing":
            assert got.columns == documents.columns
        docs = staged(got, "test-stage")
        outputs.append(docs)
    good, once, apart, mixed, packed = ([*o.collect()] for o in outputs)

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality_model.train(documents, labels)
    scores = quality_model.scored(documents, model).collect()
    assert sorted(r.doc_id for r in good) == sorted(r.doc_id for r in scores if r.score >= GOOD)
    labelled = {r.doc_id: r.quality for r in labels.collect()}
    clean = {i for i, q in labelled.items() if q == 1}
    assert len(clean & {r.doc_id for r in good}) >= 0.97 * len(clean)

    want = expected([(r.doc_id, r.text) for r in good])
    assert sorted(r.doc_id for r in once) == sorted(i for (i, _, _, kept, _) in want.elements() if kept)

    prints = {r.doc_id: fingerprint(r.text) for r in once}
    same = groups(set(prints.values()))
    assert sorted(r.doc_id for r in apart) == sorted(
        {min(j for j in prints if prints[j] in same[p]) for p in prints.values()})

    words = {r.doc_id: len(r.text.split()) for r in apart}
    copies = {i: 0 for i in words}
    for r in mixed:
        copies[r.doc_id] += 1
    assert set(copies) == set(words) and max(copies.values()) <= 2
    decided = corpus_pipeline.mixing.mix(outputs[2]).collect()
    check(decided, [(r.doc_id, r.text, r.source) for r in apart])
    assert copies == {r.doc_id: r.copies for r in decided}

    check_sequences(packed, 2048)
    tokens = {r.doc_id: len(ids_of(r.text)) for r in mixed}
    assert sum(r.length for r in packed) == sum(tokens[r.doc_id] for r in mixed)


def test_pipeline_takes_nasty_documents(spark, nasty, nothing):
    for docs in (nasty, nothing):
        for _, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, FOLDER), "test-stage")
        assert docs.count() >= 0


def test_run_packs_what_the_stages_leave(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert set(rows.columns) == {
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    assert rows.agg(F.max("length")).first()[0] <= packing.LENGTH
