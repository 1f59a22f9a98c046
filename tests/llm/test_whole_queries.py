"""Each registered query over its whole table at sf0.001, against a brute-force version of its contract."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm.queries import GOOD, QUERIES, vocabulary
from tests.llm.test_mixing import check
from tests.llm.test_passages import brute
from tests.llm.test_simhash import fingerprint, groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    """Text by doc_id, null as empty."""
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, name):
    return QUERIES[name](spark, SF).collect()


def ids_of(file, texts, end=None, as_text=False):
    """Ids of every text by the tokenizers library, with the end id."""
    tokenizer = Tokenizer.from_file(vocabulary(file))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = as_text
    ends = [] if end is None else [end]
    return {i: tokenizer.encode(t, add_special_tokens=False).ids + ends for i, t in texts.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, texts):
    ids = ids_of("byte_bpe_50k.json", texts, as_text=True)
    assert {r.doc_id: (r.n_tokens, r.ended) for r in result(spark, "op1_token_counts")} == {
        i: (len(v), True) for i, v in ids.items()}


def test_op2(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    vector = next(c for c in rows[0].asDict() if isinstance(rows[0][c], list))
    ids = [r.vec_id for r in rows]
    matrix = np.array([r[vector] for r in rows], np.float64)
    found = defaultdict(list)
    for r in result(spark, "op2_ann"):
        found[r.query_id].append(r)
    assert set(found) == {i for i in ids if i % 20 == 0}
    right = 0
    for query, near in found.items():
        near.sort(key=lambda r: r["rank"])
        at = ids.index(query)
        scores = dict(zip(ids, matrix @ matrix[at]))
        del scores[query]
        best = sorted(scores, key=lambda i: (-scores[i], i))[:20]
        assert [r["rank"] for r in near] == list(range(1, len(best) + 1))
        assert [(r.score, -r.vec_id) for r in near] == sorted(((r.score, -r.vec_id) for r in near), reverse=True)
        for r in near:
            assert r.score == pytest.approx(scores[r.vec_id], abs=1e-12)
        right += len(set(best) & {r.vec_id for r in near})
    assert right >= 0.9 * 20 * len(found)


def test_op3(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    mixed = result(spark, "op3_mixing")
    check(mixed, docs)
    assert sorted(map(tuple, mixed)) == sorted(map(tuple, result(spark, "op3_mixing")))


def test_op4(spark, texts):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    scored = {r.doc_id: r for r in result(spark, "op4_quality")}
    assert set(scored) == set(texts)
    for i, r in scored.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= GOOD)
    tested = [(scored[i].score, quality) for i, quality in labels.items() if scored[i].held_out]
    good, bad = [s for s, q in tested if q == 1], [s for s, q in tested if q != 1]
    pairs = [(g > b) + (g == b) / 2 for g in good for b in bad]
    assert pairs and sum(pairs) >= 0.9 * len(pairs)


def test_op5(spark, texts):
    rows = {r.doc_id: r for r in result(spark, "op5_sharding")}
    assert set(rows) == set(texts)
    shards, of_text = defaultdict(list), defaultdict(set)
    for i, text in texts.items():
        r = rows[i]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (
            len(text.encode()) + 1, zlib.crc32(text.encode()), "bytes", None)
        shards[r.shard].append(r)
        of_text[text].add(r.shard)
    assert set(shards) <= set(range(16)) and all(len(s) == 1 for s in of_text.values())
    for held in shards.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    sizes = [sum(r.size for r in shards[s]) for s in range(16)]
    copies = Counter(texts.values())
    assert max(sizes) - min(sizes) <= 2 * max(n * (len(t.encode()) + 1) for t, n in copies.items())


def test_op6(spark, texts):
    points = {i: fingerprint(t) for i, t in texts.items()}
    members = groups(set(points.values()))
    smallest = {}
    for i in sorted(points):
        smallest.setdefault(members[points[i]], i)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in result(spark, "op6_simhash")} == {
        i: (f"{p:016x}", smallest[members[p]]) for i, p in points.items()}


def test_op8(spark, texts):
    ids = ids_of("byte_bpe_50k.json", texts, end=1)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in result(spark, "op8_packing"):
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start:r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for held, whole in [*[(pieces[i], len(ids[i])) for i in ids], *[(s, None) for s in sequences.values()]]:
        at = 0
        for start, length in sorted(held):
            assert start == at and length > 0
            at += length
        assert at == whole if whole is not None else at <= 2048
    assert len(sequences) <= 1.05 * sum(map(len, ids.values())) / 2048 + 1


def test_op9(spark, texts):
    ids = ids_of("word_bpe_49k.json", texts, end=2)
    at, expected = 0, {}
    for i in sorted(ids):
        expected[i] = (at, len(ids[i]), crc(ids[i]))
        at += len(ids[i])
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in result(spark, "op9_simple8b")} == expected


def test_op10(spark, texts):
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in result(spark, "op10_suffix_array")
            } == dict(zip(texts, brute(texts.values(), 400)))


def test_pipeline_rows_come_from_documents(spark, texts):
    """What is packed are whole documents that the classifier keeps, each text once before the mixture."""
    from corpus_pipeline import run

    score = {r.doc_id: r.score for r in result(spark, "op4_quality")}
    packed = Counter()
    ids = {}
    for r in run(spark, SF).collect():
        packed[r.doc_id] += r.length
        ids[r.doc_id] = r.doc_tokens
    whole = ids_of("byte_bpe_50k.json", {i: texts[i] for i in packed}, end=1)
    for i, n in packed.items():
        assert score[i] >= GOOD and ids[i] == len(whole[i])
        assert n % len(whole[i]) == 0 and 1 <= n // len(whole[i]) <= 2
    assert len({texts[i] for i in packed}) == len(packed)
