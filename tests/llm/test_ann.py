from __future__ import annotations

import math

import numpy as np

from ledgerlens.llm import ann

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, v STRING, block STRING, batch STRING"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", "x", "x") for i, v in rows], SCHEMA)


def brute(rows, queries, k):
    out = {}
    for q in queries:
        a = next(np.float32(v).astype(float) for i, v in rows if i == q)
        scores = [(-float(np.float32(v).astype(float) @ a), i) for i, v in rows if i != q]
        out[q] = sorted(scores)[:k]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (v * (0.5 + i % 3)).tolist()) for i, v in enumerate(rng.standard_normal((3000, 24)))]
    frame = vectors(spark, rows)
    found = ann.nearest(frame, frame.where("vec_id % 100 = 0"), 20, block=700).collect()
    want = brute(rows, range(0, 3000, 100), 20)
    hits = 0
    for q, best in want.items():
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 21))
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        hits += len({i for _, i, _ in own} & {i for _, i in best})
        for _, i, s in own:
            assert math.isclose(s, np.dot(*(np.float32(rows[j][1]).astype(float) for j in (i, q))), rel_tol=1e-12)
    assert hits / (20 * len(want)) >= 0.95


def test_nasty_vectors(spark):
    rows = [
        (0, [1.0, 0.0, 1.0]), (1, [1.0, 0.0, 1.0]), (2, [1.0, 0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]),
        (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (9, [1.0, 2.0]),
        (None, [1.0, 1.0, 1.0]), (10, [-1.0, 0.0, -1.0]), (2, [1.0, 0.0, 1.0]), (20, [0.0, 5.0, 0.0]),
    ]
    frame = vectors(spark, rows)
    got = [tuple(r) for r in ann.nearest(frame, frame.where("vec_id % 20 = 0"), 20).collect()]
    want = [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 2, 2.0), (0, 4, 20, 0.0), (0, 5, 10, -2.0)]
    want += [(20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0), (20, 4, 2, 0.0), (20, 5, 10, 0.0)]
    assert sorted(got) == want


def test_ties_go_to_the_smaller_id(spark):
    frame = vectors(spark, [(i, [1.0, 2.0]) for i in range(200)])
    got = ann.nearest(frame, frame.where("vec_id = 100"), 20, block=16).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(20))


def test_empty_tables(spark):
    frame = vectors(spark, [])
    assert ann.nearest(frame, frame).collect() == []
    some = vectors(spark, [(1, [1.0, 1.0])])
    assert ann.nearest(some, frame).collect() == [] and ann.nearest(some, some).collect() == []


def test_recall_with_uneven_norms(spark):
    rng = np.random.default_rng(6)
    even = rng.standard_normal((4000, 64))
    even /= np.linalg.norm(even, axis=1)[:, None]
    one_long = even.copy()
    one_long[17] *= 1000
    for v in (even * np.exp(rng.standard_normal(4000))[:, None], one_long):
        rows = [(i, x.tolist()) for i, x in enumerate(v)]
        frame = vectors(spark, rows)
        found = ann.nearest(frame, frame.where("vec_id % 100 = 0"), 20).collect()
        want = brute(rows, range(0, 4000, 100), 20)
        hits = sum(len({r.vec_id for r in found if r.query_id == q} & {i for _, i in best})
                   for q, best in want.items())
        assert hits / (20 * len(want)) >= 0.9


def test_norms_out_of_range_of_squares(spark):
    rows = [(i, [s * (1 + i % 7), s * (i % 5)]) for i, s in enumerate([1e-170] * 400 + [1e150] * 400)]
    frame = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    got = ann.nearest(frame, frame.where("vec_id = 7"), 20).orderBy("rank").collect()
    want = sorted((-np.dot(v, rows[7][1]), i) for i, v in rows if i != 7)[:20]
    assert [r.vec_id for r in got] == [i for _, i in want]


def test_queries_of_another_width_take_no_part(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(300)]
    asked = [(1000 + i, rng.standard_normal(3).tolist()) for i in range(20)] + rows[:5]
    schema = "vec_id BIGINT, embedding ARRAY<DOUBLE>"
    got = ann.nearest(spark.createDataFrame(rows, schema), spark.createDataFrame(asked, schema), 3).collect()
    assert {r.query_id for r in got} == {0, 1, 2, 3, 4} and len(got) == 15


def test_all_verified_is_exact(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((900, 12)) * np.exp(rng.standard_normal(900))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), 10, block=300, verified=1.0).collect()
    for q in range(0, 900, 20):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == np.argsort(-scores)[:10].tolist()
