from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import substring_dedup, suffix_array
from tests.llm.conftest import NASTY


def brute(texts, window):
    """n_bytes, removed spans and digest of what stays, by counting all windows."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - window + 1):
            if seen[d[i:i + window]] > 1:
                gone[i:i + window] = [True] * window
        runs = [i for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1])]
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), len(runs), hashlib.sha256(kept).hexdigest()))
    return out


def results(frame, **options):
    rows = substring_dedup.removed_passages(frame, **options).collect()
    for r in rows:
        assert r.kept is None or hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha
        assert r.n_removed == sum(s.hi - s.lo for s in r.spans)
    return Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha) for r in rows)


def test_suffix_arrays_equal_sorting():
    rng = random.Random(1)
    cases = [[rng.randint(1, rng.choice([1, 2, 3, 30])) for _ in range(rng.randint(0, 60))] for _ in range(200)]
    cases += [[1] * 300, [1, 2] * 200, [2, 1] * 200, list(range(1, 200)) * 3, list(range(200, 0, -1)) * 2]
    for case in cases:
        s = [*case, 0]
        assert suffix_array.suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_common_prefixes_equal_comparison():
    rng = random.Random(2)
    for _ in range(100):
        s = [rng.randint(2, 3) for _ in range(40)] + [1] + [rng.randint(2, 3) for _ in range(20)] + [1, 0]
        left = np.array([*range(40, 0, -1), 0, *range(20, 0, -1), 0, 0])
        sa = suffix_array.suffix_array(np.array(s))
        before, shared = suffix_array.common_prefixes(np.array(s), sa, left)
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()):
            n = 0
            while n < min(left[a], left[b]) and s[a + n] == s[b + n]:
                n += 1
            assert before[b] == a and shared[b] == n


def test_windows_of_a_minimizer_cover_all_windows_once():
    rng = np.random.default_rng(1)
    for n in (0, 39, 40, 41, 500, 3000):
        h, at, first, last = substring_dedup.segments(rng.integers(0, 3, n).astype(np.uint8), 40, 8)
        covered = [w for a, b in zip(first, last) for w in range(a, b + 1)]
        assert covered == list(range(max(0, n - 39)))
        assert all(a <= p and p + 8 <= f + 40 for a, p, f in zip(last, at, first))


def passages(rng, n, window):
    """Documents of random words with shared passages, at random offsets, and copies."""
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(400)]
    shared = [" ".join(rng.choices(words, k=window // rng.choice([1, 2, 3]))) for _ in range(5)]
    docs = []
    for _ in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 30)))]
        for p in rng.sample(shared, rng.choice([0, 0, 1, 1, 2])):
            parts += [p[rng.randint(0, 9):], " ".join(rng.choices(words, k=rng.randint(0, 20)))]
        docs.append("".join(parts))
    return docs + docs[:3] + ["z" * 200, "zy" * 100, "z" * 150, "", None]


@pytest.mark.parametrize("hot", [1 << 20, 2000])
def test_all_repeats_and_nothing_else(spark, hot):
    texts = passages(random.Random(hot), 80, 60)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").repartition(4)
    got = results(frame, window=60, gram=10, hot_bytes=hot)
    assert got == Counter((i, *r) for i, r in enumerate(brute(texts, 60)))


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", 256)
    rng = random.Random(9)
    base = "".join(rng.choices("abcdef ", k=3000))
    texts = [base[:1700] + "X" + base[1800:], base[900:], "q" + base[100:400]]
    h = [substring_dedup.segments(np.frombuffer(t.encode(), np.uint8), 60, 10) for t in texts]
    covered = [[w for a, b in zip(x[2], x[3]) for w in range(a, b + 1)] for x in h]
    assert covered == [list(range(len(t) - 59)) for t in texts]


def test_nasty_rows(nasty):
    got = results(nasty)
    assert got == Counter((i, *r) for (i, _, _), r in zip(
        NASTY, brute_whole([t for _, t, _ in NASTY])))


def brute_whole(texts):
    """As ``brute``; the long texts differ nowhere, so they go whole."""
    short = brute([t if t is None or len(t) < 1000 else "" for t in texts], 400)
    gone = hashlib.sha256(b"").hexdigest()
    for k, t in enumerate(texts):
        if t and len(t) >= 1000:
            short[k] = (len(t.encode()), len(t.encode()), 1, gone)
    return short


def test_empty_table(nothing):
    assert substring_dedup.removed_passages(nothing).collect() == []
