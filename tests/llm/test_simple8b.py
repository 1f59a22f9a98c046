from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import simple8b
from ledgerlens.llm.queries import vocabulary
from tests.llm.conftest import NASTY

PATH = vocabulary("word_bpe_49k.json")


@pytest.mark.parametrize("block", [1, 7, 256])
def test_round_trip_of_all_widths(block):
    rng = random.Random(block)
    for n in (0, 1, 2, 255, 256, 257, 3000):
        for most in (0, 1, 3, 50_000, (1 << 32) - 1, (1 << 60) - 1, (1 << 64) - 1):
            ids = np.array([rng.randint(0, most) >> rng.choice([0, 0, 7, 40]) for _ in range(n)], np.uint64)
            words, offsets = simple8b.encode(ids, block)
            assert (simple8b.decode(words, offsets, n, block) == ids).all()


def test_escaped_ids_may_look_like_selectors():
    ids = np.array([(1 << 63) + 5, 3, (1 << 60), 0, (15 << 60) + 1, (1 << 61) + 1, 7], np.uint64)
    words, offsets = simple8b.encode(ids)
    assert (simple8b.decode(words, offsets, len(ids)) == ids).all() and len(words) > len(ids)


def test_small_ids_take_few_words():
    assert len(simple8b.encode(np.zeros(240, np.uint64))[0]) == 2
    assert len(simple8b.encode(np.full(256, 1000, np.uint64))[0]) == 43


def test_blocks_decode_alone():
    ids = np.arange(2000, dtype=np.uint64) * 7
    words, offsets = simple8b.encode(ids)
    part = words[int(offsets[3]):int(offsets[4])]
    assert (simple8b.decode(part, np.array([0, len(part)], np.uint64), 256) == ids[768:1024]).all()


def test_nasty_rows_come_back_in_order(nasty):
    rows = sorted((r.start, r.doc_id, bytes(r.ids)) for r in simple8b.round_trip(nasty, PATH).collect())
    plain = Tokenizer.from_file(PATH)
    want = Counter((i, np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
                   for i, t, _ in NASTY)
    assert Counter((i, ids) for _, i, ids in rows) == want
    at = 0
    for start, _, ids in rows:
        assert start == at
        at += len(ids) // 4
    keys = [-1 if i is None else i for _, i, _ in rows]
    assert keys == sorted(keys)


def test_several_files(documents, monkeypatch):
    monkeypatch.setattr(simple8b, "FILE_IDS", 3000)
    monkeypatch.setattr(simple8b, "BATCH_BYTES", 4000)
    rows = simple8b.round_trip(documents.repartition(5), PATH).collect()
    assert sorted(r.doc_id for r in rows) == [r.doc_id for r in sorted(rows, key=lambda r: r.start)]


def test_not_a_token_file():
    with pytest.raises(ValueError):
        simple8b.from_bytes(b"\0" * 64)


def test_empty_table(nothing):
    assert simple8b.round_trip(nothing, PATH).collect() == []
