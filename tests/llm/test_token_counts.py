from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import token_counts
from ledgerlens.llm.common import scratch, staged
from ledgerlens.llm.encoding import encoder
from ledgerlens.llm.queries import vocabulary
from ledgerlens.session import path_exists
from tests.llm.conftest import NASTY

PATH = vocabulary("byte_bpe_50k.json")
SEP = token_counts.SEPARATOR


def by_hand(ids):
    """start, n_tokens, ended of each document, id by id."""
    out, start, n = [], 0, 0
    for at, i in enumerate(ids):
        if i == SEP:
            out.append((start, n, True))
            start, n = at + 1, 0
        else:
            n += 1
    return out + [(start, n, False)] * (n > 0)


@pytest.mark.parametrize("block", [1, 2, 3, 10, 1000])
def test_boundaries_across_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    files = {}
    for k, share in enumerate((0.5, 0.1, 0.01, 0, 1)):
        ids = np.where(rng.random(57) < share, SEP, rng.integers(0, 50_000, 57)).astype("<u2")
        files[f"f{k}.bin"] = ids
    files["none.bin"] = np.empty(0, "<u2")
    for name, ids in files.items():
        (tmp_path / name).write_bytes(ids.tobytes())
    listed = token_counts.flat_files(spark, str(tmp_path))
    got = {}
    for r in token_counts.count_tokens(listed, str(tmp_path), block_ids=block).collect():
        got.setdefault(r.file, []).append((r.ordinal, (r.start, r.n_tokens, r.ended)))
    for name, ids in files.items():
        want = by_hand(ids.tolist())
        assert sorted(got.get(name, [])) == list(enumerate(want))


def test_half_an_id_is_an_error(spark, tmp_path):
    (tmp_path / "odd.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="whole number of ids"):
        token_counts.count_tokens(token_counts.flat_files(spark, str(tmp_path)), str(tmp_path)).collect()


def test_nasty_rows(nasty, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "FILE_IDS", 50)
    path = str(tmp_path / "flat")
    rows = token_counts.write_flat(nasty, path, PATH)
    counted = token_counts.count_tokens(rows.select("file").distinct(), path, block_ids=64)
    got = Counter((r.doc_id, r.n_tokens) for r in rows.join(counted, ["file", "ordinal"]).collect())
    plain = Tokenizer.from_file(PATH)
    assert got == Counter((i, len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in NASTY)


def test_special_strings_are_text(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "c")], "doc_id BIGINT, text STRING")
    rows = token_counts.write_flat(docs, str(tmp_path / "s"), PATH)
    assert token_counts.count_tokens(rows.select("file").distinct(), str(tmp_path / "s")).count() == 2


def test_empty_table(nothing, tmp_path):
    rows = token_counts.write_flat(nothing, str(tmp_path / "e"), PATH)
    assert token_counts.count_tokens(rows.select("file").distinct(), str(tmp_path / "e")).collect() == []


def test_ids_that_the_files_cannot_hold_are_errors(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two")], "doc_id BIGINT, text STRING")
    path = vocabulary("byte_bpe_50k.json")
    with pytest.raises(ValueError):
        token_counts.write_flat(docs, str(tmp_path / "a"), path, separator=70_000)
    used = encoder(path, specials_as_text=True).encode(["one two"])[0]
    with pytest.raises(Exception, match="is an id of a text"):
        token_counts.write_flat(docs, str(tmp_path / "b"), path, separator=int(used[0]))


def test_scratch_is_removed(spark, tmp_path):
    with scratch(spark):
        kept = staged(spark.range(5), "gone")
        assert kept.count() == 5
        (path,) = {f.rsplit("/", 1)[0] for f in kept.inputFiles()}
    assert not path_exists(spark, path)
