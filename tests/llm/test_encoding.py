from __future__ import annotations

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import encoding, packing, token_counts
from ledgerlens.llm.queries import vocabulary

TEXTS = [
    "", " ", "\n", "a  b", "it's 's don't", "\tx y\r\n z", "<|endoftext|> a", "日本語 テキスト 12 34a", "Éa, b.\nC d", "a\n",
    "A_b _c", "µ ª ß Σας", "x\x1cy", "İstanbul é", "a ́b", "!!! ??\n...", "a|b |c", "é́ a", "end. ", "w x y z",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_tokenizer(name, documents, monkeypatch):
    monkeypatch.setattr(encoding, "MOST_PARTS", 900)  # the store is emptied on the way
    words, plain = encoding.WordEncoder(vocabulary(name)), Tokenizer.from_file(vocabulary(name))
    texts = TEXTS + [r.text for r in documents.select("text").collect()]
    for first in range(0, len(texts), 30):
        part = texts[first:first + 30]
        flat, lengths = words.encode(part)
        want = [e.ids for e in plain.encode_batch(part, add_special_tokens=False)]
        assert lengths.tolist() == [len(w) for w in want]
        assert flat.tolist() == [i for w in want for i in w]


def test_ends():
    flat, lengths = encoding.with_ends(np.array([5, 6, 7], np.uint32), np.array([0, 2, 1, 0]), 9)
    assert flat.tolist() == [9, 5, 6, 9, 7, 9, 9] and lengths.tolist() == [1, 3, 2, 1]


def test_special_tokens_do_not_depend_on_the_query_before(spark, tmp_path):
    path = vocabulary("byte_bpe_50k.json")
    texts = [f"a <|endoftext|> {i}" for i in range(64)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").repartition(16)
    plain = Tokenizer.from_file(path)
    want = {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    for _ in range(2):
        token_counts.write_flat(docs, str(tmp_path), path).count()
        assert {r.doc_id: r.doc_tokens for r in packing.pieces(docs, path).collect()} == want
    as_text = encoding.encoder(path, specials_as_text=True).encode(texts)[1]
    assert (as_text + 1 > [want[i] for i in range(64)]).all()
