"""Token ids of many texts: the tokenizers library, asked once for each distinct word.

Both vocabularies never merge across a single blank or line break between two other
characters, nor between letters and the punctuation after them. So a text's ids are
those of its words, and a word's those of its letters and its marks. A batch is cut into
words and dictionary-encoded by Arrow; only parts not seen before reach the
tokenizer, and the ids are put together by numpy. Texts with other white space,
doubled blanks or special-token strings go to the tokenizer whole, words with other
characters as words.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Tasks are the parallelism; a tokenizer must not start threads of its own.
os.environ["TOKENIZERS_PARALLELISM"] = "false"

#: Distinct parts kept by a worker, some 40 bytes each; beyond it the store is emptied.
MOST_PARTS = 2_000_000

_ODD = (r"[ \n][ \n]|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
        r"\x{202f}\x{205f}\x{3000}]|^[ \n]|[ \n]$|<\|")
_SPECIAL = r"<\|"
# What stands before, Latin letters, then ASCII marks but the apostrophe of contractions.
_PARTS = r"^(?P<lead>[\r\n]?)(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<marks>[!-&(-/:-@\[-^`{-~]*)$"


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions from each start on, as many as its size."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Store:
    """Ids of texts by position, found through an Arrow index."""

    def __init__(self):
        self.texts = pa.array([], pa.string())
        self.starts = self.sizes = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def add(self, texts: pa.Array, ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for own in ids for i in own), np.uint32, int(sizes.sum()))
        self.texts = pa.concat_arrays([self.texts, texts])
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.ids = np.append(self.ids, flat)

    def find(self, texts: pa.Array, learn) -> np.ndarray:
        """The positions of ``texts``; unknown ones are learnt first."""
        at = pc.index_in(texts, self.texts)
        if at.null_count:
            new = texts.filter(at.is_null()).unique()
            self.add(new, learn(new.to_pylist()))
            at = pc.index_in(texts, self.texts)
        return at.to_numpy(zero_copy_only=False).astype(np.int64)


class WordEncoder:
    """``encode`` gives the ids of texts, equal to the tokenizer's own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.folds_case = self.tokenizer.normalizer is not None
        self.store = Store()

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts; those marked by a carriage return are whole words for the tokenizer."""
        tokenize, letters = self.tokenizer.model.tokenize, _LETTERS
        rare = [p[1:] for p in parts if p[:1] == "\r"]
        found = iter(self.whole(rare)) if rare else iter(())
        return [
            next(found) if p[:1] == "\r"
            else [t.id for t in tokenize(p.encode().decode("latin-1").translate(letters))] if p else []
            for p in parts
        ]

    def _parts(self, words: pa.Array) -> pa.Array:
        """Three parts of each word, one after another: line break, letters, marks."""
        found = pc.extract_regex(words, _PARTS)
        plain = found.is_valid()
        lead, letters, marks = (pc.fill_null(pc.struct_field(found, i), "") for i in range(3))
        empty = pa.scalar("")
        if self.folds_case:
            head, letters = pa.repeat(empty, len(words)), pc.utf8_lower(letters)
            body = words
        else:
            broken, first = pc.equal(lead, "\n"), pc.equal(lead, "\r")
            none = pc.and_(pc.equal(letters, ""), pc.equal(marks, ""))
            blank = pc.if_else(pc.or_(pc.or_(broken, first), none), "", " ")
            head = pc.if_else(broken, "\n", "")
            bare = pc.equal(letters, "")
            letters = pc.if_else(bare, "", pc.binary_join_element_wise(blank, letters, ""))
            marks = pc.if_else(bare, pc.binary_join_element_wise(pc.if_else(pc.equal(marks, ""), "", blank), marks, ""), marks)
            start = pc.utf8_slice_codeunits(words, 0, 1)
            body = pc.if_else(pc.equal(start, "\r"), pc.utf8_slice_codeunits(words, 1),
                              pc.if_else(pc.equal(start, "\n"), words, pc.binary_join_element_wise(" ", words, "")))
        # Words with other characters: one part, marked.
        letters = pc.if_else(plain, letters, pc.binary_join_element_wise("\r", body, ""))
        return pa.concat_arrays([pc.if_else(plain, head, ""), letters, pc.if_else(plain, marks, "")])

    def _blanked(self, texts: pa.Array) -> pa.Array:
        """Texts with a blank between any two words; a carriage return stands at their start."""
        if self.folds_case:
            return pc.replace_substring(texts, "\n", " ")
        return pc.binary_join_element_wise("\r", pc.replace_substring(texts, "\n", " \n"), "")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and their number for each text."""
        given = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(given, _SPECIAL if self.folds_case else _ODD)
        cut = pc.split_pattern(self._blanked(pc.if_else(odd, "", given)), " ")
        coded = cut.flatten().dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy()
        if len(self.store.texts) > MOST_PARTS:
            self.store = Store()
        parts = self._parts(words)
        part = self.store.find(parts, self._learn).reshape(3, -1).T.ravel()
        sizes = self.store.sizes[part]
        known = self.store.ids[_spread(self.store.starts[part], sizes)]
        of_word = sizes.reshape(-1, 3).sum(1)
        each = of_word[at]
        flat = known[_spread((np.cumsum(of_word) - of_word)[at], each)]
        ends = np.concatenate([[0], np.cumsum(each)])[cut.offsets.to_numpy()]
        lengths = np.diff(ends)
        odd = odd.to_numpy(zero_copy_only=False).astype(bool)
        if odd.any():
            own = iter(self.whole([texts[i] for i in np.flatnonzero(odd)]))
            pieces = [np.array(next(own), np.uint32) if o else flat[a:b]
                      for o, a, b in zip(odd, ends[:-1], ends[1:])]
            lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
            flat = np.concatenate(pieces)
        return flat, lengths


@functools.lru_cache(maxsize=4)
def encoder(path: str, specials_as_text: bool = False) -> WordEncoder:
    """One encoder for each vocabulary, treatment of special-token strings and worker process."""
    words = WordEncoder(path)
    words.tokenizer.encode_special_tokens = specials_as_text
    return words


def with_ends(flat: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text's, and the lengths that include it."""
    return np.insert(flat, np.cumsum(lengths), end_id), lengths + 1


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return batch.column(column).fill_null("").to_pylist()
