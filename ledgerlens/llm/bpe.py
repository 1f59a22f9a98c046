"""Byte-pair encoding by a queue of merge ranks over a linked list, and decoding.

A piece (what the vocabulary's splitting rules leave together) starts as one symbol for
each character, linked to its neighbours. A priority queue holds every neighbouring pair
that can merge, by rank and place. The best entry is taken; one whose symbols have since
merged with others is stale and is skipped. A merge relinks the list and queues the two
new pairs, so a piece of n characters takes n log n steps, however long it is. Decoding
puts the vocabulary's strings one after another, with a blank between them where the
vocabulary names no decoder.

The tokenizers library gives the normal form of words beyond ASCII and their splitting
rules only; ids come from the merges here. A worker keeps the ids of the words and
pieces it has seen, so a frequent word costs one lookup; the words of a batch are
found in one Arrow index. Tasks share nothing, and no text is shuffled.

Strings of special tokens inside a text are those tokens, as in the library. Words are
encoded apart where the vocabulary drops white space; otherwise whole texts are split.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to
an empty one. Ids that the vocabulary does not have decode to nothing. A text of any
length is encoded whole; a batch holds about ``BATCH_BYTES`` of text or one row. Every
row is encoded on its own, repeated or not, and no rows give no rows. Only id and
text are read, so other columns cannot clash.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from ledgerlens.llm.common import cut
from ledgerlens.llm.encoding import _LETTERS, Store, _spread

BATCH_BYTES = 8 << 20
#: Distinct words and pieces kept by a worker; beyond it they are forgotten.
MOST_WORDS = 2_000_000
MOST_PIECES = 500_000

# White space other than blank and line break, as the vocabularies' rules define it.
_OTHER_SPACE = (r"[\t\r\x0b\x0c\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
                r"\x{202f}\x{205f}\x{3000}]")


class Merges:
    """Which neighbouring symbols merge, how early, and into what."""

    def __init__(self, vocabulary: dict[str, int], pairs: list) -> None:
        split = [tuple(p.split(" ", 1)) if isinstance(p, str) else tuple(p) for p in pairs]
        self.into = {
            (vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(split)
        }

    def apply(self, symbols: list[int]) -> list[int]:
        """The symbols that are left when no pair can merge any more; the best rank goes first."""
        into, n = self.into, len(symbols)
        symbol = list(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = [
            (*into[pair], at, pair) for at, pair in enumerate(zip(symbol, symbol[1:])) if pair in into
        ]
        heapq.heapify(queue)
        while queue:
            _, merged, at, (left, right) = heapq.heappop(queue)
            beside = after[at]
            if symbol[at] != left or beside >= n or symbol[beside] != right:
                continue  # stale: one of the two has merged since
            symbol[at], symbol[beside] = merged, -1
            further = after[at] = after[beside]
            if further < n:
                before[further] = at
                if found := into.get((merged, symbol[further])):
                    heapq.heappush(queue, (*found, at, (merged, symbol[further])))
            ahead = before[at]
            if ahead >= 0 and (found := into.get((symbol[ahead], merged))):
                heapq.heappush(queue, (*found, ahead, (symbol[ahead], merged)))
        return [s for s in symbol if s >= 0]


class Bpe:
    """A vocabulary file: ``encode`` for texts to ids, ``decode`` for ids to texts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        model = rules["model"]
        for feature in ("unk_token", "continuing_subword_prefix", "dropout", "byte_fallback", "ignore_merges"):
            if model.get(feature):
                raise ValueError(f"{path}: vocabularies with {feature} are not supported")
        self.vocabulary: dict[str, int] = model["vocab"]
        self.merges = Merges(self.vocabulary, model["merges"])
        self.suffix = model.get("end_of_word_suffix") or ""
        library = Tokenizer.from_file(path)
        self._normal = library.normalizer.normalize_str if library.normalizer else str
        self._split = library.pre_tokenizer.pre_tokenize_str
        # White space never reaches the ids, so words can be encoded apart.
        self.by_words = [p for p, _ in self._split(self._normal("a\t\n b"))] == ["a", "b"]
        self.special = {t["content"]: t["id"] for t in rules["added_tokens"]}
        known = sorted(self.special, key=len, reverse=True)
        self._special_at = re.compile("(" + "|".join(map(re.escape, known)) + ")") if known else None
        self._strings(rules.get("decoder"))
        self.pieces: dict[str, list[int]] = {}
        self.words = Store()

    # -- encoding ----------------------------------------------------------------

    def piece_ids(self, piece: str) -> list[int]:
        ids = self.pieces.get(piece)
        if ids is None:
            named = [*piece[:-1], piece[-1] + self.suffix]
            symbols = [self.vocabulary[s] for s in named if s in self.vocabulary]
            ids = self.merges.apply(symbols)
            if len(self.pieces) >= MOST_PIECES:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def plain_ids(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        return [i for piece, _ in self._split(self._normal(text)) for i in self.piece_ids(piece)]

    def text_ids(self, text: str) -> list[int]:
        """Ids of a whole text; strings of special tokens are cut out first."""
        if self._special_at is None:
            return self.plain_ids(text)
        ids: list[int] = []
        for part in self._special_at.split(text):
            ids += [self.special[part]] if part in self.special else self.plain_ids(part) if part else []
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and their number for each text."""
        if not self.by_words:
            own = [self.text_ids(t) for t in texts.to_pylist()]
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            return np.fromiter((i for ids in own for i in ids), np.uint32, int(sizes.sum())), sizes
        whole = (pc.match_substring_regex(texts, "|".join(map(re.escape, self.special)))
                 if self.special else pa.repeat(False, len(texts)))
        spaced = pc.replace_substring(pc.if_else(whole, "", texts), "\n", " ")
        if pc.any(pc.match_substring_regex(spaced, _OTHER_SPACE)).as_py():
            spaced = pc.replace_substring_regex(spaced, _OTHER_SPACE, " ")
        cut_up = pc.split_pattern(spaced, " ")
        coded = cut_up.flatten().dictionary_encode()
        if len(self.words.texts) > MOST_WORDS:
            self.words = Store()
        word = self.words.find(coded.dictionary, lambda new: [self.plain_ids(w) if w else [] for w in new])
        each = word[coded.indices.to_numpy()]
        sizes = self.words.sizes[each]
        flat = self.words.ids[_spread(self.words.starts[each], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[cut_up.offsets.to_numpy()]
        lengths = np.diff(ends)
        rare = np.flatnonzero(whole.to_numpy(zero_copy_only=False).astype(bool))
        if len(rare):
            parts = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
            for i, text in zip(rare, texts.take(pa.array(rare)).to_pylist()):
                parts[i] = np.array(self.text_ids(text), np.uint32)
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            flat = np.concatenate(parts)
        return flat, lengths

    # -- decoding ----------------------------------------------------------------

    def _strings(self, decoder: dict | None) -> None:
        """The bytes of every id in a row, each with the blank that follows it, if any."""
        kind = (decoder or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"decoder {kind} is not supported")
        self.blank = b" " if kind is None else b""
        by_id = {i: s for s, i in {**self.vocabulary, **self.special}.items()}
        if kind is None:
            strings = [by_id[i].encode() if i in by_id else None for i in range(max(by_id) + 1)]
        else:
            byte = {letter: value for value, letter in _LETTERS.items()}
            strings = [
                None if i not in by_id else by_id[i].encode() if by_id[i] in self.special
                else bytes(byte[c] for c in by_id[i]) for i in range(max(by_id) + 1)
            ]
        stored = [b"" if s is None else s + self.blank for s in strings]
        self._sizes = np.fromiter(map(len, stored), np.int64, len(stored))
        self._starts = np.cumsum(self._sizes) - self._sizes
        self._bytes = np.frombuffer(b"".join(stored), np.uint8)

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The texts of ids that lie in a row, ``lengths`` of them for each text."""
        known = np.where(ids < len(self._sizes), ids, 0).astype(np.int64)
        sizes = np.where(ids < len(self._sizes), self._sizes[known], 0)
        data = self._bytes[_spread(self._starts[known], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
        gap = len(self.blank)
        return [data[a:max(a, b - gap)].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]


@functools.lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    """One vocabulary for each file and worker process."""
    return Bpe(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Batches of (key, text) as batches of (key, ids)."""
    for batch in cut(batches, "text", BATCH_BYTES):
        flat, lengths = bpe(path).encode(pc.fill_null(batch.column("text"), ""))
        ends = np.concatenate([[0], np.cumsum(lengths)]) * 4
        ids = pa.Array.from_buffers(pa.binary(), len(lengths), [
            None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat, "<u4"))])
        yield pa.RecordBatch.from_arrays([batch.column(0), ids], [batch.schema.names[0], "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Batches of (key, ids) as batches of (key, ids, decoded)."""
    for batch in cut(batches, "ids", BATCH_BYTES):
        own = [np.frombuffer(i or b"", "<u4") for i in batch.column("ids").to_pylist()]
        lengths = np.fromiter(map(len, own), np.int64, len(own))
        texts = bpe(path).decode(np.concatenate(own), lengths)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column("ids"), pa.array(texts, pa.string())],
            [batch.schema.names[0], "ids", "decoded"])


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``ids``, little-endian unsigned 32-bit integers."""
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    schema = StructType([rows.schema[0], StructField("ids", BinaryType())])
    return rows.mapInArrow(lambda batches: _encode(batches, tokenizer), schema)


def decoded(rows: DataFrame, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``ids`` with ``decoded``, the text that the ids stand for."""
    given = rows.select(id_col, F.col("ids").cast("binary").alias("ids"))
    schema = StructType([*given.schema.fields, StructField("decoded", StringType())])
    return given.mapInArrow(lambda batches: _decode(batches, tokenizer), schema)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encoded`` and ``decoded`` in one pass of one worker: id, ids, decoded."""
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    schema = StructType([
        rows.schema[0], StructField("ids", BinaryType()), StructField("decoded", StringType())])
    return rows.mapInArrow(lambda batches: _decode(_encode(batches, tokenizer), tokenizer), schema)
