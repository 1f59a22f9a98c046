"""Quality scores by histogram gradient-boosted trees over document statistics.

Statistics come from the whole text only (``FEATURES``). Training bins each
statistic at quantiles and grows trees of fixed depth on gradient and hessian
histograms, for at most ``max_rows`` labelled documents, drawn by the hash of their
ids. The trees are flattened into arrays of complete binary trees; scoring walks all
documents of a batch through all trees at once with numpy.

The training sample is the only thing on the driver: ``max_rows`` rows of
``len(FEATURES)`` numbers (20,000 x 24 doubles, 4 MB), whatever the size of the
corpus. Scoring is one pass without a shuffle.

Defined cases: a null text counts as empty, and an empty text is scored like any
other. Without labels of both classes the score is the share of label 1 (0.5
without any label). Labels of null documents, null labels and labels other than 0
and 1 are left out; of several labels of a document each counts. A null doc_id is
not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut

FEATURES = (
    "log_bytes", "upper", "digit", "punctuation", "space", "high", "symbol", "comma_stop",
    "pipe", "log_words", "word_length", "distinct_words", "top_word", "repeat_next",
    "lower_first", "end_symbol", "log_lines", "line_length", "distinct_lines", "top_line",
    "entropy", "distinct_shingles", "short_words", "long_words",
)
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
    "punctuation": b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "space": b" \t\n\r\x0b\x0c",
    "high": bytes(range(128, 256)), "symbol": b"#$%&*@^~<>{}[]\\=+_", "comma_stop": b".,",
    "pipe": b"|",
}
_MASKS = np.array([[b in members for b in range(256)] for members in _CLASSES.values()], float)


def statistics(text: bytes) -> list[float]:
    """The numbers of ``FEATURES`` for a text in UTF-8; defined for the empty text."""
    n = max(len(text), 1)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(float)
    shares = counts / n
    seen = shares[shares > 0]
    words = text.split()
    w = max(len(words), 1)
    lines = [line for line in text.split(b"\n") if line]
    m = max(len(lines), 1)
    lengths = np.fromiter(map(len, words), float, len(words))
    kinds, line_kinds = _tally(words), _tally(lines)
    return [
        np.log1p(len(text)), *(_MASKS @ shares),
        np.log1p(len(words)), lengths.mean() if words else 0.0,
        len(kinds) / w, max(kinds.values(), default=0) / w,
        sum(a == b for a, b in zip(words, words[1:])) / w,
        sum(x[:1].islower() for x in words) / w,
        sum(x[-1:] in b"!#$%&*|" for x in words) / w,
        np.log1p(len(lines)), len(text) / m,
        len(line_kinds) / m, max(line_kinds.values(), default=0) / m,
        float(-(seen * np.log2(seen)).sum()),
        len(set(zip(words, words[1:], words[2:]))) / max(len(words) - 2, 1),
        float((lengths <= 2).sum()) / w, float((lengths >= 15).sum()) / w,
    ]


def _tally(items: list[bytes]) -> dict[bytes, int]:
    counts: dict[bytes, int] = {}
    for item in items:
        counts[item] = counts.get(item, 0) + 1
    return counts


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


# -- training -------------------------------------------------------------------


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64,
        rate: float = 0.2, least_hessian: float = 2.0, ridge: float = 1.0) -> dict[str, np.ndarray]:
    """Boosted trees as arrays: feature and threshold by inner node, value by leaf."""
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    base = np.log(share / (1 - share))
    inner = (1 << depth) - 1
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    value = np.zeros((trees, inner + 1))
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
        margin = np.full(len(y), base)
        for t in range(trees):
            p = 1 / (1 + np.exp(-margin))
            node = _grow(binned, edges, p - y, p * (1 - p), depth, bins, least_hessian, ridge,
                         feature[t], threshold[t])
            g = np.bincount(node, p - y, inner + 1)
            h = np.bincount(node, p * (1 - p), inner + 1)
            value[t] = -rate * g / (h + ridge)
            margin += value[t][node]
    return {"base": np.array(base), "feature": feature, "threshold": threshold, "value": value}


def _grow(binned, edges, g, h, depth, bins, least_hessian, ridge, feature, threshold):
    """Fill one tree level by level; the leaf of each row."""
    node = np.zeros(len(g), np.int64)
    columns = binned.shape[1]
    for level in range(depth):
        width = 1 << level
        at = (node[:, None] * columns + np.arange(columns)) * bins + binned
        size = width * columns * bins
        shape = (width, columns, bins)
        left_g = np.bincount(at.ravel(), np.repeat(g, columns), size).reshape(shape).cumsum(2)
        left_h = np.bincount(at.ravel(), np.repeat(h, columns), size).reshape(shape).cumsum(2)
        all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
        right_g, right_h = all_g - left_g, all_h - left_h
        gain = (left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge)
                - all_g**2 / (all_h + ridge))
        gain[(left_h < least_hessian) | (right_h < least_hessian)] = 0
        best = gain.reshape(width, -1).argmax(1)
        column, cut_at = best // bins, best % bins
        for i in range(width):
            slot = width - 1 + i
            feature[slot] = column[i]
            if gain[i].max() > 1e-9 and cut_at[i] < len(edges[column[i]]):
                threshold[slot] = edges[column[i]][cut_at[i]]
            else:
                cut_at[i] = bins
        node = 2 * node + (binned[np.arange(len(g)), column[node]] > cut_at[node])
    return node


# -- scoring --------------------------------------------------------------------


def score(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row; one pass over the levels for all trees."""
    if not len(x):
        return np.empty(0)
    feature, threshold, value = model["feature"], model["threshold"], model["value"]
    rows = np.arange(len(x))[:, None]
    trees = np.arange(len(feature))[None, :]
    node = np.zeros((len(x), len(feature)), np.int64)
    for _ in range(int(np.log2(value.shape[1]))):
        node = 2 * node + 1 + (x[rows, feature[trees, node]] > threshold[trees, node])
    margin = model["base"] + value[trees, node - feature.shape[1]].sum(1)
    return 1 / (1 + np.exp(-margin))


def _features_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    texts = batch.column(column)
    return np.array([statistics((v.as_py() or "").encode()) for v in texts], float).reshape(
        len(texts), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_rows: int = 20_000, **options) -> dict[str, np.ndarray]:
    """Trees fitted on labelled documents that are not held out, at most ``max_rows``."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    # The earliest ids by hash: the same sample in every run. About two samples pass the
    # first filter, so that one task never sorts all labels.
    known = known.where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    early = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < (2 * max_rows << 40) // max(1, known.count())
    chosen = known.where(early).orderBy(F.xxhash64("id"), "id", "y").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "text", 16 << 20):
            x = _features_of(batch, "text")
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.string()), batch.column("y"),
                 pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "x"])

    # Of repeated rows of a document one counts, so the driver gets a row for each label.
    sample = texts.join(chosen, "id").select("id", "y", "text").mapInArrow(
        numbers, "id STRING, y INT, x ARRAY<DOUBLE>").groupBy("id", "y").agg(F.min("x").alias("x")).toPandas()
    sample = sample.sort_values(["id", "y"], kind="stable")
    x = np.array(sample["x"].tolist(), float).reshape(len(sample), len(FEATURES))
    return fit(x, sample["y"].to_numpy(float), **options)


def scored(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text",
           score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        out = []
        for first in range(0, len(texts), 512):
            part = texts.iloc[first:first + 512]
            x = np.array([statistics((t or "").encode()) for t in part], float)
            out.append(score(model, x.reshape(len(part), len(FEATURES))))
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    return docs.withColumn(score_col, of(F.col(text_col).cast("string")))
