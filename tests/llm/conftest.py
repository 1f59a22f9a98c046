from __future__ import annotations

import pytest

from ledgerlens.llm.common import ship

# Extra columns with the names that operators use inside.
CLASHING = ("row", "sha", "size", "key", "h", "fp", "k", "id", "prefix", "n_bytes", "score", "range")
SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, " + ", ".join(
    f"{name} STRING" for name in CLASHING)

LONG = " ".join(f"word{i % 977}" for i in range(40_000))


def as_rows(pairs):
    return [(doc_id, text, "en", source, None, *("x",) * len(CLASHING)) for doc_id, text, source in pairs]


# Nulls in every column, empty, blank and very long texts, ties and repeated rows.
NASTY = [
    (1, "One two three four five.", "a"), (2, "One two three four five.", "b"),
    (2, "One two three four five.", "b"), (3, None, "a"), (4, "", None), (5, " \t\n", "a"),
    (None, "One two three four five.", None), (None, None, None), (6, LONG, "b"), (7, LONG, "c"),
    (8, "dos años\nçè 日本語 tres", "c"), (9, "x", "c"), (9, "y", "c"), (9, "y", "c"),
]


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    ship(spark)


@pytest.fixture
def nasty(spark):
    return spark.createDataFrame(as_rows(NASTY), SCHEMA).repartition(3)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
