"""Helpers shared by the operators: staged tables, fresh names, cut batches."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.session import remove_path, scratch_path

#: A word of the contracts: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_open_scratch: list[list[str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared scratch folder; removed at the end of a :func:`scratch` block."""
    path = scratch_path(spark, label)
    for paths in _open_scratch:
        paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables and files written in the block when it ends.

    Results that read them have to be written elsewhere before. Without such a block they
    stay, as results may be read at any time.
    """
    paths: list[str] = []
    _open_scratch.append(paths)
    try:
        yield
    finally:
        _open_scratch.remove(paths)
        for path in paths:
            remove_path(spark, path)


def staged(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared scratch folder and read back.

    Cuts the lineage: a lost executor costs the tasks it ran, not the steps before,
    and what was random or dear is computed once.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(nullable(df.schema)).parquet(path)


def nullable(schema: StructType) -> StructType:
    return StructType.fromJson(
        schema.jsonValue() | {"fields": [f | {"nullable": True} for f in schema.jsonValue()["fields"]]}
    )


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def cut(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each hold about ``most`` bytes (or are one row)."""
    for batch in batches:
        sizes = batch.column(column)
        first, held = 0, 0
        for i, value in enumerate(sizes):
            n = len(value.as_buffer()) if value.is_valid else 0
            if held and held + n > most:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        if batch.num_rows > first:
            yield batch.slice(first)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session; harmless where it is installed."""
    if spark.sparkContext.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="ledgerlens-"), "ledgerlens.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(spark.sparkContext.applicationId)


def filesystem(uri: str):
    """The file system and path of a URI or an absolute path, for tasks that write files."""
    return fs.FileSystem.from_uri(uri)
