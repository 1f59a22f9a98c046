"""Versioned manifests: which folders of a store are in force.

A version is a small folder of rows that becomes visible as a whole. Writers add data
folders first and the version that names them last, so a job that fails in between leaves
folders that nobody reads and the old version in force. One job at a time may write.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Row, SparkSession

from ledgerlens.session import path_exists, remove_path


class Manifest:
    """The versions of one store; ``columns`` are those of a row, as DDL text with a ``folder``."""

    def __init__(self, spark: SparkSession, path: str, columns: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self._schema = f"version BIGINT, {columns}"

    def _folder(self, version: int) -> str:
        return f"{self.path}/manifest/v{version:09d}"

    def _all(self) -> list[Row]:
        folder = f"{self.path}/manifest"
        if not path_exists(self.spark, folder):
            return []
        return self.spark.read.schema(self._schema).option("recursiveFileLookup", True).json(folder).collect()

    def version(self) -> int:
        """How often the store has changed."""
        return max((r.version for r in self._all()), default=0)

    def rows(self) -> list[Row]:
        """The rows of the newest version."""
        found = self._all()
        newest = max((r.version for r in found), default=0)
        return [r for r in found if r.version == newest]

    def commit(self, rows: Sequence[tuple]) -> None:
        """Put ``rows``, at least one, into force instead of those of the newest version."""
        if not rows:
            raise ValueError("a version needs a row")
        version = self.version() + 1
        frame = self.spark.createDataFrame([(version, *row) for row in rows], self._schema)
        # The writer's own commit makes the folder visible as a whole.
        frame.coalesce(1).write.json(self._folder(version))

    def vacuum(self) -> None:
        """Remove the folders that only older versions name, then these versions.

        What still reads those folders will fail.
        """
        found = self._all()
        newest = max((r.version for r in found), default=0)
        kept = {r.folder for r in found if r.version == newest}
        for folder in {r.folder for r in found if r.folder} - kept:
            remove_path(self.spark, f"{self.path}/{folder}")
        for version in {r.version for r in found} - {newest}:
            remove_path(self.spark, self._folder(version))
