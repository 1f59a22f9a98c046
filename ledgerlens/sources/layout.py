"""Tables laid out by key, so that groupings by it need no shuffle, again and again.

A table in buckets is read a bucket a task. So a bucket that holds a hot key would be one
long task in every report, where a shuffle merges the key's rows before it moves them.
Hence the keys are chosen by measure: the first choice whose largest bucket stays within
``MOST_SHARE`` of the mean, and no buckets if none does. Results are the same in any layout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a bucket, some 100 MB of trades; their rollup by token takes a task under a GB.
ROWS_PER_BUCKET = 2_000_000

#: How many times the mean the largest bucket may hold.
MOST_SHARE = 2.0


def largest_buckets(df: DataFrame, choices: Sequence[Sequence[str]], buckets: int) -> list[int]:
    """Rows of the largest of ``buckets`` buckets by each of ``choices``; one scan of the keys.

    The writer deals rows by the same hash. Counts are merged before the shuffle: ``buckets``
    rows a choice and task.
    """
    dealt = F.array(*[F.struct(
        F.lit(i).alias("choice"), F.pmod(F.hash(*keys), F.lit(buckets)).alias("bucket"))
        for i, keys in enumerate(choices)])
    counts = df.select(F.inline(dealt)).groupBy("choice", "bucket").agg(F.count(F.lit(1)).alias("n"))
    largest = {r.choice: r.n for r in counts.groupBy("choice").agg(F.max("n").alias("n")).collect()}
    return [largest.get(i, 0) for i in range(len(choices))]


def write_clustered(
    df: DataFrame,
    table: str,
    choices: Sequence[Sequence[str]],
    order: Sequence[str] = (),
    buckets: int | None = None,
    path: str | None = None,
    least: int = 1,
    measured: DataFrame | None = None,
) -> list[str]:
    """Write ``df`` as ``table`` in buckets by the first balanced one of ``choices``; the chosen keys.

    Rows of a bucket are one sorted file, so bounds on the first column of ``order`` skip row
    groups in each. ``path`` makes an external table. Without ``buckets`` their number follows
    from the rows and is at least ``least``: a fixed number lets the memory of the task that
    groups a bucket grow with the table. An empty list says that every choice has a hot key: then the table has no
    buckets, and readers shuffle as they do elsewhere. ``measured`` has the keys of ``df`` at less
    cost, where ``df`` is a join that keeps its rows; a difference shows in bucket sizes only.
    """
    measured = df if measured is None else measured
    rows = measured.count()
    most = int(df.sparkSession.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    buckets = buckets or min(max(least, -(-rows // ROWS_PER_BUCKET)), most)
    bound = max(MOST_SHARE * rows / buckets, 1)
    sizes = largest_buckets(measured, choices, buckets)
    keys = next((list(keys) for keys, size in zip(choices, sizes) if size <= bound), [])
    placed = df.repartition(buckets, *keys) if keys else df
    writer = placed.write.format("parquet").option("compression", "zstd")
    if keys:
        writer = writer.bucketBy(buckets, *keys)
        writer = writer.sortBy(*order) if order else writer
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return keys
