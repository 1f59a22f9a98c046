"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime re-planning does the size checks (broadcast or shuffle), splits hot
# join keys and merges small shuffle partitions. Nothing here is tied to a data size.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Reports build long plans; recording a call site per column is most of that time.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

_local_scratch: dict[str, str] = {}


def build_session(app: str, master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above; ``settings`` (dots as ``__``) override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    merged = SETTINGS | {key.replace("__", "."): value for key, value in settings.items()}
    for key, value in merged.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for an intermediate table, under ``spark.checkpoint.dir``.

    The folder has to be shared by all executors, so a cluster must name it.
    Only a local session without the setting falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        app_id = spark.sparkContext.applicationId
        if app_id not in _local_scratch:
            _local_scratch[app_id] = tempfile.mkdtemp(prefix="ledgerlens-")
        base = _local_scratch[app_id]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder, on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
