"""Intermediate tables in the folder that the session names for checkpoints.

A table that nothing refers to any more can be dropped; what is left of a session's tables is
deleted when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that are still there, with their session.
_left: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder named by the session; only if unset, and on one machine, one for local tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillforge-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back. A filter by the last columns,
    if they are named, reads only their files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    remember(path, spark)
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def remember(path: str, spark: SparkSession) -> None:
    """Delete the path when the driver ends."""
    _left[path] = spark


def drop(df: DataFrame) -> None:
    """Delete what materialise wrote for df; neither it nor anything lazy that reads it may be used again."""
    path = getattr(df, "_scratch", None)
    if path in _left:
        _delete(path, _left.pop(path))


def _delete(path: str, spark: SparkSession) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _clear() -> None:
    while _left:
        with contextlib.suppress(Exception):  # the session may have ended before
            _delete(*_left.popitem())
