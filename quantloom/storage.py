"""Materialisation in the shared folder named by `spark.checkpoint.dir`."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_own_folders: dict[str, str] = {}  # application -> temporary folder of a local session
_written: dict[str, SparkSession] = {}  # path -> session that wrote it


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for a local session that names none."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        _own_folders[application] = tempfile.mkdtemp(prefix="quantloom-")
    return _own_folders[application]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the program ends unless `discard` does so before."""
    path = f"{shared_folder(spark).rstrip('/')}/quantloom/{label}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once as Parquet and read it back.

    Cuts the lineage with files that outlive any executor, and keeps column pruning and
    size statistics for the readers (a cached or checkpointed RDD has neither).
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(stored: DataFrame) -> None:
    """Delete the files behind a frame of `materialise` whose last reader has finished."""
    _delete(stored.stored_at)


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is None:
        return
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)


@atexit.register
def _clear() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session's process has gone already: leave the shared folder to its owner
            _written.pop(path, None)
    for folder in _own_folders.values():
        shutil.rmtree(folder, ignore_errors=True)
