"""Cutting lineage: tables written in the folder that all executors share, so that losing an executor costs a task, not the plan."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_PATHS: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where it is unset, in local runs and tests, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="geostrata-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written in the shared folder and read back. The files go by release(), clear(), or when the driver ends with its session alive."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _PATHS.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def exists(df: DataFrame) -> bool:
    """Whether a table that written() gave still has its files."""
    path = getattr(df, "_scratch", None)
    if not path:
        return False
    target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(target))


def release(df: DataFrame | None) -> None:
    """Delete the files of a table that written() gave, once nothing reads it any more: loops give back the round before last."""
    path = getattr(df, "_scratch", None)
    if path:
        _PATHS.discard(path)
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Delete all that is left, before the session ends."""
    while _PATHS:
        _delete(spark, _PATHS.pop())


def _remove() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and not spark.sparkContext._jsc.sc().isStopped():
        clear(spark)


atexit.register(_remove)
