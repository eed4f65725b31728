"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Folders of our own, by application, where a local session names none.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where the session names none, one of our own in local mode, else an error.

    The setting is read, never set: a running session doesn't take it.
    """
    where = spark.conf.get(CHECKPOINT_DIR, None)
    if where:
        return where.rstrip("/")
    if spark.conf.get("spark.master", "").split("[")[0] != "local":
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    return _OWN[app]


def path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, lineage cut, safe from lost executors."""
    spark, at = df.sparkSession, path(df.sparkSession, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
