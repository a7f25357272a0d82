"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is empty, a temporary folder of a local master. Other masters need the setting."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is empty: set it to a folder that the driver and all executors share")
    if context.applicationId not in _local:
        at = tempfile.mkdtemp(prefix="spark-waymark-", dir="/tmp")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        _local[context.applicationId] = f"file://{at}"
    return _local[context.applicationId]


def written(df: DataFrame) -> DataFrame:
    """df as files of the shared folder, for tables that are made at some cost and read more than once."""
    at = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
