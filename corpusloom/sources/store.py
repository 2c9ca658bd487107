"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session without the setting gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = at.get() if at.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession) -> str:
    """The shared folder as a path, for files that workers and the driver read by themselves."""
    at = urlparse(shared_folder(spark))
    if at.scheme not in ("", "file"):
        raise ValueError(f"arrays in files need spark.checkpoint.dir on a mounted file system, not {at.scheme}")
    return at.path


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: made once however often it is used, its size is known to the planner, and lost executors don't matter."""
    at = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.parquet(at)
