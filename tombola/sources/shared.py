"""Folders that all executors reach, for queries that write before they read."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder's name under spark.checkpoint.dir, not met before. Where that
    setting is absent, a session whose executors are threads of this process
    gets a temporary folder, which goes with the process; any other is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df under spark.checkpoint.dir and goes on from there, for plans that
    name df several times: what it took to make df is then done once. Whether files whose
    frames are gone stay is up to spark.cleaner.referenceTracking.cleanCheckpoints."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(new_folder(spark, "checkpoint"))
    return df.checkpoint()
