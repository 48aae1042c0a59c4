"""Intermediate tables in the folder that executors share: lineage ends there, so a loop's plan doesn't grow."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A folder of its own under spark.checkpoint.dir; on one machine, without it, one that goes at the end."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return f"{shared.rstrip('/')}/lexmill-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lexmill-")
    atexit.register(shutil.rmtree, folder, True)
    return f"file://{folder}/table"


def stored(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
