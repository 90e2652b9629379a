"""The folder that driver and executors share, and tables cut from their lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one is set only where none is."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if known is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="rolefold-")
        atexit.register(shutil.rmtree, folder, True)
        known = f"file://{folder}"
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for loops whose plan would otherwise grow."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def sized(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: few or many, Spark knows their size before it plans a join with them."""
    path = f"{shared_dir(df.sparkSession)}/sized-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
