"""Lineage cuts: tables that many steps read are written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` by checkpoint(), in spark.checkpoint.dir; a temporary folder of a session on one machine where that is unset (tests)."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table written beside the checkpoints, and its path: for loops, as checkpoints hand on what the optimizer knew of a plan, which grows with each round."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        cut(df.limit(0))
    path = f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(df: DataFrame, path: str) -> None:
    """Delete what ``written`` wrote."""
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
