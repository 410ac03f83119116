"""Folders of queries that write: candle tables, checkpoints and results of streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or, where that is unset on a local master, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="stream-")
    return f"{shared}/stream-{uuid.uuid4().hex}"


def once(df: DataFrame) -> DataFrame:
    """``df`` from a table of its own, so that a query that reads it several times computes it once."""
    path = f"{scratch(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
