"""Tables and folders on the storage that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``.  Where it is unset, a local session gets a
    folder of its own and a cluster an error: its executors share no local folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lexiloom-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write a table and read it back: computed once, lineage cut."""
    path = folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
