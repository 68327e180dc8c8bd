"""Token store: encoded pairs as Parquet with a manifest that says whether they are still valid."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text_io import _fs, fingerprints, replace_atomically

VERSION = 1


def metadata(spark: SparkSession, source: str, tokenizer: str, most: int) -> dict:
    """What a store depends on: the files' sizes and digests, the length limit, the format."""
    rows = fingerprints(spark, [source, tokenizer]).orderBy("path").collect()
    return {"files": [[r.path, r.size, r.sha256] for r in rows], "most": most, "version": VERSION}


def is_valid(spark: SparkSession, path: str, expected: dict) -> bool:
    p, fs = _fs(spark, f"{path}/manifest")
    q, _ = _fs(spark, f"{path}/tokens/_SUCCESS")
    if not (fs.exists(p) and fs.exists(q)):
        return False
    return json.loads(spark.read.text(f"{path}/manifest").first().value) == expected


def write(tokens: DataFrame, path: str, meta: dict) -> None:
    """Tokens first, the manifest last: a store without one is incomplete."""
    spark = tokens.sparkSession
    p, fs = _fs(spark, f"{path}/manifest")
    fs.delete(p, True)
    replace_atomically(tokens, f"{path}/tokens")
    replace_atomically(spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1), f"{path}/manifest", "text")


def read(spark: SparkSession, path: str, expected: dict) -> DataFrame:
    if not is_valid(spark, path, expected):
        raise ValueError(f"the token store at {path} is stale or incomplete")
    return spark.read.parquet(f"{path}/tokens")


def rows(store: DataFrame, first: int, count: int, pos: str = "pos") -> DataFrame:
    return store.where(F.col(pos).between(first, first + count - 1))
