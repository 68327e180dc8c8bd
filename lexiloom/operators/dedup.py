"""Exact deduplication with a stated order of preference.

The survivor of a key is the first row by explicit order columns, never by file order.
``keep_first`` aggregates a struct of the order columns, so the shuffle carries one row
per key and map task; the payload rides along in that struct only where it is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key.  Spark turns the rank filter into a group limit before the
    shuffle, so copies of a hot key do not travel."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def pair_dedup(df: DataFrame, order: list[str], a: str = "src", b: str = "tgt") -> DataFrame:
    return keep_first(df.withColumn("_key", fx.pair_md5(a, b)), ["_key"], order).drop("_key")


def union_priority(tables: list[DataFrame], key: Column, order: list[str]) -> DataFrame:
    """Union of the tables; of each key the row of the earliest table, then by order."""
    d = None
    for i, t in enumerate(tables):
        t = t.withColumn("_priority", F.lit(i))
        d = t if d is None else d.unionByName(t, allowMissingColumns=True)
    d = d.withColumn("_key", key)
    return keep_first(d, ["_key"], ["_priority", *order]).drop("_key")


def sentence_rows(df: DataFrame, pos: str, text: str) -> DataFrame:
    """(pos, seg, sentence) of a text column, seg from 0."""
    return df.select(F.col(pos), F.posexplode(fx.sentences(text)).alias("seg", "sentence"))


def seeded_dedup(candidates: DataFrame, seeds: DataFrame, order: list[str], sentence: str = "sentence") -> DataFrame:
    """Sentences that no seed has, the first of each without regard to case."""
    key = fx.sentence_key(sentence)
    d = candidates.withColumn("_key", key).join(seeds.select(key.alias("_key")).distinct(), "_key", "left_anti")
    return keep_first(d, ["_key"], order).drop("_key")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once: empty where the assertion of uniqueness holds."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def distinct_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.count_distinct(fx.text(a)).alias("unique_source"), F.count_distinct(fx.pair_md5(a, b)).alias("unique_pair"))
