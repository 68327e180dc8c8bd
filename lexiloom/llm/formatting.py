"""Duplicates hidden by formatting differences (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, letters_digits

HOT_ROWS = 16  # a key of more rows is hot ...
MOST_HOT = 1 << 16  # ... if it also has over 1/65536 of all rows, so there are fewer hot keys than that
SALTS = 64


def canonical_key(fields=("kk", "ru")) -> Column:
    """256-bit key of what remains of a record without case, spaces, punctuation and field order."""
    return F.sha2(F.concat_ws("\x00", F.array_sort(F.array(*[letters_digits(c) for c in fields]))), 256)


def keyed(rows: DataFrame, id_col: str = "pair_id", fields=("kk", "ru")) -> DataFrame:
    return rows.select(F.col(id_col).cast("long").alias("id"), F.unhex(canonical_key(fields)).alias("key"))


def hot_keys(k: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key) of over ``hot_rows`` rows, counted exactly by partial counts that are combined
    before the shuffle; fewer than MOST_HOT keys of 32 bytes whatever the input."""
    least = max(hot_rows, k.count() // MOST_HOT)
    return durable(k.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > least).select("key"))


def representatives(k: DataFrame) -> DataFrame:
    """(key, first_id, copies) of hot keys by two-level aggregation over salts."""
    salted = k.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    part = salted.groupBy("key", "_s").agg(F.min("id").alias("m"), F.count("*").alias("c"))
    return part.groupBy("key").agg(F.min("m").alias("first_id"), F.sum("c").alias("copies"))


def copies(rows: DataFrame, id_col: str = "pair_id", fields=("kk", "ru"), hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, first_id, copies) of every row: its class's smallest id and its size.

    Texts are read and hashed once.  Rows of hot keys meet a broadcast table of fewer than
    MOST_HOT representatives and are not shuffled; all others take one shuffle by key, in
    which each class is reduced to its smallest id and its size before its rows are met.  A
    null field is an empty text; rows whose fields are all empty are copies of each other;
    an empty table gives no rows.
    """
    k = durable(keyed(rows, id_col, fields))
    hot = F.broadcast(hot_keys(k, hot_rows))
    reps = F.broadcast(representatives(k.join(hot, "key", "left_semi")))
    rest = k.join(hot, "key", "left_anti").repartition("key")
    per = rest.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    return k.join(reps, "key").select("id", "first_id", "copies").union(rest.join(per, "key").select("id", "first_id", "copies"))


def found(rows: DataFrame) -> DataFrame:
    c = copies(rows)
    return c.where("id <> first_id").select("first_id", F.col("id").alias("copy_id"))


def collapsed(rows: DataFrame) -> DataFrame:
    """(pair_id, copies): one record of each set of copies."""
    return copies(rows).where("id = first_id").select(F.col("id").alias("pair_id"), "copies")
