"""Sharded translation: compaction, validation, batching, mapping with retry."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from .dedup import keep_first

MAPPED = "index long, source string, translation string, status string, error string"


def compacted(records: DataFrame, order: list[str], index: str = "index") -> DataFrame:
    return keep_first(records.where("status = 'ok'"), [index], order)


def remaining(inputs: DataFrame, done: DataFrame, index: str = "index") -> DataFrame:
    return inputs.join(done.select(index).distinct(), index, "left_anti")


def validation(records: DataFrame, expected: DataFrame, index: str = "index") -> DataFrame:
    """One row of counters over records against the expected (index, source) table.

    Records out of range take no further check.  Sources are compared without outer white
    space; mismatch and repetition are counted before the status; emptiness and sameness of
    ok records only.  An index counts as seen by any record in range; valid is a set with
    exactly one good record for each expected index.
    """
    e = expected.select(index, fx.strip("source").alias("_want"))
    d = records.withColumn("_src", fx.strip("source")).withColumn("_out", fx.strip("translation")).join(e, index, "left")
    there = F.col("_want").isNotNull()
    ok = there & F.coalesce(F.col("status") == "ok", F.lit(False))
    flags = {
        "out_of_range": ~there,
        "source_mismatch": there & (F.col("_src") != F.col("_want")),
        "errors": there & ~ok,
        "ok": ok,
        "empty": ok & (F.col("_out") == ""),
        "same": ok & (F.col("_src") != "") & (F.col("_src") == F.col("_out")),
    }
    per = d.groupBy(index).agg(F.count("*").alias("records"), F.max(there).alias("_there"), *(F.count_if(c).alias(k) for k, c in flags.items()))
    per = per.withColumn("duplicate", F.when(F.col("_there"), F.col("records") - 1).otherwise(0)).withColumn("unique_indexes", F.col("_there").cast("long"))
    names = ["records", *flags, "duplicate", "unique_indexes"]
    unseen = e.join(per.where("_there").select(index), index, "left_anti").agg(F.count("*").alias("missing"), F.min(index).alias("first_missing"))
    a = per.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names))
    a = a.unionByName(e.agg(F.count("*").alias("expected")), True).unionByName(unseen, True)  # one row each
    a = a.agg(*(F.max(c).alias(c) for c in a.columns))
    bad = sum((F.col(c) for c in ("out_of_range", "source_mismatch", "duplicate", "errors", "empty", "same", "missing")), F.lit(0))
    whole = (F.col("records") == F.col("expected")) & (F.col("ok") == F.col("expected")) & (F.col("unique_indexes") == F.col("expected"))
    return a.select("expected", *names, "missing", "first_missing", ((bad == 0) & whole).alias("valid"))


def strict_hypotheses(records: DataFrame, references: DataFrame, index: str = "index") -> DataFrame:
    """(index, source, reference, hypothesis) of records that fit the references (index, source,
    reference) one to one.  Raises on an index out of range, another source, a failed or empty
    record, a repeated index or a missing one; the first case in this order is named."""
    r = records.select(index, F.col("source").alias("_s"), "status", fx.strip("translation").alias("hypothesis"))
    j = r.join(references, index, "full")
    n = F.count("*").over(Window.partitionBy(index))
    failed = F.coalesce(F.col("status") != "ok", F.lit(True)) | (F.col("hypothesis") == "")
    there = F.col("reference").isNotNull()
    case = (
        F.when(~there, "outside the references")
        .when(F.col("hypothesis").isNull(), "missing")
        .when(~F.col("_s").eqNullSafe(F.col("source")), "another source")
        .when(failed, "failed or empty")
        .when(n > 1, "repeated")
    )
    bad = F.raise_error(F.concat(F.lit("index "), F.coalesce(F.col(index).cast("string"), F.lit("null")), F.lit(": "), F.col("_case"))).cast("string")
    j = j.withColumn("_case", case)
    return j.select(index, "source", "reference", F.when(F.col("_case").isNull(), F.col("hypothesis")).otherwise(bad).alias("hypothesis"))


def length_batches(df: DataFrame, size: int, bucket: int, length, pos: str) -> DataFrame:
    """(.., bucket, batch, place): rows in order of pos cut into buckets, each sorted by length
    and cut into batches; a batch stays in its bucket.  ``pos`` is a running number from 0,
    so the buckets need no sort of the whole table."""
    d = df.withColumn("bucket", F.floor(F.col(pos) / bucket)).withColumn("_len", length)
    rn = F.row_number().over(Window.partitionBy("bucket").orderBy("_len", pos)) - 1
    return d.withColumn("_rn", rn).withColumn("batch", F.floor(F.col("_rn") / size)).withColumn("place", F.col("_rn") % size).drop("_rn", "_len")


def map_with_retry(df: DataFrame, translate: Callable[[list[str]], list[str]], batch: int = 32) -> DataFrame:
    """A fallible text function over batches of (index, source).  A batch that fails is halved
    until the rows that fail stand alone; those become records with status error."""

    def run(frames):
        def go(idx, src):
            try:
                out = translate(src)
                if len(out) != len(src):
                    raise ValueError("as many outputs as inputs are needed")
                return [(i, s, o, "ok", None) for i, s, o in zip(idx, src, out)]
            except Exception as e:  # any failure of the function isolates its row
                if len(idx) == 1:
                    return [(idx[0], src[0], None, "error", f"{type(e).__name__}: {e}")]
                k = len(idx) // 2
                return go(idx[:k], src[:k]) + go(idx[k:], src[k:])

        for f in frames:
            idx, src = f["index"].tolist(), f["source"].tolist()
            rows = []
            for k in range(0, len(idx), batch):
                rows += go(idx[k : k + batch], src[k : k + batch])
            yield pd.DataFrame(rows, columns=["index", "source", "translation", "status", "error"])

    return df.select("index", "source").mapInPandas(run, MAPPED)
