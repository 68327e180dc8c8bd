"""Predicates of corpus cleaning, as columns that name the reason."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as fx


def pair_status(a: Column, b: Column, most: int = 256) -> Column:
    """``ok``, or why cleaning drops a normalised pair; most 0 sets no upper length."""
    na, nb = fx.word_count(a), fx.word_count(b)
    c = F.when((a == "") | (b == ""), "empty").when(a == b, "identical").when((na <= 1) | (nb <= 1), "short")
    return (c.when((na > most) | (nb > most), "long") if most else c).otherwise("ok")


def merge_valid(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (a != b)


def language_gate(label: str, wanted: str = "kaz") -> Column:
    return F.coalesce(F.col(label), F.lit(wanted)) == wanted


def classifier(predict: Callable[[list[str]], list[str]]) -> Callable[[Column], Column]:
    """Any function from texts to labels as an Arrow column function."""

    @F.pandas_udf(T.StringType())
    def label(s: pd.Series) -> pd.Series:
        return pd.Series(predict(s.fillna("").tolist()))

    return label


def both_sides(df: DataFrame, label: Callable[[Column], Column], a: str, b: str, want_a: str, want_b: str) -> DataFrame:
    """Rows whose two sides get the labels expected of them."""
    return df.where((label(fx.text(a)) == want_a) & (label(fx.text(b)) == want_b))


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product of two vectors, in order of their components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def encoder(encode: Callable, dims: int | None = None) -> Callable[[Column], Column]:
    """Any function from texts to vectors as an Arrow iterator function: what it loads, it
    loads once per worker."""

    @F.pandas_udf(T.ArrayType(T.FloatType()), functionType=F.PandasUDFType.SCALAR)
    def vectors(s: pd.Series) -> pd.Series:
        return pd.Series(list(encode(s.fillna("").tolist())))

    return vectors


def scorer(score: Callable) -> Callable[[Column, Column], Column]:
    """Any function from hypotheses and references to scores as an Arrow column function."""

    @F.pandas_udf(T.DoubleType())
    def scores(h: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(score(h.fillna("").tolist(), r.fillna("").tolist()), dtype="float64")

    return scores


def aligned(df: DataFrame, a: str, b: str, least: float = 0.55) -> DataFrame:
    return df.withColumn("score", dot(a, b)).where(F.col("score") >= least)


def publishable(df: DataFrame) -> DataFrame:
    """Records with status ok, both sides non-empty and not the same."""
    s, t = fx.strip("source"), fx.strip("translation")
    d = df.withColumn("_s", s).withColumn("_t", t)
    return d.where("status = 'ok' AND _s <> '' AND _t <> '' AND _s <> _t").drop("_s", "_t")


def in_shard(index: Column, world: int, rank: int) -> Column:
    return index % world == rank


def in_range(index: Column, start: int, limit: int = 0) -> Column:
    return (index >= start) & (index < start + limit) if limit else index >= start


def error_gate(df: DataFrame, skip: bool = False) -> DataFrame:
    """Records without errors; fails on the first unless told to skip."""
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    if skip:
        return df.where(ok)
    return df.where(F.when(ok, True).otherwise(F.raise_error(F.lit("a translation record has an error")).cast("boolean")))
