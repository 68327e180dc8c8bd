"""Records of evaluation splits in the training split (problem 4)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setjoin
from .common import GOLDEN, durable, word_list

MIN_WORDS = 10
BANDS = setjoin.bands_for(0.999, 0.5)


def cells(df: DataFrame, id_col: str, fields=("kk", "ru"), min_words: int = MIN_WORDS) -> DataFrame:
    """(id, e): the elements of each cell of at least ``min_words``; ids are 2 * row id + field number.

    Words of different fields get different hashes, so only like fields meet.
    """

    def run(batches):
        memory = setjoin.Words()
        for b in batches:
            ids, words = [], []
            row = b.column(0).to_pylist()
            for k in range(len(fields)):
                for i, t in zip(row, b.column(k + 1).to_pylist()):
                    w = word_list(t)
                    if i is not None and len(w) >= min_words:
                        ids.append(2 * i + k)
                        words.append(w)
            ids = np.array(ids, dtype=np.int64)
            h, off = setjoin.word_hashes(words, memory)
            e = setjoin.elements(h ^ np.repeat((ids & 1).astype(np.uint64) * GOLDEN, np.diff(off)), off)
            yield pa.RecordBatch.from_arrays([pa.array(ids), setjoin.lists_of(e, off)], names=["id", "e"])

    return df.select(F.col(id_col).cast("long"), *fields).mapInArrow(run, "id long, e array<long>")


def cross_split_pairs(evals: DataFrame, train: DataFrame, item="item_id", row="pair_id", min_words: int = MIN_WORDS) -> DataFrame:
    """(item, row, field): cells of the same field with a likeness of 0.8 or more.

    Minwise bands of both sides meet, only cross-split candidates arise, and the bags
    themselves decide.  Null, empty and short cells match nothing; every copy of a row is
    reported; empty tables give no rows.
    """
    e, t = (durable(cells(x, c, min_words=min_words)) for x, c in ((evals, item), (train, row)))
    v = setjoin.verified(setjoin.cross_candidates(e, t, BANDS), e, t)
    field = F.when(F.col("a") % 2 == 0, "kk").otherwise("ru")
    return v.select(F.floor(F.col("a") / 2).cast("long").alias(item), F.floor(F.col("b") / 2).cast("long").alias(row), field.alias("field"))


def found(evals: DataFrame, train: DataFrame) -> DataFrame:
    return cross_split_pairs(evals, train).select("item_id", "pair_id").distinct()


def per_split_and_origin(evals: DataFrame, train: DataFrame) -> DataFrame:
    """Overlapping items, rows and pairs per evaluation split and training origin."""
    f = found(evals, train)
    named = f.join(evals.select("item_id", "split"), "item_id").join(train.select("pair_id", "origin"), "pair_id")
    return named.groupBy("split", "origin").agg(
        F.count("*").alias("n_pairs"), F.count_distinct("item_id").alias("n_items"), F.count_distinct("pair_id").alias("n_rows")
    )
