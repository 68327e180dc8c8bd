"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, encoding, formatting, language, neardup, overlap, passages, responses, toxicity, unify
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.found(table(spark, sf, "pairs"))


def p1_restored(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.restored(table(spark, sf, "pairs"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "pairs")
    return unify.found(pairs, encoding.found(pairs))


def p2_unified(spark: SparkSession, sf: str) -> DataFrame:
    return unify.one_form(table(spark, sf, "pairs"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return responses.defects(table(spark, sf, "translations"))


def p3_rates(spark: SparkSession, sf: str) -> DataFrame:
    return responses.rates(table(spark, sf, "translations"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.found(table(spark, sf, "eval_pairs"), table(spark, sf, "pairs"))


def p4_per_split_and_origin(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.per_split_and_origin(table(spark, sf, "eval_pairs"), table(spark, sf, "pairs"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return formatting.found(table(spark, sf, "pairs"))


def p5_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return formatting.collapsed(table(spark, sf, "pairs"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_pairs(table(spark, sf, "pairs"))


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.groups(table(spark, sf, "pairs"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "pairs")
    return language.found(table(spark, sf, "mono_docs"), pairs, encoding.found(pairs))


def p7_segments(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "mono_docs")
    return language.documents(docs, language.train(docs), all_rows=True)


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(table(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return passages.leaks(table(spark, sf, "documents"), table(spark, sf, "test_passages"))


def p9_per_passage(spark: SparkSession, sf: str) -> DataFrame:
    return passages.per_passage(table(spark, sf, "documents"), table(spark, sf, "test_passages"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.found(table(spark, sf, "documents"), table(spark, sf, "doc_labels"))


def p10_scores(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.scored(table(spark, sf, "documents"), table(spark, sf, "doc_labels")).select("doc_id", "severity")


def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.rates(table(spark, sf, "documents"), table(spark, sf, "doc_labels"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}
