import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import text as fx


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f("v").alias("r")).first().r


@pytest.mark.parametrize("f, empty", [(fx.collapse, ""), (fx.normalize, ""), (fx.normalize_audit, ""), (fx.word_count, 0), (fx.sentences, [])])
def test_null_is_empty(spark, f, empty):
    assert one(spark, None, f) == empty


def test_sentence_split(spark):
    assert one(spark, "Сәлем!\n  Бұл тест.  ", fx.sentences) == ["Сәлем!", "Бұл тест."]
    assert one(spark, "Бір.Екі. үш…Төрт", fx.sentences) == ["Бір.", "Екі.", "үш…", "Төрт"]


def test_script_filter(spark):
    assert one(spark, "Бұл қазақ тіліндегі қалыпты сөйлем.", lambda c: fx.in_script(c, 20, 100))
    assert not one(spark, "Толығырақ https://example.kz бетінен қараңыз әрі оқыңыз", lambda c: fx.in_script(c, 20, 100))
    assert not one(spark, "abc", lambda c: fx.in_script(c, 20, 100))


@pytest.mark.parametrize("n, bucket", [(1, "short"), (8, "short"), (9, "medium"), (30, "medium"), (31, "long")])
def test_buckets(spark, n, bucket):
    assert one(spark, " ".join(["сөз"] * n), lambda c: fx.bucket(fx.word_count(c))) == bucket


def test_normalize_composes_and_collapses(spark):
    assert one(spark, "<p>й  \x1c a</p>", fx.normalize) == "й a"
    assert one(spark, " a  b ", fx.normalize_audit) == "a  b"


def test_duration(spark):
    d = spark.createDataFrame([(0.0,), (59.9,), (3661.0,), (None,)], "v double").select(fx.duration(F.col("v")).alias("r"))
    assert [r.r for r in d.collect()] == ["--:--", "00:59", "1:01:01", "--:--"]


def test_learning_rate(spark):
    d = spark.range(3).select(fx.learning_rate(F.col("id"), 0.1, 0.01, 2, 30).alias("r"))
    assert [round(r.r, 6) for r in d.collect()] == [0.0, 0.05, 0.1]


def test_archive_latex_step(spark):
    assert one(spark, "https://h/a/v2/moses/x.zip/", fx.archive_name) == "a-v2-x.zip"
    assert one(spark, "a_b\\c{d}~", fx.latex) == "a\\_b\\textbackslash{}c\\{d\\}\\textasciitilde{}"
    d = spark.createDataFrame([("step-12",), ("last",)], "n string").select(fx.step_number("n").alias("r"))
    assert [r.r for r in d.collect()] == [12, None]


def test_casefold_beyond_lower(spark):
    assert one(spark, "Straße", fx.casefold) == "strasse"


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="aБқ.!?…«\" \n\t  ", max_size=40), min_size=1, max_size=30))
def test_sentences_agree_with_a_plain_model(spark, texts):
    cut = re.compile(r"(?<=[.!?…])\s+|(?<=[.!?…])(?=[«“\"(A-ZА-ЯӘҒҚҢӨҰҮҺІ])|\n+")
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in d.select("i", fx.sentences("t").alias("s")).collect()}
    for i, t in enumerate(texts):
        want = [" ".join(x.split()) for x in cut.split(unicodedata.normalize("NFC", t))]
        assert got[i] == [x for x in want if x]
