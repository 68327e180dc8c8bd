"""Visually identical text with different characters (problem 2).

Texts that may need it are exploded to positioned code points and joined with small
broadcast tables (fixed values of Unicode and the look-alike letters below):

* decomposition: full-width forms to plain ones, other spaces to the plain space,
  invisible characters to nothing;
* combining marks are put in order of their class behind their letter, and letter and
  marks are recomposed;
* look-alikes: in a word with Cyrillic letters whose other letters all look Cyrillic,
  those become Cyrillic, as do words wholly of Greek letters that look Cyrillic.  Words
  wholly in Latin script stay.

Then the string is rebuilt.  One shuffle by cell carries all steps, and only cells with
an unusual character or a word of two scripts take part; the others are in the one
form already.  Null cells stay null, empty ones empty; repeated rows are treated alike;
an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import matching_cells

# Letters that look alike, foreign and Cyrillic in the same order.
LOOKALIKE_FROM = "ABCEHIKMOPTXYaceiopxyhəƏɵƟëËïÏ" "ΑΒΕΗΙΚΜΝΟΡΤΧΥοραευικ"
LOOKALIKE_TO = "АВСЕНІКМОРТХУасеіорхуһәӘөӨёЁїЇ" "АВЕНІКМНОРТХУораеуік"
SPACES = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
INVISIBLE = "".join(map(chr, [0xAD, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF]))
MARKS = f"{chr(0x300)}-{chr(0x36F)}"
WIDE = f"{chr(0xFF01)}-{chr(0xFF5E)}"
_CYR = f"{chr(0x400)}-{chr(0x52F)}"
_OTHER = f"A-Za-z{chr(0xC0)}-{chr(0x2AF)}{chr(0x370)}-{chr(0x3FF)}"
GREEK = f"{chr(0x370)}-{chr(0x3FF)}"
CANDIDATE = f"[{WIDE}{SPACES}{INVISIBLE}{MARKS}{GREEK}]|[{_CYR}][{_OTHER}]|[{_OTHER}][{_CYR}]"


def lookalikes() -> dict[str, str]:
    return dict(zip(LOOKALIKE_FROM, LOOKALIKE_TO, strict=True))


_MIXED = re.compile(f"[{_CYR}][{_OTHER}]|[{_OTHER}][{_CYR}]")
_WORD = re.compile(r"[^\W\d_]+")


def folded(text: str) -> str:
    """A text with a word of two scripts, with the look-alikes of all its words Cyrillic."""
    if not _MIXED.search(text):
        return text
    look = lookalikes()
    cyrillic = re.compile(f"[{_CYR}]")

    def fold(m):
        w = m.group()
        return "".join(look.get(ch, ch) for ch in w) if all(ch in look or cyrillic.match(ch) for ch in w) else w

    return _WORD.sub(fold, text)


def decompositions() -> dict[str, str]:
    out = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    return out | dict.fromkeys(SPACES, " ") | dict.fromkeys(INVISIBLE, "")


def compositions() -> dict[str, str]:
    """Letter with marks in canonical order to the composed letter."""
    out = {}
    for c in range(0xC0, 0x2000):
        d = unicodedata.normalize("NFD", chr(c))
        if len(d) > 1 and unicodedata.normalize("NFC", d) == chr(c):
            out[d] = chr(c)
    return out


def _frame(spark: SparkSession, d: dict, names: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(d.items()), names))


def code_points(cells: DataFrame) -> DataFrame:
    """(id, field, pos, ch) of every character of the cells."""
    return cells.select("id", "field", F.posexplode(F.split("text", "")).alias("pos", "ch"))


def letters(c: str | Column) -> Column:
    return F.col(c).rlike(r"\p{L}") if isinstance(c, str) else c.rlike(r"\p{L}")


def unified(rows: DataFrame, id_col="pair_id", fields=("kk", "ru")) -> DataFrame:
    """(id, field, unified, changed) of the cells that took part."""
    spark = rows.sparkSession
    chars = code_points(matching_cells(rows, id_col, fields, CANDIDATE))
    # decomposition table; every character keeps its position
    plain = _frame(spark, decompositions(), "ch string, plain string")
    klass = _frame(spark, {chr(c): unicodedata.combining(chr(c)) for c in range(0x300, 0x370) if unicodedata.combining(chr(c))}, "ch string, ccc int")
    c = chars.join(plain, "ch", "left").join(klass, "ch", "left")
    c = c.select("id", "field", "pos", F.coalesce("plain", "ch").alias("ch"), F.coalesce("ccc", F.lit(0)).alias("ccc"), (F.col("plain").isNotNull() | F.col("ccc").isNotNull()).alias("hit"))
    # letters with their marks, marks in order of class, recomposed
    w = Window.partitionBy("id", "field").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("cluster", F.sum((F.col("ccc") == 0).cast("int")).over(w))
    c = c.groupBy("id", "field", "cluster").agg(F.array_sort(F.collect_list(F.struct("ccc", "pos", "ch"))).alias("s"), F.max("hit").alias("hit"))
    c = c.withColumn("raw", F.array_join(F.transform("s", lambda x: x.ch), ""))
    whole = _frame(spark, compositions(), "raw string, composed string")
    first = whole.select(F.col("raw").alias("two"), F.col("composed").alias("start"))
    c = c.join(whole, "raw", "left").withColumn("two", F.substring("raw", 1, 2)).join(F.broadcast(first), "two", "left")
    start = F.concat("start", F.expr("substring(raw, 3)"))
    c = c.select("id", "field", "cluster", F.coalesce("composed", start, "raw").alias("ch"), "hit")
    # look-alikes by word: runs of letters
    c = c.withColumn("letter", letters("ch"))
    w = Window.partitionBy("id", "field").orderBy("cluster").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("word", F.sum((~F.col("letter")).cast("int")).over(w))
    looks = _frame(spark, lookalikes(), "ch string, look string")
    c = c.join(looks, "ch", "left")
    by_word = Window.partitionBy("id", "field", "word")
    cyr = F.col("ch").rlike(f"^[{_CYR}]")
    strange = F.col("letter") & ~cyr & F.col("look").isNull()
    latin = F.col("letter") & ~cyr & ~F.col("ch").rlike(f"^[{GREEK}]")
    held_by = F.max(cyr).over(by_word) | ~F.max(latin).over(by_word)
    c = c.withColumn("mixed", held_by & ~F.max(strange).over(by_word))
    swap = F.col("letter") & F.col("look").isNotNull() & F.col("mixed")
    c = c.select("id", "field", "cluster", F.when(swap, F.col("look")).otherwise(F.col("ch")).alias("ch"), (F.col("hit") | swap).alias("hit"))
    # rebuild
    out = c.groupBy("id", "field").agg(F.array_sort(F.collect_list(F.struct("cluster", "ch"))).alias("s"), F.max("hit").alias("changed"))
    return out.select(F.col("id").alias(id_col), "field", F.array_join(F.transform("s", lambda x: x.ch), "").alias("unified"), "changed")


def found(rows: DataFrame, garbled: DataFrame) -> DataFrame:
    u = unified(rows).where("changed").select("pair_id", "field")
    return u.join(garbled.select("pair_id", "field"), ["pair_id", "field"], "left_anti")


def one_form(rows: DataFrame, id_col="pair_id", fields=("kk", "ru")) -> DataFrame:
    """(id, *fields) with every cell in the one form."""
    u = unified(rows, id_col, fields).where("changed").groupBy(id_col).pivot("field", list(fields)).agg(F.first("unified"))
    u = u.select(F.col(id_col), *[F.col(c).alias(f"_u_{c}") for c in fields])
    return rows.join(u, id_col, "left").select(id_col, *[F.coalesce(f"_u_{c}", c).alias(c) for c in fields])
