"""Text functions as columns.  A null text is an empty one.

Everything is built from JVM expressions except NFC and casefold, which Spark lacks;
those are Arrow functions that return normal text untouched.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The alphabets and sentence openers of the two languages.
RUSSIAN = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
KAZAKH_MARKERS = "әғқңөұүһі"
SPACE = r"(?U)[\s\x1c-\x1f]+"
OPENERS = "«“\"(A-ZА-Я" + KAZAKH_MARKERS.upper()
SENTENCE_BREAK = rf"(?U)(?<=[.!?…])[\s\x1c-\x1f]+|(?<=[.!?…])(?=[{OPENERS}])|\n+"


def text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip_tags(c) -> Column:
    return F.regexp_replace(text(c), "<[^>]+>", " ")


def collapse(c) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text(c), SPACE, " "))


def strip(c) -> Column:
    """White space removed at the ends only."""
    return F.regexp_replace(text(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


def nfc(c) -> Column:
    return _nfc(text(c))


def casefold(c) -> Column:
    """Exact case folding; ``lower`` equals it for Cyrillic and stays in the JVM."""
    return _casefold(text(c))


def normalize(c) -> Column:
    """Without tags, NFC, white space collapsed."""
    return collapse(nfc(strip_tags(c)))


def normalize_plain(c) -> Column:
    return collapse(nfc(c))


def normalize_audit(c) -> Column:
    """NFC, ends stripped, inner white space kept."""
    return strip(nfc(c))


def word_count(c) -> Column:
    """Words of a text whose white space is collapsed."""
    c = text(c)
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(c, " ")))


def bucket(words: Column, short: int = 8, medium: int = 30) -> Column:
    return F.when(words <= short, "short").when(words <= medium, "medium").otherwise("long")


def sentences(c) -> Column:
    """Normalised sentences in order, empty ones dropped."""
    parts = F.transform(F.split(nfc(c), SENTENCE_BREAK, -1), lambda x: F.trim(F.regexp_replace(x, SPACE, " ")))
    return F.filter(parts, lambda x: x != "")


def letter_count(c) -> Column:
    return F.length(F.regexp_replace(text(c), r"[^\p{L}]", ""))


def script_count(c, alphabet: str) -> Column:
    return F.length(F.regexp_replace(F.lower(text(c)), f"[^{alphabet}]", ""))


def has_url(c) -> Column:
    return text(c).contains("http://") | text(c).contains("https://")


def url_count(c) -> Column:
    return F.regexp_count(text(c), F.lit("https?://"))


def in_script(c, least: int = 20, most: int = 1000, base: str = RUSSIAN, markers: str = KAZAKH_MARKERS) -> Column:
    """Of fit length, without links, at least 3 letters, a marker letter, and mostly
    letters of the two alphabets."""
    n, base_n, mark_n = letter_count(c), script_count(c, base), script_count(c, markers)
    size = F.length(text(c))
    return size.between(least, most) & ~has_url(c) & (n >= 3) & (mark_n > 0) & (base_n + mark_n >= F.greatest(F.lit(3), F.floor(n / 2)))


def pair_md5(a, b) -> Column:
    return F.md5(F.concat_ws("\t", text(a), text(b)))


def pair_sha256(a, b) -> Column:
    return F.sha2(F.concat(text(a), F.lit("\0"), text(b)), 256)


def sentence_key(c) -> Column:
    """Binary key of a normalised sentence without regard to case."""
    return F.unhex(F.sha2(F.lower(text(c)), 256))


def numbered(split: Column, n: Column) -> Column:
    return F.format_string("%s-%05d", split, n.cast("long"))


def duration(seconds: Column) -> Column:
    """h:mm:ss, mm:ss below an hour, --:-- for nothing."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    long = F.format_string("%d:%02d:%02d", h.cast("long"), m.cast("long"), r)
    short = F.format_string("%02d:%02d", m.cast("long"), r)
    return F.when(seconds.isNull() | (seconds <= 0), "--:--").when(h > 0, long).otherwise(short)


def progress(done: Column, total: Column, seconds: Column) -> tuple[Column, Column, Column]:
    """Percent done, rate and seconds left, 0 where they are not defined."""
    percent = F.coalesce(F.try_divide(done * 100.0, total), F.lit(0.0))
    rate = F.coalesce(F.try_divide(done.cast("double"), seconds), F.lit(0.0))
    return percent, rate, F.coalesce(F.try_divide((total - done).cast("double"), rate), F.lit(0.0))


def archive_name(url) -> Column:
    """Fourth last, third last and last segment of a URL's path."""
    p = F.split(F.rtrim(text(url), F.lit("/")), "/")
    return F.concat_ws("-", F.try_element_at(p, F.lit(-4)), F.try_element_at(p, F.lit(-3)), F.try_element_at(p, F.lit(-1)))


def learning_rate(step: Column, peak: float, floor: float, warm_up: int, total: int) -> Column:
    """Linear to the peak, then a cosine down to the floor."""
    at = F.least(F.lit(1.0), (step - warm_up) / F.lit(max(1, total - warm_up)))
    down = F.lit(floor) + F.lit((peak - floor) / 2) * (1 + F.cos(F.pi() * at))
    return F.when(step < warm_up, F.lit(peak) * step / max(1, warm_up)).otherwise(down)


def latex(c) -> Column:
    """Characters that LaTeX reads as commands, escaped."""
    back = chr(0xE000)
    e = F.regexp_replace(F.replace(text(c), F.lit("\\"), F.lit(back)), r"([&%$#_{}])", r"\\$1")
    e = F.replace(e, F.lit(back), F.lit(r"\textbackslash{}"))
    return F.replace(F.replace(e, F.lit("~"), F.lit(r"\textasciitilde{}")), F.lit("^"), F.lit(r"\textasciicircum{}"))


def step_number(c) -> Column:
    """Number of a name ``step-N``; null for other names."""
    return F.expr("try_cast(nullif(regexp_extract({0}, '^step-([0-9]+)$', 1), '') AS BIGINT)".format(c))
