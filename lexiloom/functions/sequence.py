"""Token sequences as arrays of integers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNK, BOS, EOS, PAD = 0, 1, 2, 3
VOCABULARY = 32_000


def tokenizer(encode: Callable[[str], list[int]]) -> Callable[[Column], Column]:
    """Any text-to-ids function as an Arrow column function; null gives no ids."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(s: pd.Series) -> pd.Series:
        return s.map(lambda x: encode(x) if x else [])

    return ids


def sentencepiece(path: str) -> Callable[[Column], Column]:
    """Tokenizer of a model file, loaded once per worker."""
    held = {}

    def encode(x: str) -> list[int]:
        if "m" not in held:
            from sentencepiece import SentencePieceProcessor

            held["m"] = SentencePieceProcessor(model_file=path)
        return held["m"].encode(x)

    return tokenizer(encode)


def word_ids(c: Column, size: int = VOCABULARY) -> Column:
    """Stand-in tokenizer in plain SQL: a number from each word's MD5, above the special ids."""
    word = F.filter(F.split(c, " "), lambda w: w != "")
    return F.transform(word, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % (size - 4) + 4).cast("int"))


def decode(ids: Column, special=(UNK, BOS, EOS, PAD)) -> Column:
    """Ids without the special ones."""
    return F.filter(ids, lambda x: ~x.isin(*special))


def with_bos(ids: Column, most: int) -> Column:
    return F.slice(F.concat(F.array(F.lit(BOS)), ids), 1, most)


def with_bos_eos(ids: Column, most: int) -> Column:
    """Cut to ``most`` ids, the last of which is EOS."""
    body = F.concat(F.array(F.lit(BOS)), ids)
    return F.concat(F.slice(body, 1, most - 1), F.array(F.lit(EOS)))


def padded(ids: Column, size: Column) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(PAD), F.greatest(size - F.size(ids), F.lit(0)).cast("int")))


def mask(ids: Column) -> Column:
    return F.transform(ids, lambda x: x != PAD)


def shifted(ids: Column) -> Column:
    """Labels: each id's successor."""
    return F.slice(ids, 2, 2**30)


def upto_eos(ids: Column) -> Column:
    """The sequence up to its first EOS, that included."""
    at = F.array_position(ids, EOS)
    return F.when(at > 0, F.slice(ids, 1, at.cast("int"))).otherwise(ids)


def label_count(ids: Column) -> Column:
    return F.size(F.filter(ids, lambda x: x != PAD))


def length_label(valid: Column) -> Column:
    return F.size(F.filter(valid, lambda x: x)) - 1


def masked_mean(values: Column, valid: Column) -> Column:
    """Mean of the values whose mask is true; the divisor is 1 at least."""
    kept = F.zip_with(values, valid, lambda v, m: F.when(m, v).otherwise(F.lit(0.0)))
    n = F.size(F.filter(valid, lambda x: x))
    return F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.greatest(n, F.lit(1))


def random_mask(key: Column, size: Column, share: float) -> Column:
    """A mask of ``size`` flags, each true with the given chance by hash of key and place;
    a sequence that would get none has its place of lowest hash masked."""
    place = F.sequence(F.lit(1), F.greatest(size, F.lit(1)))
    draw = F.transform(place, lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long"))
    low = F.array_min(draw)
    cut = F.greatest(F.lit(int(share * 2**32)), low + 1)
    return F.when(size > 0, F.transform(draw, lambda x: x < cut)).otherwise(F.array().cast("array<boolean>"))


def check_vocabulary(size: int, expected: int) -> None:
    if size != expected:
        raise ValueError(f"the tokenizer has {size} pieces, {expected} are expected")
