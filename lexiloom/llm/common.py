"""Helpers shared by the training-data operators.

Words are the longest runs of letters and digits, in lower case; a null cell is
an empty text.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"
WORD = re.compile(r"[^\W_]+")
TAG = r"<[^<>]*>"

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BITMAP_BITS = 1 << 25  # 4 MiB
MOST_BITS = 1 << 27  # a broadcast bitmap never has more: 16 MiB whatever the input
_BUCKET = 32768  # bits in one value of bitmap_construct_agg


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def letters_digits(c: str | Column) -> Column:
    """The letters and digits of a text in lower case, everything else removed."""
    return F.regexp_replace(F.lower(text(c)), NOT_WORD, "")


def word_list(t: str | None) -> list[str]:
    """The words of a text in Python."""
    return WORD.findall(t.lower()) if t else []


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where none is set, a folder of our own in a local
    session and an error on a cluster, whose executors share no local folder."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexiloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, lineage cut,
    and not lost with an executor."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def matching_cells(rows: DataFrame, id_col: str, fields, pattern: str) -> DataFrame:
    """(id, field, text) of the cells in which a pattern is found.

    Python's ``re`` scans a clean cell for large character classes far faster than the JVM's.
    """

    def run(batches):
        search = re.compile(pattern).search
        for b in batches:
            ids, names, texts = [], [], []
            for k, f in enumerate(fields):
                for i, t in zip(b.column(0).to_pylist(), b.column(k + 1).to_pylist()):
                    if t and search(t):
                        ids.append(i)
                        names.append(f)
                        texts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["id", "field", "text"])

    return rows.select(F.col(id_col).cast("long"), *fields).mapInArrow(run, "id long, field string, text string")


def bitmap(df: DataFrame, key: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """Bitmap of ``pmod(key, bits)`` over all rows as an array of bytes.

    Built by per-bucket aggregation on the executors; its size is fixed by
    ``bits``.  A set bit means the key may occur, a clear bit that it does not.
    """
    pos = F.pmod(F.col(key), F.lit(bits)) + 1
    rows = (
        df.groupBy(F.bitmap_bucket_number(pos).alias("b"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(pos)).alias("m"))
        .collect()
    )
    out = np.zeros((bits // _BUCKET, _BUCKET // 8), dtype=np.uint8)
    for r in rows:
        out[r.b - 1] = np.frombuffer(bytes(r.m), dtype=np.uint8)
    return out.ravel()


def bitmap_bits(n: int) -> int:
    """Bits for a bitmap of n keys, 32 a key or fewer at the bound; 0 where not even 8 a key
    fit and a bitmap would no longer tell keys apart."""
    return min(1 << max(18, (32 * n - 1).bit_length()), MOST_BITS) if 8 * n <= MOST_BITS else 0


def in_bitmap(m: np.ndarray, keys: np.ndarray) -> np.ndarray:
    p = keys.astype(np.int64) & np.int64(m.size * 8 - 1)
    return (m[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def list_parts(col) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets (from 0) of an Arrow list column without null lists."""
    off = col.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]] if len(off) else np.empty(0, np.int64)
    return flat, off - off[0]
