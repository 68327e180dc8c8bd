"""Evaluation texts in training text (problem 9).

Wu-Manber search over words.  The patterns are all windows of ``LENGTH`` words of the
passages; a block is two neighbouring words.  The shift table says how far the search
may move when a block ends at the current word; blocks of no window move it past the
whole block.  Where the shift is 0, the windows that end with the block form a bucket,
their first blocks select from it, and the words are compared one by one.

Markup tags are not words.  Null and empty texts contain nothing; passages shorter than
``LENGTH`` words match nothing; repeated passages are each reported.  Passages are
broadcast in blocks of ``BLOCK``, so their number has no limit and the broadcast does.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 12
BLOCK_BYTES = 64 << 20  # of passages, on average of the blocks
BLOCK = 20_000
WORD = re.compile(r"[^\W_]+")
TAG = re.compile(r"<[^<>]*>")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    return WORD.findall((TAG.sub(" ", text) if "<" in text else text).lower())


class Matcher:
    def __init__(self, passages: list[tuple[int, str]], length: int = LENGTH):
        self.length = length
        self.shift: dict[tuple[str, str], int] = {}
        self.bucket: dict[tuple[str, str], dict[tuple[str, str], list]] = {}
        windows: dict[tuple[str, ...], set[int]] = {}
        for pid, text in passages:
            ws = words(text)
            for i in range(len(ws) - length + 1):
                windows.setdefault(tuple(ws[i : i + length]), set()).add(pid)
        for w, ids in windows.items():
            for j in range(1, length):
                block = (w[j - 1], w[j])
                far = length - 1 - j
                if self.shift.get(block, length) > far:
                    self.shift[block] = far
            self.bucket.setdefault((w[-2], w[-1]), {}).setdefault((w[0], w[1]), []).append((w, ids))

    def search(self, ws: list[str]) -> set[int]:
        found: set[int] = set()
        m, n, shift, bucket = self.length, len(ws), self.shift, self.bucket
        at = m - 1
        while at < n:
            block = (ws[at - 1], ws[at])
            move = shift.get(block, m - 1)
            if move:
                at += move
                continue
            start = at - m + 1
            for w, ids in bucket[block].get((ws[start], ws[start + 1]), ()):
                if all(ws[start + k] == w[k] for k in range(2, m - 2)):
                    found |= ids
            at += 1
        return found


def leaks(docs: DataFrame, passages: DataFrame, id_col="doc_id", text="text", passage_id="passage_id", passage_text="text", length: int = LENGTH) -> DataFrame:
    """(doc id, passage id): documents and passages that share at least ``length`` words in a row."""
    size = passages.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(passage_text)), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size.n // BLOCK), -(-size.b // BLOCK_BYTES))
    d = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text).alias("_t"))
    p = passages.select(F.col(passage_id).cast("long").alias("p"), F.col(passage_text).alias("t"))
    out = None
    for k in range(blocks):
        some = p.where(F.pmod(F.xxhash64("p"), F.lit(blocks)) == k) if blocks > 1 else p
        held = docs.sparkSession.sparkContext.broadcast([(r.p, r.t) for r in some.collect()])

        def run(batches, held=held):
            m = Matcher(held.value, length)
            for b in batches:
                ids, hits = [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                    for x in m.search(words(t.as_py())):
                        ids.append(i)
                        hits.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hits, pa.int64())], names=[id_col, passage_id])

        part = d.mapInArrow(run, f"`{id_col}` long, `{passage_id}` long")
        out = part if out is None else out.unionByName(part)
    return out


def per_passage(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """Number of documents that each test item leaked into, 0 included."""
    hits = leaks(docs, passages).groupBy("passage_id").agg(F.count_distinct("doc_id").alias("n"))
    return passages.select("passage_id").join(hits, "passage_id", "left").select("passage_id", F.coalesce("n", F.lit(0)).alias("n_docs"))
