"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 8).

Words of the vocabulary's split pattern are encoded once per worker and remembered in a
bounded memory.  New words are encoded together in numpy by the contiguous rank array:
a matrix holds the parts of each word and one the rank of joining each part with the
next; each step finds every word's lowest rank, deletes the boundary there, and
refreshes the ranks of the two neighbours.  Words over ``LONGEST`` bytes (runs without
a space) keep the same parts and ranks in a heap, so very long texts stay linear in
practice.  The vocabulary file's path is a parameter; its ranks are fixed in size and
broadcast.  Null and empty texts give the empty list.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LONGEST = 64
MEMORY = 200_000
SLICE = 1000  # texts worked on at a time
NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, memory: int = MEMORY):
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.bits = max(4, int(np.ceil(np.log2(len(pairs) * 3 + 1))))
        self.key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.val = np.full(1 << self.bits, NONE, dtype=np.int32)
        k, v = np.array(list(pairs), dtype=np.int64), np.array(list(pairs.values()), dtype=np.int32)
        at = self._slot(k)
        while len(k):  # open addressing, all keys at a time
            free = self.key[at] == -1
            first = np.zeros(len(k), dtype=bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.key[at[put]], self.val[at[put]] = k[put], v[put]
            k, v, at = k[~put], v[~put], at[~put] + 1 & (1 << self.bits) - 1
        self.find = regex.compile(pattern).findall
        self.memory, self.known = memory, {}

    def _slot(self, k: np.ndarray) -> np.ndarray:
        h = k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that joins each pair of parts; NONE where there is none."""
        k = a.astype(np.int64) << 32 | b
        at = self._slot(k)
        seen = self.key[at]
        out = np.where(seen == k, self.val[at], NONE)
        left = np.flatnonzero((seen != k) & (seen != -1))
        while len(left):
            at[left] = at[left] + 1 & (1 << self.bits) - 1
            seen = self.key[at[left]]
            hit = seen == k[left]
            out[left[hit]] = self.val[at[left[hit]]]
            left = left[~hit & (seen != -1)]
        return out

    def _short(self, words: list[bytes], width: int) -> list[bytes]:
        """Parts of words of at most ``width`` bytes as little-endian int32 strings."""
        n = len(words)
        size = np.array([len(w) for w in words], dtype=np.int64)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        part = self.byte[raw]
        inside = np.arange(width - 1)[None, :] < (size - 1)[:, None]
        rank = np.full((n, width), NONE, dtype=np.int32)
        rank[:, :-1][inside] = self.rank(part[:, :-1][inside], part[:, 1:][inside])
        live = np.arange(n)
        p, r, s = part, rank, size.copy()
        out: list[bytes] = [b""] * n
        cols = np.arange(width)
        while len(live):
            j = r.argmin(1)
            low = r[np.arange(len(live)), j]
            done = low == NONE
            if done.any():
                for i, row, m in zip(live[done].tolist(), p[done], s[done].tolist()):
                    out[i] = row[:m].tobytes()
                go = ~done
                live, p, r, s, j, low = live[go], p[go], r[go], s[go], j[go], low[go]
                if not len(live):
                    break
            rows = np.arange(len(live))
            p[rows, j] = low
            # delete the boundary after part j: part and rank j + 1 go
            take = np.minimum(cols[None, :] + (cols[None, :] > j[:, None]), width - 1)
            p, r = np.take_along_axis(p, take, 1), np.take_along_axis(r, take, 1)
            s -= 1
            r[rows, s - 1] = NONE
            right = j < s - 1
            r[rows[right], j[right]] = self.rank(p[rows[right], j[right]], p[rows[right], j[right] + 1])
            left = j > 0
            r[rows[left], j[left] - 1] = self.rank(p[rows[left], j[left] - 1], p[rows[left], j[left]])
        return out

    def _long(self, word: bytes) -> bytes:
        part = self.byte[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.rank(np.array(part[:-1], dtype=np.int32), np.array(part[1:], dtype=np.int32))
        heap = [(int(x), i, part[i], part[i + 1]) for i, x in enumerate(first) if x != NONE]
        heapq.heapify(heap)
        gone = bytearray(n)

        def push(i, j):
            x = int(self.rank(np.array([part[i]], dtype=np.int32), np.array([part[j]], dtype=np.int32))[0])
            if x != NONE:
                heapq.heappush(heap, (x, i, part[i], part[j]))

        while heap:
            x, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or part[i] != a or part[j] != b:
                continue
            part[i], gone[j], after[i] = x, 1, after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([x for x, g in zip(part, gone) if not g], dtype=np.int32).tobytes()

    def learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        low = 0
        for width in (8, 16, 24, 32, 48, LONGEST):
            some = [i for i, w in enumerate(raw) if low < len(w) <= width]
            low = width
            for k in range(0, len(some), 50_000):
                part = some[k : k + 50_000]
                for i, ids in zip(part, self._short([raw[i] for i in part], width)):
                    self.known[words[i]] = ids
        for w, b in zip(words, raw):
            if len(b) > LONGEST:
                self.known[w] = self._long(b)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.find(t) if t else [] for t in texts]
        if len(self.known) > self.memory:
            self.known.clear()
        new = set().union(*split) - self.known.keys()
        self.learn(list(new))
        known = self.known
        return [np.frombuffer(b"".join([known[w] for w in ws]), dtype=np.int32) for ws in split]


def encode(docs: DataFrame, ranks_path: str = RANKS, id_col="doc_id", text="text") -> DataFrame:
    """(id, ids): token ids of each whole text without special tokens; one pass, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        e = Encoder(held.value)
        for b in batches:
            for k in range(0, b.num_rows, SLICE):
                part = b.slice(k, SLICE)
                got = e.encode(part.column(1).to_pylist())
                off = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
                flat = np.concatenate(got) if got else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(flat, pa.int32()))], names=[id_col, "ids"])

    return docs.select(F.col(id_col).cast("long"), text).mapInArrow(run, f"`{id_col}` long, ids array<int>")
