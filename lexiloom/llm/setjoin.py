"""Likeness join of word bags: keys by prefixes or by weighted MinHash bands, with exact verification.

Likeness of two bags is the number of words they share, counting repeats, divided by the
size of the larger bag; pairs of at least 4/5 are wanted.  The n-grams are single words,
because likeness ignores order; a word's second, third ... place in a bag makes further
elements, so a bag is a set of element hashes of 64 bits (``elements``).

1. ``word_weights``: document frequencies of all elements over all bags.  One of share s of
   the bags weighs ln(1/s)^2; those over a share of 1/RARE are a bounded list (at most
   RARE times the mean bag size) and are broadcast, all others weigh as RARE.
2. ``Prefixes`` (p6), keys that lose no pair: two bags of a likeness of 4/5 share a word among the
   rarest fifth of either.  A word of few bags is a key by itself, a more frequent one makes a
   key with each next word of the prefix, so that frequent words make no large groups.
   ``Sketch`` (p4), keys that find a pair with a given chance: each permutation gives an element e the clock -ln(u(e)) / weight(e), so
   two bags have the same minimum with the probability of their weighted Jaccard
   similarity.  ROWS minima make a band key.  The number of bands follows from a target
   recall at a weighted similarity (``bands_for``).  With equal weights the common words of
   the language make candidates in proportion to E[J^4] = 4e-5 of all pairs; with these
   weights it is 1e-7 (sf0.1).  Pairs whose shared words are all frequent and whose
   others are rare have a low weighted similarity and are mostly missed.
3. One shuffle on band hashes.  Keys travel as packed arrays, one binary value for each part
   of the key space and task, and are grouped by sorting numbers.  A key row carries a
   parity map of its bag, 112 bits or 240 (p6): its Hamming distance bounds the overlap from above and
   drops pairs in the group without losing any.
4. A group of over SPLIT bags is cut into blocks, and pairs of blocks become tasks of their
   own, so no task takes the square of a group.
5. ``verified``: the elements themselves are compared; nothing but exact likeness decides.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, bitmap, bitmap_bits, durable, in_bitmap, list_parts, mix64

ROWS = 4
RARE = 10_000
FEW = 1000  # bags up to which a word is a key by itself; one of an uncounted word has up to 1/RARE of all
PREFIX_KEYS = 20  # keys of a bag by prefixes, for the number of parts only
SPLIT = 4096  # bags of a group that one task pairs
PART_KEYS = 1 << 19  # keys of a part of the key space on average
FLUSH = 1 << 20  # keys that a task holds before it hands them on
PARITY = 112  # bits of the parity map of ROW: 64 in bits, the others in more, below the bag's size
LOW48 = (1 << 48) - 1
ROW = np.dtype([("key", "<u4"), ("id", "<i8"), ("bits", "<u8"), ("more", "<u8")])
WIDE = np.dtype([*ROW.descr, ("w0", "<u8"), ("w1", "<u8")])  # 128 more bits of the parity map


def bands_for(recall: float, similarity: float) -> int:
    """Bands of ROWS minima that find a pair of this weighted similarity with this probability."""
    return math.ceil(math.log(1 - recall) / math.log1p(-(similarity**ROWS)))


class Words(dict):
    """64-bit hashes of words, remembered by process."""

    def __missing__(self, w: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        h = self[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


def word_hashes(lists: list[list[str]], memory: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lists, and offsets."""
    off = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
    return np.fromiter(map(memory.__getitem__, itertools.chain.from_iterable(lists)), dtype=np.uint64, count=off[-1]), off


def elements(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Element hashes of bags of word hashes: each different within its bag."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((h, row))
    hs = h[order]
    new = np.ones(len(hs), dtype=bool)
    new[1:] = (hs[1:] != hs[:-1]) | (row[1:] != row[:-1])  # row is sorted already
    at = np.arange(len(hs))
    repeat = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return mix64(hs + repeat * GOLDEN)


def lists_of(e: np.ndarray, off: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(e.view(np.int64)))


def hashes_of(column) -> tuple[np.ndarray, np.ndarray]:
    h, off = list_parts(column)
    return h.view(np.uint64), off


def bag_hash(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Hash of each whole bag, independent of order; 0 for an empty bag."""
    c = np.concatenate([[np.uint64(0)], np.cumsum(mix64(h ^ GOLDEN), dtype=np.uint64)])
    return c[off[1:]] - c[off[:-1]]


def fresh(ids: np.ndarray, seen: set) -> np.ndarray:
    """Marks ids that a task has not met before."""
    out = np.zeros(len(ids), dtype=bool)
    for i, x in enumerate(ids.tolist()):
        if x not in seen:
            seen.add(x)
            out[i] = True
    return out


def word_counts(*docs: DataFrame) -> DataFrame:
    """(h, n): bags (id, e) of each element of two or more, and of all bags for a null h."""

    def run(batches):
        seen, n, held = set(), 0, []

        def merged():
            w, c = (np.concatenate(x) for x in zip(*held))
            u, inv = np.unique(w, return_inverse=True)
            return u, np.bincount(inv, c, len(u)).astype(np.int64)

        size = 0
        for b in batches:
            new = fresh(b.column("id").to_numpy(zero_copy_only=False), seen)
            h, _ = hashes_of(b.column("e").filter(pa.array(new)))
            n += int(new.sum())
            if len(h):
                u, c = np.unique(h, return_counts=True)
                held.append((u, c))
                size += len(u)
            if size > FLUSH:
                held = [merged()]
                size = len(held[0][0])
                if size > FLUSH // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["h", "n"])
                    held, size = [], 0
        if held:
            u, c = merged()
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["h", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n], pa.int64())], names=["h", "n"])

    one = docs[0].select("id", "e")
    for d in docs[1:]:
        one = one.union(d.select("id", "e"))
    return durable(one.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 2 or h is null"))


def word_weights(*docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and weights of the elements of a share over 1/RARE of the bags (id, e)."""
    return weights_of(word_counts(*docs))


def weights_of(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    n = max([r.n for r in counts.where("h is null").collect()], default=0)
    got = counts.where(F.col("h").isNotNull() & (F.col("n") * RARE > n)).toPandas()
    h = got.h.to_numpy(np.int64).view(np.uint64)
    w = np.log(n / np.minimum(got.n.to_numpy(np.float64), 0.9 * n)) ** 2 if n else np.zeros(0)
    order = np.argsort(h)
    return h[order], w[order].astype(np.float32)


class Weights:
    """Weights of elements; those of a share of up to 1/RARE all have the highest."""

    def __init__(self, weights):
        self.frequent, self.weight = weights

    def weight_of(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), np.log(RARE) ** 2, dtype=np.float32)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, h), len(self.frequent) - 1)
            hit = self.frequent[at] == h
            out[hit] = self.weight[at[hit]]
        return out


def parity_maps(h: np.ndarray, off: np.ndarray, row: np.dtype = ROW) -> dict[str, np.ndarray]:
    """Parity maps of non-empty bags by the columns of a key row."""
    starts, n = off[:-1], np.diff(off)
    wide = row.names[4:]
    place = h % np.uint64(PARITY + 64 * len(wide))
    bit = np.where(place < PARITY, place, place - np.uint64(PARITY)) & np.uint64(63)
    one = np.uint64(1) << bit
    ends = [64, PARITY, *(PARITY + 64 * (k + 1) for k in range(len(wide)))]
    out = {c: np.bitwise_xor.reduceat(np.where((place >= i) & (place < j), one, np.uint64(0)), starts) for c, i, j in zip(("bits", "more", *wide), [0, *ends], ends)}
    out["more"] |= np.minimum(n, 0xFFFF).astype(np.uint64) << np.uint64(48)
    return out


class Prefixes(Weights):
    """Keys by which every two bags of a likeness of at least 4/5 meet, for n bags in all.

    Elements are ordered by weight, rarest first, then by hash.  The first element that two such
    bags share is followed by at least 4/5 of either bag less one, so it is among the first
    size // 5 + 1 of both, and the second one among the first size // 5 + 2.
    """

    row = WIDE

    def __init__(self, weights, n: int, shared: np.ndarray | None = None):
        super().__init__(weights)
        self.shared = shared  # bitmap of the elements of two or more bags
        self.least = np.float32(min(np.log(max(n / FEW, 1)) ** 2, np.log(RARE) ** 2))

    def __call__(self, h: np.ndarray, off: np.ndarray):
        """([(places of bags, keys)], parity maps) of non-empty bags."""
        n = np.diff(off)
        row = np.repeat(np.arange(len(n)), n)
        u, inv = np.unique(h, return_inverse=True)
        w = self.weight_of(u)[inv]
        order = np.lexsort((h, -w, row))
        hs, few = h[order], w[order] >= self.least
        pos = np.arange(len(h)) - np.repeat(off[:-1], n)
        last = (n // 5)[row]
        first = pos <= last
        at = np.flatnonzero(first & few)
        if self.shared is not None:
            at = at[in_bitmap(self.shared, hs[at])]
        keys = [(row[at], mix64(hs[at]))]
        at, step = np.flatnonzero(first & ~few), 1
        while True:
            at = at[pos[at] + step <= np.minimum(last + 1, n[row] - 1)[at]]
            if not len(at):
                break
            keys.append((row[at], mix64(mix64(hs[at]) ^ hs[at + step])))
            step += 1
        return keys, parity_maps(h, off, self.row)


class Sketch(Weights):
    """Band keys and parity maps of bags."""

    row = ROW

    def __init__(self, weights, bands: int):
        super().__init__(weights)
        self.bands = bands
        rng = np.random.default_rng(20240611)
        self.seeds = rng.integers(1, 2**63, bands * ROWS, dtype=np.uint64)
        self.factors = rng.integers(1, 2**63, bands * ROWS, dtype=np.uint64) | np.uint64(1)

    def __call__(self, h: np.ndarray, off: np.ndarray):
        """([(places of bags, keys)] of each band, parity maps) of non-empty bags."""
        starts, n = off[:-1], np.diff(off)
        u, inv = np.unique(h, return_inverse=True)
        rate = -1 / self.weight_of(u)
        keys = []
        for k in range(self.bands):
            z = np.full(len(n), np.uint64(k + 1)) * GOLDEN
            for i in range(k * ROWS, (k + 1) * ROWS):
                x = (u ^ self.seeds[i]) * self.factors[i]
                x ^= x >> np.uint64(29)
                x *= GOLDEN
                clock = np.log(((x >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-24)) * rate
                z = mix64(z ^ np.minimum.reduceat(clock[inv], starts).view(np.uint32).astype(np.uint64))
            keys.append((np.arange(len(n)), z))
        return keys, parity_maps(h, off)


def sketched(batches, sketch: Prefixes | Sketch):
    """(ids, [(places, keys)], parity maps) of batches of (id, e), each id of a task once."""
    seen = set()
    for b in batches:
        ids = b.column("id").to_numpy(zero_copy_only=False)
        new = fresh(ids, seen)
        if new.any():
            yield ids[new], *sketch(*hashes_of(b.column("e").filter(pa.array(new))))


def packed_keys(docs: DataFrame, weights, bands: int | None, parts: int, side: int, only: np.ndarray | None = None, n_bags: int = 0) -> DataFrame:
    """(part, side, rows): key rows of the bags (id, e) for each part of the key space.

    bands: None for keys by prefixes over n_bags bags.  only: a bitmap of keys, by prefixes of
    elements; others are left out before the shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast((weights, only))

    def run(batches):
        weights, only = held.value
        waiting, n = [], 0

        def out():
            part, rows = (np.concatenate(x) for x in zip(*waiting))
            order = np.argsort(part, kind="stable")
            part, rows = part[order], rows[order]
            at = np.flatnonzero(np.diff(part, prepend=-1))
            ends = [*at[1:].tolist(), len(part)]
            return pa.RecordBatch.from_arrays(
                [pa.array(part[at]), pa.array([side] * len(at), pa.int32()), pa.array([rows[i:j].tobytes() for i, j in zip(at.tolist(), ends)], pa.binary())], names=["part", "side", "rows"]
            )

        sketch = Prefixes(weights, n_bags, only) if bands is None else Sketch(weights, bands)
        for ids, keys, maps in sketched(batches, sketch):
            for at, k in keys:
                if only is not None and bands is not None:
                    ok = in_bitmap(only, k)
                    at, k = at[ok], k[ok]
                rows = np.empty(len(k), dtype=sketch.row)
                rows["key"], rows["id"] = k & np.uint64(0xFFFFFFFF), ids[at]
                for c, m in maps.items():
                    rows[c] = m[at]
                waiting.append((((k >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), rows))
                n += len(k)
            if n > FLUSH:
                yield out()
                waiting, n = [], 0
        if n:
            yield out()

    return docs.select("id", "e").mapInArrow(run, "part long, side int, rows binary")


def may_match(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact necessary condition on two key rows; sizes from 65535 on count as that."""
    nx, ny = ((t["more"] >> np.uint64(48)).astype(np.int64) for t in (x, y))
    far = np.bitwise_count(x["bits"] ^ y["bits"]).astype(np.int64) + np.bitwise_count((x["more"] ^ y["more"]) & np.uint64(LOW48))
    for c in x.dtype.names:
        if c in WIDE.names[4:]:
            far += np.bitwise_count(x[c] ^ y[c])
    most, large = np.maximum(nx, ny), np.maximum(nx, ny) >= 0xFFFF
    return large | (5 * np.minimum(nx, ny) >= 4 * most) & (5 * (nx + ny - far) >= 8 * most)


def self_pairs(group: np.ndarray, rows: np.ndarray):
    """Pairs of rows of the same group (numbers in order) that may match, as two arrays of ids."""
    size = (rows["more"] >> np.uint64(48)).astype(np.int64)
    order = np.lexsort((size, group))
    rows, size = rows[order], size[order]
    place = group[order] << 16 | size
    end = np.searchsorted(place, place - size + np.minimum(size * 5 // 4, 0xFFFF), side="right")  # larger ones cannot match
    at, step, a, b = np.arange(len(rows)), 1, [], []
    while True:
        at = at[at + step < end[at]]
        if not len(at):
            break
        ok = may_match(rows[at], rows[at + step])
        a.append(rows["id"][at[ok]])
        b.append(rows["id"][at[ok] + step])
        step += 1
    nothing = [np.zeros(0, np.int64)]
    return np.concatenate(a or nothing), np.concatenate(b or nothing)


def cross_pairs(x: np.ndarray, y: np.ndarray):
    """Ids of the pairs of two sets that may match."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r in np.split(x, range(64, len(x), 64)):
        i, j = (v.ravel() for v in np.indices((len(r), len(y))))
        ok = may_match(r[i], y[j])
        a.append(r["id"][i[ok]])
        b.append(y["id"][j[ok]])
    return np.concatenate(a), np.concatenate(b)


OUT = "a long, b long, block_pair long, block_no int, rows binary"


def _answer(pairs, blocks):
    """Rows of OUT: candidate pairs, each once, and blocks of large groups."""
    a, b = pairs
    if len(a):
        ab = np.unique(np.stack([a, b], 1), axis=0)
        a, b = ab[:, 0], ab[:, 1]
    n, m = len(a), len(blocks)
    cols = list(zip(*blocks)) or [(), (), ()]
    gap = [None] * m
    return pa.table(
        {
            "a": pa.array([*a.tolist(), *gap], pa.int64()),
            "b": pa.array([*b.tolist(), *gap], pa.int64()),
            "block_pair": pa.array([None] * n + list(cols[0]), pa.int64()),
            "block_no": pa.array([None] * n + list(cols[1]), pa.int32()),
            "rows": pa.array([None] * n + list(cols[2]), pa.binary()),
        }
    )


def _blocks(key: int, members: list[np.ndarray], cross: bool):
    """Blocks of a large group, each once for every other block that it meets.  Of two sides only
    blocks of different ones meet."""
    cut = [[m[i : i + SPLIT] for i in range(0, len(m), SPLIT)] for m in members]
    sides = [s for s, c in enumerate(cut) for _ in c]
    data = [x.tobytes() for c in cut for x in c]
    for i in range(len(data)):
        for j in range(i, len(data)):
            if cross and sides[i] == sides[j]:
                continue
            name = int(mix64(np.array([key], np.uint64) ^ mix64(np.array([i << 32 | j], np.uint64))).view(np.int64)[0])
            yield name, 0 if i == j else 1, data[i]
            if i != j:
                yield name, 2, data[j]


def paired(packed: DataFrame, cross: bool, row: np.dtype = ROW) -> DataFrame:
    """Candidate pairs (a, b) of ids, each once: a < b, or a of side 0 and b of side 1."""
    member = np.dtype(row.descr[1:])

    def part(table: pa.Table) -> pa.Table:
        sides = table.column("side").to_numpy()
        raw = table.column("rows").to_pylist()
        rows = np.concatenate([np.frombuffer(x, dtype=row) for x in raw])
        side = np.repeat(sides, [len(x) // row.itemsize for x in raw]).astype(np.int8)
        order = np.lexsort((rows["id"], side, rows["key"]))
        rows, side = rows[order], side[order]
        keep = np.ones(len(rows), dtype=bool)  # copies of a class from several tasks count once
        keep[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["id"][1:] != rows["id"][:-1]) | (side[1:] != side[:-1])
        rows, side = rows[keep], side[keep]
        at = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]))
        size = np.diff(at, append=len(rows))
        group = np.repeat(np.arange(len(at)), size)
        blocks = []
        if cross:
            right = np.add.reduceat(side.astype(np.int64), at)
            use = (right > 0) & (right < size)
        else:
            use = size > 1
        large = use & (size > SPLIT)
        for g in np.flatnonzero(large):
            r, s = rows[at[g] : at[g] + size[g]], side[at[g] : at[g] + size[g]]
            members = np.empty(len(r), dtype=member)
            for c in member.names:
                members[c] = r[c]
            blocks += _blocks(int(r["key"][0]) << 32 | int(g), [members[s == 0], members[s == 1]] if cross else [members], cross)
        small = (use & ~large)[group]
        rows, side, group = rows[small], side[small], group[small]
        if not cross:
            a, b = self_pairs(group, rows)
            return _answer((np.minimum(a, b), np.maximum(a, b)), blocks)
        l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        lo, hi = np.searchsorted(group[r], group[l]), np.searchsorted(group[r], group[l], side="right")
        n, a, b = hi - lo, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(int(n.max()) if len(n) else 0):
            x = l[n > k]
            y = r[lo[n > k] + k]
            ok = may_match(rows[x], rows[y])
            a.append(rows["id"][x[ok]])
            b.append(rows["id"][y[ok]])
        return _answer((np.concatenate(a), np.concatenate(b)), blocks)

    def block(table: pa.Table) -> pa.Table:
        r = [np.frombuffer(x, dtype=member) for _, x in sorted(zip(table.column("block_no").to_pylist(), table.column("rows").to_pylist()))]
        a, b = self_pairs(np.zeros(len(r[0]), np.int64), r[0]) if len(r) == 1 else cross_pairs(*r)
        if not cross:
            a, b = np.minimum(a, b), np.maximum(a, b)
        return _answer((a, b), [])

    first = durable(packed.groupBy("part").applyInArrow(part, OUT))
    rest = first.where("block_pair is not null").groupBy("block_pair").applyInArrow(block, OUT)
    return first.where("block_pair is null").select("a", "b").union(rest.select("a", "b")).distinct()


def self_candidates(docs: DataFrame, bands: int | None = None) -> DataFrame:
    """Candidate pairs a < b of the bags (id, e): all of a likeness of 4/5, or with ``bands`` those
    that meet in a MinHash band."""
    n = docs.count()
    parts = max(1, n * (bands or PREFIX_KEYS) // PART_KEYS)
    counts, only = word_counts(docs), None
    if bands is None:
        shared = counts.where("h is not null")
        bits = bitmap_bits(shared.count())
        only = bitmap(shared, "h", bits) if bits else None
    return durable(paired(packed_keys(docs, weights_of(counts), bands, parts, 0, only, n), False, ROW if bands else WIDE))


def key_values(docs: DataFrame, weights, bands: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for _, keys, _ in sketched(batches, Sketch(held.value, bands)):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([k for _, k in keys])).view(np.int64))], names=["key"])

    return docs.select("id", "e").mapInArrow(run, "key long")


def cross_candidates(left: DataFrame, right: DataFrame, bands: int) -> DataFrame:
    """Candidate pairs of a left set, the smaller one, with all of a right set.

    Keys of the right set that no left bag has are dropped before the shuffle by a bitmap
    sized by the left set, where it stays within its bound; it only saves work.
    """
    weights = word_weights(left, right)
    n = left.count()
    bits = bitmap_bits(n * bands)
    only = bitmap(key_values(left, weights, bands), "key", bits) if bits else None
    parts = max(1, 2 * n * bands // PART_KEYS)
    return durable(paired(packed_keys(left, weights, bands, parts, 0).union(packed_keys(right, weights, bands, parts, 1, only)), True))


def some(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose id is among the distinct ids: a bitmap where its bound allows, then a join."""
    bits = bitmap_bits(ids.count())
    if bits:
        held = docs.sparkSession.sparkContext.broadcast(bitmap(ids, "id", bits))

        def run(batches):
            for b in batches:
                yield b.filter(pa.array(in_bitmap(held.value, b.column("id").to_numpy(zero_copy_only=False))))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.join(ids, "id", "left_semi")


def verified(cand: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) whose bags have a likeness of at least 4/5."""

    def bags(docs, *c):
        ids = cand.select(F.explode(F.array(*c)).alias("id"))
        return some(docs.select("id", "e"), ids.distinct()).groupBy("id").agg(F.first("e").alias("e"))

    if left is right:
        l = r = bags(left, "a", "b")
    else:
        l, r = bags(left, "a"), bags(right, "b")
    j = cand.join(l.select(F.col("id").alias("a"), F.col("e").alias("ea")), "a").join(r.select(F.col("id").alias("b"), F.col("e").alias("eb")), "b")
    return j.where(5 * F.size(F.array_intersect("ea", "eb")) >= 4 * F.greatest(F.size("ea"), F.size("eb"))).select("a", "b")
