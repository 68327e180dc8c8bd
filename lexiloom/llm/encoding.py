"""Text garbled by a wrong character encoding (problem 1).

1. One pass over all cells counts letter bigrams of the corpus (a fixed 45 x 45 table)
   and sets aside suspect cells: those with characters outside the usual alphabets and
   signs, and those with capitals inside words.
2. Suspects are joined with clean near-twins: cells of the same field with the same text
   once stripped of non-ASCII characters.  A transformation (bytes of encoding A read as
   encoding B, once or twice) whose characters turn a word of a suspect into the word that
   a twin has in the same place is supported by that word and by its letters.  The join is
   on skeleton, place and word, so a skeleton of any number of texts makes no large group,
   and all twins take part; what cannot meet is dropped by bitmaps before the shuffle.
3. Transformations that at least VOTES different words with LETTERS different letters
   support are learned.  They are applied to all suspects, word by word: a word is garbled
   if the corpus bigrams find it unlikely as it stands and likely once transformed.

A cell with the replacement character is garbled even if nothing restores it.  Null and
empty cells are not; repeated rows are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, bitmap_bits, durable, in_bitmap, mix64
from .setjoin import Words, some, word_hashes

LOWER = "абвгдеёжзийклмнопрстуфхцчшщъыьэюяәғқңөұүһі"
SIZE = len(LOWER) + 3  # 0: no letter, last but one: Latin letter, last: any other character
SIGNS = "№…«»—–“”„’‘™€°±§" + chr(0xA0) + chr(0xAD)
NOT_USUAL = f"[^{chr(0)}-{chr(127)}{LOWER}{LOWER.upper()}{SIGNS}]"
CAPITALS = f"[{LOWER}{LOWER.upper()}][{LOWER.upper()}]"
LATIN = re.compile("[A-Za-z]")
SPACE = re.compile(r"[ \t\r\n]+")
UNLIKELY = -3.6  # mean log-probability of a bigram; usual words lie above -3
GAIN = 1.0  # by which a transformed word must be likelier, per bigram
LEAST_GAIN = 8.0  # by which all garbled words of a cell must be likelier
VOTES, LETTERS = 3, 8
LOST = 0.2  # share of a word's bytes that its garbling may have lost
KNOWN = 300_000  # words whose options a process remembers


def _table(codec: str) -> dict[str, int]:
    """Character to byte of a one-byte encoding; bytes it leaves open stand for themselves."""
    out = {}
    for b in range(128, 256):
        try:
            out.setdefault(bytes([b]).decode(codec), b)
        except UnicodeDecodeError:
            pass
    used = set(out.values())
    for b in range(128, 256):
        if b not in used:
            out.setdefault(chr(b), b)
    return out


def steps() -> list[tuple[tuple[str, str], ...]]:
    """Candidate transformations: (right encoding, encoding it was read as), once or twice."""
    single = ["cp1252", "cp1251", "kz1048", "koi8_r", "cp866", "latin1", "mac_cyrillic", "ptcp154"]
    out = [(("utf8", d),) for d in single]
    out += [((e, d),) for d in single for e in ("cp1251", "kz1048", "koi8_r", "cp866") if e != d]
    wide = ["cp1251", "cp1252", "latin1", "koi8_r", "cp866"]
    out += [(("utf8", a), ("utf8", b)) for a in wide for b in wide]
    return out


def name(t) -> str:
    return ">".join(f"{e}/{d}" for e, d in t)


class Transform:
    """Undoes one transformation."""

    def __init__(self, chain):
        self.chain = chain
        self.steps = []
        for e, d in reversed(chain):
            t = _table(d)
            if e != "utf8":
                t.setdefault("\ufffd", 0x9D)  # the byte that cp1252 leaves open inside Kazakh text
            known = frozenset(t) | frozenset(map(chr, range(128)))
            self.steps.append((known, {ord(c): chr(b) for c, b in t.items()}, e))

    def __call__(self, s: str) -> str | None:
        for known, table, e in self.steps:
            if not known.issuperset(s):
                return None
            raw = s.translate(table).encode("latin-1")
            try:
                s = raw.decode(e)
            except UnicodeDecodeError:
                if e != "utf8":
                    return None
                s = raw.decode(e, "ignore")
                if len(s.encode()) < (1 - LOST) * len(raw):
                    return None
        return s


def _symbols() -> dict[str, int]:
    out = dict.fromkeys(map(chr, range(128)), 0) | dict.fromkeys(SIGNS, 0)
    for i, ch in enumerate(LOWER):
        out[ch] = out[ch.upper()] = i + 1
    for ch in "abcdefghijklmnopqrstuvwxyz":
        out[ch] = out[ch.upper()] = SIZE - 2
    return out


SYMBOL = _symbols()
SYMBOL_CHARS = frozenset(LOWER)
NEIGHBOUR = frozenset("єїґ")  # letters of a neighbouring language: alone no sign of garbling


def symbol_array() -> np.ndarray:
    t = np.full(0x10000, SIZE - 1, dtype=np.int32)
    for k, v in SYMBOL.items():
        t[ord(k)] = v
    return t


def count_bigrams(texts: list[str], table: np.ndarray) -> np.ndarray:
    c = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(c) < 2:
        return np.zeros(SIZE * SIZE, dtype=np.int64)
    s = table[np.minimum(c, 0xFFFF)]
    return np.bincount(s[:-1] * SIZE + s[1:], minlength=SIZE * SIZE)


class Likely:
    """Mean log-probability of a word's bigrams in the corpus."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SIZE, SIZE).astype(float) + 0.5
        p = np.log(c / c.sum(1, keepdims=True))
        p[:, SIZE - 1] = p[SIZE - 1, :] = -9.0
        p[SIZE - 2, 1 : SIZE - 2] = p[1 : SIZE - 2, SIZE - 2] = -9.0  # two scripts in one word
        self.p = p.tolist()

    def __call__(self, w: str) -> float:
        p, last, total, known = self.p, 0, 0.0, SYMBOL
        for ch in w:
            now = known.get(ch, SIZE - 1)
            if last or now:
                total += p[last][now]
            last = now
        if last:
            total += p[last][0]
        return total / (len(w) + 1)


class Judge:
    """Finds the garbled words of a cell and their best transformation."""

    def __init__(self, counts: np.ndarray, chains):
        self.likely = Likely(counts)
        self.chains = [(name(c), Transform(c)) for c in chains]
        self.by_name = dict(self.chains)
        self.known: dict[str, list] = {}

    def options(self, w: str) -> list[tuple[str, str, float]]:
        """(transformation, restored word, gain) of an unlikely word."""
        got = self.known.get(w)
        if got is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            got = self.known[w] = self.judged(w)
        return got

    def judged(self, w: str) -> list[tuple[str, str, float]]:
        before = self.likely(w)
        if before > UNLIKELY or w.isascii() or not w.strip(chr(0xFFFD)):
            return []
        # letters of the usual alphabet alone: only words whose capitals are misplaced can be garbled
        if all(ch in SYMBOL_CHARS or ch.lower() in SYMBOL_CHARS or ch.isascii() for ch in w):
            if len(w) < 3 or sum(ch.isupper() for ch in w[1:]) < 2:
                return []
        weak = NEIGHBOUR.issuperset(ch for ch in w.lower() if ch not in SYMBOL_CHARS and not ch.isascii())
        weak = weak and any(ch in NEIGHBOUR for ch in w.lower())
        latin = LATIN.search(w) is not None
        out = []
        for n, t in self.chains:
            if latin and not n.startswith("utf8"):
                continue
            x = t(w)
            if x is None or x == w:
                continue
            if len(x) == len(w) and any(a.isalpha() and not b.isalpha() for a, b in zip(w, x)):
                continue
            after = self.likely(x)
            if after > before + GAIN and after > UNLIKELY - 1.5:
                out.append((n, x, 0.0 if weak and not n.startswith("utf8") else (after - before) * (len(w) + 1)))
        return out

    def cell(self, s: str) -> tuple[bool, str | None, str | None]:
        """(garbled, transformation, restored text where every garbled word could be restored)."""
        ws = SPACE.split(s)
        opts = {w: self.options(w) for w in set(ws)}
        total: dict[str, float] = {}
        for w in ws:
            for n, _, gain in opts[w]:
                total[n] = total.get(n, 0.0) + gain
        lost = "�" in s
        if not total:
            return lost, None, None
        best = max(total, key=lambda n: (total[n], -len(n)))
        if total[best] < LEAST_GAIN:
            return lost, None, None
        undo = self.by_name[best]
        fixed = {}
        for w in opts:
            fixed[w] = next((x for n, x, _ in opts[w] if n == best), None)
            if fixed[w] is None and not w.isascii() and w.strip(chr(0xFFFD)):
                x = undo(w)
                if x and self.likely(x) > self.likely(w):
                    fixed[w] = x
        out = re.sub(r"[^ \t\r\n]+", lambda m: fixed.get(m.group()) or m.group(), s)
        return True, best, out if "�" not in out else None


def suspects(pairs: DataFrame, fields=("kk", "ru"), id_col="pair_id") -> DataFrame:
    """(id, field, text) of suspect cells, and rows with the bigram counts of all cells."""

    def run(batches):
        table = symbol_array()
        search = re.compile(f"{NOT_USUAL}|{CAPITALS}").search
        counts = np.zeros(SIZE * SIZE, dtype=np.int64)
        for b in batches:
            ids = b.column(0).to_pylist()
            for i, c in enumerate(fields):
                texts = b.column(1 + i).to_pylist()
                counts += count_bigrams([x for x in texts if x], table)
                hit = [(k, x) for k, x in zip(ids, texts) if x and search(x)]
                n = len(hit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in hit], pa.int64()), pa.array([c] * n, pa.string()), pa.array([x for _, x in hit], pa.string()), pa.nulls(n, pa.list_(pa.int64()))],
                    names=["pair_id", "field", "text", "counts"],
                )
        yield pa.RecordBatch.from_arrays(
            [pa.array([None], pa.int64()), pa.array([None], pa.string()), pa.array([None], pa.string()), pa.array([counts.tolist()], pa.list_(pa.int64()))],
            names=["pair_id", "field", "text", "counts"],
        )

    return pairs.select(F.col(id_col).cast("long"), *fields).mapInArrow(run, "pair_id long, field string, text string, counts array<long>")


def skeleton(s: str) -> int:
    """Hash of a text stripped of non-ASCII characters, white space as one space."""
    b = b" ".join(s.encode("ascii", "ignore").split())
    return zlib.crc32(b) << 31 ^ zlib.adler32(b) ^ len(b) << 17


def letters(w: str) -> int:
    """Bit set of the letters of a word."""
    out = 0
    for ch in w:
        k = SYMBOL.get(ch, SIZE - 1)
        if 0 < k < SIZE - 2:
            out |= 1 << k - 1
    return out


def placed(skeletons: np.ndarray, places: np.ndarray, words: np.ndarray, field: int) -> np.ndarray:
    """Keys of words in their places of texts with a skeleton."""
    z = mix64(skeletons.view(np.uint64) ^ mix64(np.full(1, field + 1, np.uint64)))
    return mix64(mix64(z + places.astype(np.uint64)) ^ words).view(np.int64)


def learn(pairs: DataFrame, marked: DataFrame, counts: np.ndarray, fields=("kk", "ru")) -> list:
    """Transformations that alignment with near-twins supports."""
    spark = pairs.sparkSession
    chains = steps()
    number = {name(c): i for i, c in enumerate(chains)}
    held = spark.sparkContext.broadcast(counts)

    def options(batches):
        judge, memory, seen = Judge(held.value, chains), Words(), set()
        for b in batches:
            rows = []
            for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                k = skeleton(t)
                for i, w in enumerate(SPACE.split(t)):
                    for n, x, _ in judge.options(w):
                        if len(x) >= 4:
                            x = x.lower()
                            rows.append((k, i, memory[x], fields.index(f), number[n], letters(x)))
            cols = list(zip(*rows)) or [()] * 6
            key = np.zeros(len(rows), np.int64)
            of = np.array(cols[3])
            for f in range(len(fields)):
                m = of == f
                if m.any():
                    key[m] = placed(*(np.array(c, t)[m] for c, t in zip(cols[:3], (np.int64, np.int64, np.uint64))), f)
            new = [i for i, x in enumerate(zip(key.tolist(), cols[4])) if x not in seen and not seen.add(x)]
            word = np.array(cols[2], np.uint64).view(np.int64)
            out = [key, word, np.array(cols[4], np.int32), np.array(cols[5], np.int64), np.array(cols[0], np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c[new]) for c in out], names=["key", "word", "chain", "letters", "k"])

    opts = durable(marked.select("field", "text").mapInArrow(options, "key long, word long, chain int, letters long, k long"))
    sk = opts.select("k").distinct()
    bits, key_bits = bitmap_bits(sk.count()), bitmap_bits(opts.count())
    maps = spark.sparkContext.broadcast((bitmap(sk, "k", bits) if bits else None, bitmap(opts, "key", key_bits) if key_bits else None))

    def clean(batches):
        """Keys of the words of clean cells, each once a batch."""
        by_skeleton, by_key = maps.value
        search, memory = re.compile(f"{NOT_USUAL}|{CAPITALS}").search, Words()
        for b in batches:
            out = []
            for f in range(len(fields)):
                texts = [x for x in b.column(f).to_pylist() if x]
                k = np.array([skeleton(x) for x in texts], dtype=np.int64)
                ok = in_bitmap(by_skeleton, k) if by_skeleton is not None else np.ones(len(k), dtype=bool)
                use = [(SPACE.split(x), y) for x, y, z in zip(texts, k.tolist(), ok.tolist()) if z and not search(x)]
                n = [len(ws) for ws, _ in use]
                if n:
                    place = np.arange(sum(n)) - np.repeat(np.cumsum(n) - n, n)
                    h, _ = word_hashes([[w.lower() for w in ws] for ws, _ in use], memory)
                    out.append(placed(np.repeat(np.array([y for _, y in use], np.int64), n), place, h, f))
            key = np.unique(np.concatenate(out or [np.zeros(0, np.int64)]))
            if by_key is not None:
                key = key[in_bitmap(by_key, key)]
            yield pa.RecordBatch.from_arrays([pa.array(key)], names=["key"])

    twins = pairs.select(*fields).mapInArrow(clean, "key long").distinct()
    votes = opts.join(twins, "key").groupBy("chain", "word").agg(F.max("letters").alias("letters"))
    rows = votes.groupBy("chain").agg(F.count("*").alias("n"), F.bit_or("letters").alias("letters")).collect()
    good = {r.chain for r in rows if r.n >= VOTES and r.letters.bit_count() >= LETTERS}
    return [c for i, c in enumerate(chains) if i in good]


def restored(pairs: DataFrame, fields=("kk", "ru"), id_col="pair_id", of: DataFrame | None = None) -> DataFrame:
    """(pair_id, field, transformation, restored) of each garbled cell; ``restored`` is the
    right text, or null where it cannot be had.  ``of``: only the cells of the rows whose id
    is in this table's only column are judged; the transformations come from all rows."""
    both = durable(suspects(pairs, fields, id_col))
    parts = both.where("counts is not null").select(F.posexplode("counts").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("c")).collect()
    counts = np.zeros(SIZE * SIZE, dtype=np.int64)
    for r in parts:
        counts[r.i] = r.c
    marked = both.where("text is not null").select("pair_id", "field", "text")
    held = pairs.sparkSession.sparkContext.broadcast((counts, learn(pairs, marked, counts, fields)))
    if of is not None:
        ids = durable(of.toDF("id").distinct())
        marked = some(marked.withColumnRenamed("pair_id", "id"), ids)

    def run(batches):
        counts, chains = held.value
        judge = Judge(counts, chains)
        for b in batches:
            out = [(i, f, *judge.cell(t)) for i, f, t in zip(*(b.column(k).to_pylist() for k in range(3)))]
            out = [(i, f, n, x) for i, f, bad, n, x in out if bad]
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64())] + [pa.array(c, pa.string()) for c in cols[1:]], names=["pair_id", "field", "transformation", "restored"])

    return marked.mapInArrow(run, "pair_id long, field string, transformation string, restored string")


def found(pairs: DataFrame, of: DataFrame | None = None) -> DataFrame:
    return restored(pairs, of=of).select("pair_id", "field")
