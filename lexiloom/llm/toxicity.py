"""Abusive, hateful or sexual content (problem 10).

Cumulative-link ordinal regression: P(grade > k) = sigmoid(w.x - theta_k) with one
weight vector for all thresholds.  The grades come from the hand labels of a document
(0: all annotators say no, 1: they differ, 2: all say yes), the sparse features from a
sentence: its words, pairs of neighbouring words and character 4-grams, after folding
what hides a word (look-alike letters, masks such as ``#`` and ``@``, letters set apart,
drawn-out letters).  Each different feature of a sentence counts once.

A label speaks of a document, an insult is one sentence of it, and some labels are wrong.
Fitting starts from features that stand significantly more often in documents with a
grade, then alternates over ``FOLDS`` parts of the documents: a model of the other parts
finds the sentences of a part that carry its documents' grades and the clean sentences
that come near (hard negatives), so no document confirms itself.  Documents in which the
others' model finds no carrier, as those with a wrong label, take no part.

Fitting uses at most ``MAX_POSITIVE`` and ``MAX_NEGATIVE`` labelled documents, taken by
hash order of their ids; scoring reads every sentence of every document.  Null, empty
and blank texts score 0; a document labelled twice with both values is grade 1; null
labels are ignored; without any positive label every score is 0.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_POSITIVE, MAX_NEGATIVE = 1500, 1500
BITS = 18
MASK = (1 << BITS) - 1
CHUNK_WORDS, CHUNK_SENTENCES = 100_000, 1 << (32 - BITS)  # taken at once
FOLDS, ROUNDS, STEPS, L2 = 3, 4, 40, 0.2
CARRIES = 0.5  # chance from which the worst sentence of a document with a grade carries it
FALSE_COST = 4  # labels take documents with a grade more often than the corpus has them
SURE = 5.0  # standard errors by which a feature's share must be higher in documents with a grade

TAG = re.compile(r"<[^<>]*>")
END = re.compile(r"(?<=[.!?…])\s+|\n+")
APART = re.compile(r"(?<![^\W_])[^\W\d_](?:[-.*_·][^\W\d_]){2,}(?![^\W_])")
TOKEN = re.compile(r"[^\W\d_]+(?:[#@*_$%&]+[^\W\d_]*)*")
MASKED = 77  # the feature of all words with a mask
MASKS = re.compile(r"[#@*_$%&]+")
LONG = re.compile(r"(.)\1{2,}")
# Letters that look alike, written in the other script.
_LATIN, _CYRILLIC = "aceopxyiukmthbrnɵə", "асеорхуіикмтһвгпөә"
FOLD = str.maketrans(_LATIN, _CYRILLIC)
_CYR = re.compile(r"[Ѐ-ӿ]")


def fold(word: str) -> str:
    """A word of a sentence in one form; masks become ``*``."""
    w = LONG.sub(r"\1", word)
    if not w.isascii():
        w = w.translate(FOLD) if _CYR.search(w) else w
    return MASKS.sub("*", w) if not w.isalpha() else w


def sentences(text: str) -> list[list[str]]:
    t = text
    if "<" in t:
        t = TAG.sub(" ", t)
    t = APART.sub(lambda m: re.sub(r"[-.*_·]", "", m.group()), t.lower())
    out = [TOKEN.findall(s) for s in END.split(t)]
    return [s for s in out if s]


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) * 0x9E3779B97F4A7C15 >> 9 & 0x7FFFFFFFFFFFFFFF


class Words:
    """Per-process memory of a word's hash and of its own features; refilled when full."""

    def __init__(self, most: int = 400_000):
        self.most, self.at = most, {}

    def __call__(self, word: str) -> tuple[int, list[int]]:
        got = self.at.get(word)
        if got is None:
            w = fold(word)
            h = _hash(w)
            own = [h & MASK]
            if "*" in w:
                own.append(MASKED)
            p = f"^{w}$"
            own += [zlib.crc32(p[i : i + 4].encode("utf-8", "surrogatepass"), 4) & MASK for i in range(max(1, len(p) - 3))]
            if len(self.at) >= self.most:
                self.at.clear()
            got = self.at[word] = (h, own)
        return got


class Sentences:
    """Collects sentences word by word; gives their (sentence, feature) pairs, each once, in order."""

    def __init__(self, memory: Words):
        self.memory = memory
        self.clear()

    def clear(self):
        self.local, self.hashes, self.flat, self.ends, self.at, self.start = {}, [], [], [0], [], []

    def add(self, sentence: list[str]):
        local, at = self.local, self.at
        self.start.append(len(at))
        for x in sentence:
            k = local.get(x)
            if k is None:
                h, own = self.memory(x)
                k = local[x] = len(self.hashes)
                self.hashes.append(h)
                self.flat += own
                self.ends.append(len(self.flat))
            at.append(k)

    def full(self) -> bool:
        return len(self.at) >= CHUNK_WORDS or len(self.start) == CHUNK_SENTENCES

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        flat, ends, at, start = np.array(self.flat, dtype=np.uint32), np.array(self.ends), np.array(self.at), np.array(self.start)
        of = np.repeat(np.arange(len(start), dtype=np.uint32), np.diff(start, append=len(at))) << np.uint32(BITS)
        h = np.array(self.hashes, dtype=np.uint64)[at]
        last = np.empty_like(h)
        last[1:] = h[:-1]
        last[start] = 0x51ED270B
        two = ((last * np.uint64(0x2545F4914F6CDD1D) ^ h) >> np.uint64(40)).astype(np.uint32) & np.uint32(MASK)
        n = np.diff(ends)[at]
        place = np.arange(n.sum()) + np.repeat(ends[at] - (np.cumsum(n) - n), n)
        keys = np.sort(np.concatenate([np.repeat(of, n) | flat[place], of | two]))
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        return keys >> np.uint32(BITS), keys & np.uint32(MASK)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    def __init__(self, weights: np.ndarray, theta: np.ndarray):
        self.w, self.theta = weights, theta

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) of scores, a column for each threshold."""
        return _sigmoid(z[:, None] - self.theta[None, :])


def fit_ordinal(row: np.ndarray, col: np.ndarray, grade: np.ndarray, weight: np.ndarray, start):
    """Weighted maximum likelihood of the cumulative-link model by Adam steps on all rows;
    start and result: weights, first threshold, logarithm of the distance to the second."""
    w, t0, gap = start
    w, n, size = w.copy(), len(grade), len(w)
    m, v = np.zeros(size + 2), np.zeros(size + 2)
    total = weight.sum()
    for step in range(1, STEPS + 1):
        z = np.bincount(row, w[col], n)
        t1 = t0 + np.exp(gap)
        a, b = _sigmoid(z - t0), _sigmoid(z - t1)
        p = np.where(grade == 0, 1 - a, np.where(grade == 1, a - b, b)) + 1e-9
        da, db = a * (1 - a), b * (1 - b)
        dz = np.where(grade == 0, -da, np.where(grade == 1, da - db, db)) / p * weight / total
        d0 = -np.sum(np.where(grade == 0, -da, np.where(grade == 1, da, 0)) / p * weight) / total
        d1 = -np.sum(np.where(grade == 1, -db, np.where(grade == 2, db, 0)) / p * weight) / total
        g = np.empty_like(m)
        g[:-2] = np.bincount(col, dz[row], size) - L2 / total * w
        g[-2], g[-1] = d0 + d1, d1 * np.exp(gap)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        d = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w += d[:-2]
        t0 += d[-2]
        gap += d[-1]
    return w, t0, gap


def threshold(chance: np.ndarray, bad: np.ndarray) -> float:
    """Log-odds from which documents count, by the chances that models of the other parts
    give them: the most found documents less ``FALSE_COST`` times the false ones, and
    among values as good the one nearest to 0."""
    odds = np.log((chance + 1e-9) / (1 - chance + 1e-9))
    at = np.arange(-3, 1.01, 0.25)
    worth = np.array([(odds[bad] > a).sum() - FALSE_COST * (odds[~bad] > a).sum() for a in at])
    good = at[worth >= worth.max() - 1]
    return float(good[np.argmin(np.abs(good))])


def _sentences_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document of each sentence, and (sentence, feature) pairs."""
    doc, rows, cols, done, some = [], [], [], 0, Sentences(Words())

    def take():
        nonlocal done
        if some.start:
            r, c = some.pairs()
            rows.append(r.astype(np.int64) + done)
            cols.append(c.astype(np.int64))
            done = len(doc)
            some.clear()

    for i, t in enumerate(texts):
        for s in sentences(t or ""):
            some.add(s)
            doc.append(i)
            if some.full():
                take()
    take()
    nothing = [np.zeros(0, np.int64)]
    return np.array(doc, dtype=np.int64), np.concatenate(rows or nothing), np.concatenate(cols or nothing)


def fit(grades: np.ndarray, texts: list[str]) -> Model:
    """Model of labelled documents."""
    doc, row, col = _sentences_of(texts)
    bad_doc, n = grades > 0, len(doc)
    pair = np.sort(doc[row] << BITS | col)
    pair = pair[np.diff(pair, prepend=-1) != 0]
    d, c = pair >> BITS, pair & MASK
    kept = np.flatnonzero(np.bincount(c, minlength=1 << BITS) >= 2)  # features of at least two documents
    if not len(kept) or not bad_doc.any():
        return Model(np.zeros(1 << BITS, np.float32), np.array([10.0, 11.0]))
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(len(kept))
    ok = place[col] >= 0
    row, col = row[ok], place[col[ok]]
    # start: features whose share of documents with a grade is significantly higher
    n1, n0 = bad_doc.sum(), max(1, (~bad_doc).sum())
    k1, k0 = (np.bincount(c[which[d]], minlength=1 << BITS)[kept] for which in (bad_doc, ~bad_doc))
    p = (k1 + k0) / (n1 + n0)
    errors = (k1 / n1 - k0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    lift = np.log((k1 + 0.5) / n1) - np.log((k0 + 0.5) / n0)
    sure = min(SURE, 0.6 * np.sort(errors)[-20:].mean())  # small label sets have less evidence
    score = np.bincount(row, np.where((errors >= sure) & (lift > 1), lift, 0)[col], n)
    bad, fold = bad_doc[doc], (np.arange(len(texts)) % FOLDS)[doc]
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, doc, score)
    carrier, near = bad & (score > 0) & (score >= best[doc]), ~bad & (score > 0)
    tenth = np.random.default_rng(7).random(n) < 0.1  # of the other clean sentences, with their weight

    def model_of(part, start):
        use = part & (carrier | near | ~bad & tenth)
        if not (use & carrier).any():
            return start
        new = np.cumsum(use) - 1
        keep = use[row]
        grade = np.where(carrier, grades[doc], 0)[use]
        weight = np.where(grade > 0, 1.5, np.where(near[use], 1.0, 10.0))
        return fit_ordinal(new[row[keep]], col[keep], grade, weight, start)

    models = [(np.zeros(len(kept)), 2.0, 0.0)] * FOLDS
    for _ in range(ROUNDS):
        models = [model_of(fold != k, m) for k, m in enumerate(models)]
        chance = np.zeros(n)
        for k, (w, t0, _gap) in enumerate(models):
            keep = (fold == k)[row]
            z = np.bincount(row[keep], w[col[keep]], n)
            chance = np.where(fold == k, _sigmoid(z - t0), chance)
        best = np.zeros(len(texts))
        np.maximum.at(best, doc, chance)
        carrier, near = bad & (chance > CARRIES) & (chance >= best[doc]), ~bad & (chance > 1e-3)
    w, t0, gap = model_of(np.ones(n, dtype=bool), models[0])
    shift = threshold(best, bad_doc)
    t0 += shift
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = w
    return Model(weights, np.array([t0, t0 + np.exp(gap)]))


def labelled(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, list[str]]:
    """Grades and texts of a bounded sample of the labelled documents, by hash order of ids."""
    votes = labels.where("toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi"))
    graded = votes.select("doc_id", (F.col("lo") + F.col("hi")).alias("grade"))
    order = F.xxhash64("doc_id")
    some = graded.where("grade > 0").orderBy(order).limit(MAX_POSITIVE).union(graded.where("grade = 0").orderBy(order).limit(MAX_NEGATIVE))
    got = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    return got.grade.to_numpy(np.int64), got.text.tolist()


def scores(documents: DataFrame, model: Model, id_col="doc_id", text="text") -> DataFrame:
    """(id, severity, chance): expected severity (0 to 2) and chance of a grade above 0 of
    the worst sentence; one pass, no shuffle."""
    held = documents.sparkSession.sparkContext.broadcast((model.w, model.theta))

    def run(batches):
        w, theta = held.value
        weight = w.astype(np.float64)
        some = Sentences(Words())
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            z = np.full(len(texts), -np.inf)
            doc = []

            def take():
                row, col = some.pairs()
                np.maximum.at(z, np.array(doc), np.bincount(row, weight[col], len(doc)))  # noqa: B023
                some.clear()
                doc.clear()  # noqa: B023

            for i, t in enumerate(texts):
                for s in sentences(t) if t else ():
                    some.add(s)
                    doc.append(i)
                    if some.full():
                        take()
            if doc:
                take()
            p = _sigmoid(z[:, None] - theta[None, :]) * np.isfinite(z)[:, None]
            yield pa.RecordBatch.from_arrays([ids, pa.array(p.sum(1)), pa.array(p[:, 0])], names=[id_col, "severity", "chance"])

    return documents.select(F.col(id_col).cast("long"), text).mapInArrow(run, f"`{id_col}` long, severity double, chance double")


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(documents, fit(*labelled(documents, labels)))


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(documents, labels).where("chance >= 0.5").select("doc_id").distinct()


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, flagged documents and their share per source."""
    s = scored(documents, labels).where("chance >= 0.5").select("doc_id").distinct().withColumn("bad", F.lit(1))
    j = documents.select("doc_id", "source").join(s, "doc_id", "left")
    g = j.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.coalesce("bad", F.lit(0))).alias("n_flagged"))
    return g.withColumn("rate", F.round(F.col("n_flagged") / F.col("n_docs"), 6))
