"""Missing or wrong language labels (problem 7).

Multinomial naive Bayes over hashed character bigrams and trigrams of lower-case
letters.  The matrix of log-probabilities (``1 << BITS`` rows, one column per language,
float32: under 4 MB) is broadcast; batches are scored in numpy by gathering its rows at
the n-grams of all segments at once and summing per segment.

The model is fitted on a bounded sample of labelled documents (``PER_LANGUAGE`` of each
language by hash order of ids); documents whose lines do not agree with their label are
then left out and the model is fitted again.  Everything is scored whole.

A segment's confidence is the posterior of its language under the prior of where it
stands: the column's language for a cell of pairs, the rest of its document for a line.
Texts without letters have no language; null texts are empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .unify import folded

LANGS = ["kaz", "rus", "kir", "eng", "tur", "ukr", "uzb"]
MIXED = "mul"
# Spellings of the language codes before any script suffix.
NAMES = {
    "kaz": "kaz", "kk": "kaz", "rus": "rus", "ru": "rus", "kir": "kir", "ky": "kir", "eng": "eng", "en": "eng",
    "tur": "tur", "tr": "tur", "ukr": "ukr", "uk": "ukr", "uzb": "uzb", "uz": "uzb", "uzn": "uzb", "mul": "mul",
}
BITS = 17
PER_LANGUAGE = 400
SMOOTH = 0.05
CELL_PRIOR = 0.98  # share of cells in their column's language
LINE_MARGIN = 6.0  # nats by which a line must prefer another language than its document's
_P = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
_SPACE = np.uint32(32)


def _letters() -> np.ndarray:
    t = np.arange(0x3000, dtype=np.uint32)
    for c in range(0x3000):
        if not chr(c).isalpha():
            t[c] = 32
    return t


_TABLE = None


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, where each text's begin, and its number of letters."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _letters()
    parts = [t.lower() for t in texts]
    joined = "  " + "  ".join(parts) + "  "
    size = np.array([len(p) for p in parts], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(size + 2)])[:-1] + 2
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.where(c < 0x3000, _TABLE[np.minimum(c, 0x2FFF)], _SPACE)
    is_letter = c != _SPACE
    letters = np.add.reduceat(is_letter.astype(np.int64), start)
    a, b, d = c[:-2], c[1:-1], c[2:]
    two = a * _P[0] ^ b * _P[1]
    tri = two ^ d * _P[2]
    ok = is_letter[1:-1]  # n-grams around a letter
    where = np.flatnonzero(ok)
    both = np.empty(2 * len(where), dtype=np.int64)
    for k, x in enumerate((two + np.uint32(77), tri)):
        y = x[where]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        both[k::2] = y >> np.uint32(32 - BITS)
    first = 2 * np.searchsorted(where + 1, start)
    return both, first, letters


def score(matrix: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each text in each language, and its number of letters."""
    out, letters = np.zeros((len(texts), matrix.shape[1])), np.zeros(len(texts), dtype=np.int64)
    i = 0
    while i < len(texts):  # in pieces of about a million characters
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) < 1_000_000):
            n += len(texts[j])
            j += 1
        g, first, letters[i:j] = grams(texts[i:j])
        if len(g):
            run = np.concatenate([np.zeros((1, matrix.shape[1])), np.add.reduceat(matrix[g], np.unique(np.minimum(first, len(g) - 1)), axis=0, dtype=np.float64)])
            ends = np.concatenate([first[1:], [len(g)]])
            which = np.cumsum(ends > first)
            out[i:j] = np.where((ends > first)[:, None], run[which], 0)
        i = j
    return out, letters


def fit(texts: list[str], lang: np.ndarray) -> np.ndarray:
    g, first, _ = grams(texts)
    ends = np.concatenate([first[1:], [len(g)]])
    of = np.repeat(lang, ends - first)
    counts = np.zeros((1 << BITS, len(LANGS)))
    np.add.at(counts, (g, of), 1)
    counts += SMOOTH
    return np.log(counts / counts.sum(0)).astype(np.float32)


def labels(c: str = "predicted_language"):
    """The language a label names, or null."""
    code = F.element_at(F.split(F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))), "[_-]"), 1)
    return F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])[code]


def train(docs: DataFrame, id_col="mono_id", text="text", label="predicted_language") -> np.ndarray:
    """Matrix of log-probabilities from a bounded sample of labelled documents."""
    from pyspark.sql import Window

    d = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t"), labels(label).alias("l")).where(F.col("l").isin(LANGS) & (F.length(text) > 0))
    ids = d.select("l", "i").withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("i"), "i"))).where(F.col("k") <= PER_LANGUAGE)
    got = d.join(F.broadcast(ids.select("l", "i")), ["l", "i"]).orderBy("i", "t").toPandas()
    texts, lang = got.t.tolist(), np.array([LANGS.index(x) for x in got.l], dtype=np.int64)
    if not texts:
        return np.zeros((1 << BITS, len(LANGS)), np.float32)
    for _ in range(2):
        m = fit(texts, lang)
        lines = [t.split("\n") for t in texts]
        s, n = score(m, [x for ls in lines for x in ls])
        doc = np.repeat(np.arange(len(texts)), [len(ls) for ls in lines])
        wrong = (s.argmax(1) != lang[doc]) & (n >= 20)
        good = np.bincount(doc, wrong, len(texts)) == 0
        kept = [k for k in range(len(LANGS)) if (good & (lang == k)).any()]
        good |= ~np.isin(lang, kept)
        texts, lang = [t for t, ok in zip(texts, good) if ok], lang[good]
    return fit(texts, lang)


def posterior(s: np.ndarray, prior: np.ndarray) -> np.ndarray:
    z = s + np.log(prior)
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


SEGMENTS = "rel string, row_id long, field string, seg_no long, lang string, confidence double"


def _batch(rel, rows, field, seg, lang, conf):
    return pa.RecordBatch.from_arrays(
        [pa.array([rel] * len(rows), pa.string()), pa.array(rows, pa.int64()), pa.array(field, pa.string()), pa.array(seg, pa.int64()), pa.array(lang, pa.string()), pa.array(conf, pa.float64())],
        names=["rel", "row_id", "field", "seg_no", "lang", "confidence"],
    )


def documents(docs: DataFrame, matrix: np.ndarray, id_col="mono_id", text="text", label="predicted_language", rel="mono_docs", all_rows=False) -> DataFrame:
    """Segments of documents: with all_rows every document and every line of a mixed one,
    else only those whose label is missing, wrong, or for one language where there are several."""
    held = docs.sparkSession.sparkContext.broadcast(matrix)

    def run(batches):
        m = held.value
        for b in batches:
            ids, named = b.column(0).to_pylist(), b.column(2).to_pylist()
            lines = [(t or "").split("\n") for t in b.column(1).to_pylist()]
            flat = [x for ls in lines for x in ls]
            s, n = score(m, flat)
            rows, seg, lang, conf = [], [], [], []
            at = 0
            for i, name, ls in zip(ids, named, lines):
                z, k = s[at : at + len(ls)], n[at : at + len(ls)]
                at += len(ls)
                if not k.sum():
                    continue
                # the document's main language: of most letters
                main = int(np.bincount(z.argmax(1), k, len(LANGS)).argmax())
                best = z.argmax(1)
                best = np.where((z.max(1) - z[:, main] >= LINE_MARGIN) & (k >= 3), best, main)
                kinds = set(best[k > 0])
                prior = np.full((1, len(LANGS)), 0.1 / (len(LANGS) - 1))
                prior[0, main] = 0.9
                p = posterior(z, prior)
                if len(kinds) > 1:
                    rows.append(i)
                    seg.append(0)
                    lang.append(MIXED)
                    conf.append(float(p[np.arange(len(ls)), best][k > 0].min()))
                    for j in range(len(ls)):
                        rows.append(i)
                        seg.append(j + 1)
                        lang.append(LANGS[best[j]])
                        conf.append(float(p[j, best[j]]))
                elif all_rows or name != LANGS[main]:
                    rows.append(i)
                    seg.append(0)
                    lang.append(LANGS[main])
                    conf.append(float(posterior(z.sum(0, keepdims=True), prior)[0, main]))
            yield _batch(rel, rows, [text] * len(rows), seg, lang, conf)

    return docs.select(F.col(id_col).cast("long"), text, labels(label).alias("_l")).mapInArrow(run, SEGMENTS)


def cells(pairs: DataFrame, matrix: np.ndarray, id_col="pair_id", columns=(("kk", "kaz"), ("ru", "rus")), rel="pairs") -> DataFrame:
    """Cells that are not in their column's language."""
    held = pairs.sparkSession.sparkContext.broadcast(matrix)

    def run(batches):
        m = held.value
        for b in batches:
            ids = b.column(0).to_pylist()
            for k, (field, expected) in enumerate(columns):
                texts = [t or "" for t in b.column(k + 1).to_pylist()]
                s, n = score(m, texts)
                e = LANGS.index(expected)
                # look-alike letters are no sign of another language
                again = [i for i in np.flatnonzero((s.argmax(1) != e) & (n >= 3)).tolist() if folded(texts[i]) != texts[i]]
                if again:
                    s[again] = score(m, [folded(texts[i]) for i in again])[0]
                prior = np.full((1, len(LANGS)), (1 - CELL_PRIOR) / (len(LANGS) - 1))
                prior[0, e] = CELL_PRIOR
                p = posterior(s, prior)
                best = p.argmax(1)
                hit = np.flatnonzero((best != e) & (n >= 3))
                yield _batch(rel, [ids[i] for i in hit], [field] * len(hit), [0] * len(hit), [LANGS[best[i]] for i in hit], p[hit, best[hit]].tolist())

    return pairs.select(F.col(id_col).cast("long"), *[f for f, _ in columns]).mapInArrow(run, SEGMENTS)


def found(docs: DataFrame, pairs: DataFrame, garbled: DataFrame) -> DataFrame:
    m = train(docs)
    wrong = cells(pairs, m)
    bad = garbled.select(F.col("pair_id").alias("row_id"), "field")
    wrong = wrong.join(bad, ["row_id", "field"], "left_anti").select("rel", "row_id", "field", "seg_no", "lang")
    return documents(docs, m).select(*wrong.columns).unionByName(wrong)
