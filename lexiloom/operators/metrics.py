"""Corpus metrics of translations from sufficient statistics per row.

A row's statistics are arrays of matched and total n-grams by order; corpus scores are
closed forms of their sums, so they group by anything and resample cheaply.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERS = 4
CHARS, WORDS, BETA = 6, 2, 2.0


def tokens_13a(c: Column) -> Column:
    """Tokens of the 13a rules: entities resolved, punctuation apart, case kept."""
    c = F.regexp_replace(F.replace(c, F.lit("<skipped>"), F.lit("")), r"-\n", "")
    c = F.regexp_replace(c, r"\n", " ")
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.concat(F.lit(" "), c, F.lit(" "))
    c = F.regexp_replace(c, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    c = F.regexp_replace(c, r"([^0-9])([\.,])", "$1 $2 ")
    c = F.regexp_replace(c, r"([\.,])([^0-9])", " $1 $2")
    c = F.regexp_replace(c, r"([0-9])(-)", "$1 $2 ")
    return F.filter(F.split(c, r"[\s]+"), lambda w: w != "")


def _bag(g: Column) -> Column:
    """Each gram once, with the number of its repeats before it: bags become sets."""
    s = F.array_sort(g)
    return F.transform(s, lambda x, i: F.concat_ws("\x01", x, (i - F.array_position(s, x) + 1).cast("string")))


def matches(hyp: Column, ref: Column) -> Column:
    """Number of grams two bags share, counting repeats."""
    return F.size(F.array_intersect(_bag(hyp), _bag(ref)))


def gram_rows(df: DataFrame, keys: list[str], hyp: Column, ref: Column, orders: int) -> DataFrame:
    """(keys, n, matched, hyp_total, ref_total) of each row and order.

    hyp, ref: arrays of tokens, or strings of which the characters are the tokens.  A row's
    n-grams are counted and clipped where the row stands; no gram is shuffled.
    """
    d = df.select(*keys, hyp.alias("_h"), ref.alias("_r"))
    schema = T.StructType([d.schema[k] for k in keys] + [T.StructField("n", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ("matched", "hyp_total", "ref_total")])

    def bag(x, n):
        if isinstance(x, str):
            return Counter([x[i : i + n] for i in range(len(x) - n + 1)])
        return Counter(x if n == 1 else zip(*(x[i:] for i in range(n))))

    def run(batches):
        for b in batches:
            names = b.schema.names[:-2]
            rows, last, refs = [], None, []
            for h, r in zip(b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist()):
                h, r = h or [], r or []
                if r is not last and r != last:  # hypotheses of one reference mostly follow each other
                    last, refs = r, [bag(r, n) for n in range(1, orders + 1)]
                for n in range(1, orders + 1):
                    x, y = bag(h, n), refs[n - 1] if r else Counter()
                    rows.append((n, sum(min(c, y[g]) for g, c in x.items() if g in y), max(0, len(h) - n + 1), max(0, len(r) - n + 1)))
            at = pa.array(np.repeat(np.arange(b.num_rows), orders))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(i).take(at) for i in range(len(names))] + [pa.array(cols[0], pa.int32())] + [pa.array(c, pa.int64()) for c in cols[1:]], names=[*names, "n", "matched", "hyp_total", "ref_total"]
            )

    return d.mapInArrow(run, schema)


def bleu(stats: DataFrame, by: list[str]) -> DataFrame:
    """BLEU of summed statistics, with exponential smoothing of orders without a match."""
    s = stats.groupBy(*by, "n").agg(F.sum("matched").alias("m"), F.sum("hyp_total").alias("h"), F.sum("ref_total").alias("r"))
    p = s.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("n", "m", "h", "r"))).alias("x"))
    zeros = lambda k: F.size(F.filter(F.slice(F.col("x"), 1, k), lambda e: (e.m == 0) & (e.h > 0)))
    logs = [
        F.when(F.col("x")[k].h == 0, None).when(F.col("x")[k].m == 0, F.log(F.lit(100.0) / (F.pow(F.lit(2.0), zeros(k + 1)) * F.col("x")[k].h))).otherwise(F.log(100.0 * F.col("x")[k].m / F.col("x")[k].h))
        for k in range(ORDERS)
    ]
    mean = sum(logs[1:], logs[0]) / ORDERS
    hyp, ref = F.col("x")[0].h, F.col("x")[0].r
    bp = F.when(hyp >= ref, F.lit(1.0)).when(hyp == 0, F.lit(0.0)).otherwise(F.exp(1 - ref / hyp))
    return p.select(*by, F.coalesce(bp * F.exp(mean), F.lit(0.0)).alias("bleu"))


def chars(c: Column) -> Column:
    """A text without white space: its characters are the tokens."""
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", "")


def f_score(stats: DataFrame, by: list[str], name: str, beta: float = BETA) -> DataFrame:
    """Mean F of the orders that both sides have, times 100."""
    s = stats.groupBy(*by, "n").agg(F.sum("matched").alias("m"), F.sum("hyp_total").alias("h"), F.sum("ref_total").alias("r")).where("h > 0 AND r > 0")
    p, q = F.col("m") / F.col("h"), F.col("m") / F.col("r")
    f = F.when(p + q == 0, 0.0).otherwise((1 + beta**2) * p * q / F.nullif(beta**2 * p + q, F.lit(0.0)))
    return s.groupBy(*by).agg((100 * F.avg(f)).alias(name))


def _edits(h: list[str], r: list[str]) -> int:
    row = list(range(len(r) + 1))
    for i, a in enumerate(h, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(r, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def ter_edits(h: list[str], r: list[str], most_shift: int = 10, most_distance: int = 50) -> int:
    """Edits with block shifts: the shift that saves most is made, again and again, each
    costing one edit."""
    shifts, best = 0, _edits(h, r)
    while best > 0:
        found = None
        at: dict[str, list[int]] = {}
        for j, w in enumerate(r):
            at.setdefault(w, []).append(j)
        for i in range(len(h)):
            for j in at.get(h[i], ()):
                if i == j or abs(i - j) > most_distance:
                    continue
                for n in range(1, most_shift + 1):
                    if i + n > len(h) or j + n > len(r) or h[i + n - 1] != r[j + n - 1]:
                        break
                    rest = h[:i] + h[i + n :]
                    moved = rest[:j] + h[i : i + n] + rest[j:]
                    gain = best - _edits(moved, r)
                    if gain > 1 and (found is None or (gain, n) > found[0]):
                        found = ((gain, n), moved)
        if not found:
            break
        shifts, h = shifts + 1, found[1]
        best = _edits(h, r)
    return shifts + best


@F.pandas_udf(T.LongType())
def edits(h: pd.Series, r: pd.Series) -> pd.Series:
    """Shifted edits of each pair of texts in lower case, by words."""
    return pd.Series([ter_edits((a or "").lower().split(), (b or "").lower().split()) for a, b in zip(h, r)], dtype="int64")


def ter(df: DataFrame, by: list[str], hyp: str, ref: str) -> DataFrame:
    words = F.size(F.filter(F.split(F.coalesce(F.col(ref), F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    return df.select(*by, edits(hyp, ref).alias("e"), words.alias("n")).groupBy(*by).agg((100.0 * F.sum("e") / F.greatest(F.sum("n"), F.lit(1))).alias("ter"))


def deltas(scores: DataFrame, system: str, base: str, metrics: list[str], reverse: tuple[str, ...] = ("ter",)) -> DataFrame:
    """(metric, delta): by how much a system's scores (system, metrics) are better than those of a
    base; of reversed metrics, where less is better, the difference is turned round."""
    x = scores.where(F.col("system") == system).select(F.explode(F.create_map(*[v for m in metrics for v in (F.lit(m), F.col(m))])).alias("metric", "a"))
    y = scores.where(F.col("system") == base).select(F.explode(F.create_map(*[v for m in metrics for v in (F.lit(m), F.col(m))])).alias("metric", "b"))
    d = F.col("a") - F.col("b")
    return x.join(y, "metric").select("metric", F.when(F.col("metric").isin(*reverse), -d).otherwise(d).alias("delta"))


def bootstrap_draws(rows: DataFrame, pos: str, samples: int, seed: int) -> DataFrame:
    """(sample, pos, k): how often each row stands in each resample, by hash of seed, sample
    and row: a Poisson(1) draw, so resamples need no global row numbers or second pass."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sample").cast("string"), F.col(pos).cast("string"))), 1, 8), 16, 10).cast("double") / float(2**32)
    cum, p, edges = 0.0, 2.718281828459045**-1, []
    for k in range(1, 9):
        cum += p
        p /= k
        edges.append(cum)
    n = sum((F.when(u >= e, 1).otherwise(0) for e in edges[1:]), F.when(u >= edges[0], 1).otherwise(0))
    d = rows.select(pos).withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    return d.withColumn("k", n).where("k > 0")


def poisson_edges() -> np.ndarray:
    """Cumulative chances of a Poisson(1) draw of 0 to 7, as in bootstrap_draws."""
    cum, p, edges = 0.0, 2.718281828459045**-1, []
    for k in range(1, 9):
        cum += p
        p /= k
        edges.append(cum)
    return np.array(edges)


def text_grams(words: list[str]) -> list[Counter]:
    """Bags of the n-grams of words (orders 1 to 4) and of characters without white space (1 to 6)."""
    c = "".join("".join(words).split())
    bags = [Counter(zip(*(words[i:] for i in range(n)))) for n in range(1, ORDERS + 1)]
    return bags + [Counter([c[i : i + n] for i in range(len(c) - n + 1)]) for n in range(1, CHARS + 1)]


def resampled_stats(df: DataFrame, key: str, samples: int, seed: int) -> DataFrame:
    """(system, sample, metric, n, m, h, r): statistics of BLEU and chrF++ summed over each resample.

    df: (key, system, h, r), words of hypothesis and reference.  Draws are those of bootstrap_draws.
    A row's n-grams are counted once, and a partition sums its rows for all resamples by matrix
    products, so rows are not multiplied by resamples; sums are of integers, hence exact.
    """
    orders = [("bleu", n, n - 1) for n in range(1, ORDERS + 1)] + [("chrf_pp", n, ORDERS + n - 1) for n in range(1, CHARS + 1)]
    orders += [("chrf_pp", 10 + n, n - 1) for n in range(1, WORDS + 1)]
    width = ORDERS + CHARS

    def run(batches):
        edges = poisson_edges()
        heads = [hashlib.md5(f"{seed}:{s}:".encode()) for s in range(1, samples + 1)]

        def draws(k):
            tail, got = str(k).encode(), []
            for x in heads:
                x = x.copy()
                x.update(tail)
                got.append(x.digest())
            u = np.frombuffer(b"".join(got), dtype=">u4")[::4] / 2.0**32
            return np.searchsorted(edges, u, side="right")

        sums: dict[str, np.ndarray] = {}
        drawn: dict[str, np.ndarray] = {}
        last_k, last_r, k_draws, r_bags = None, None, None, None
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256).to_pydict()
                ks, ms, systems = [], [], np.array(part["system"], dtype=object)
                for k, h, r in zip(part[key], part["h"], part["r"]):
                    if k != last_k:  # systems of a row mostly follow each other
                        last_k, k_draws = k, draws(k)
                    if r != last_r:
                        last_r, r_bags = r, text_grams(r)
                    h_bags = text_grams(h)
                    ks.append(k_draws)
                    ms.append([[sum((x & y).values()) for x, y in zip(h_bags, r_bags)], [x.total() for x in h_bags], [y.total() for y in r_bags]])
                ks, ms = np.array(ks, dtype=np.float64), np.array(ms, dtype=np.float64).reshape(len(ks), -1)
                for s in set(systems):
                    mine = systems == s
                    sums[s] = sums.get(s, 0) + ks[mine].T @ ms[mine]
                    drawn[s] = drawn.get(s, 0) + ks[mine].sum(axis=0)
        for s, x in sums.items():
            some = np.flatnonzero(drawn[s])
            x = x[some].astype(np.int64).reshape(len(some), 3, width)
            for metric, n, i in orders:
                same = [pa.array([v] * len(some), t) for v, t in ((s, pa.string()), (metric, pa.string()), (n, pa.int32()))]
                yield pa.RecordBatch.from_arrays(
                    [same[0], pa.array(some + 1, pa.int32()), *same[1:], *(pa.array(x[:, j, i]) for j in range(3))],
                    names=["system", "sample", "metric", "n", "matched", "hyp_total", "ref_total"],
                )

    d = df.select(key, "system", "h", "r").repartition(2 * df.sparkSession.sparkContext.defaultParallelism, key)
    d = d.mapInArrow(run, "system string, sample int, metric string, n int, matched long, hyp_total long, ref_total long")
    return d.groupBy("system", "sample", "metric", "n").agg(*(F.sum(c).alias(c) for c in ("matched", "hyp_total", "ref_total")))
