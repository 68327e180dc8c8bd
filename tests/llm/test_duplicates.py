"""Problems 4, 5 and 6 against brute force."""

import random
from collections import Counter

import numpy as np

from lexiloom.llm import encoding, formatting, neardup, overlap, setjoin


def likeness(a, b):
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((x & y).values()) / max(sum(x.values()), sum(y.values()), 1)


def texts(seed, n, words):
    """Random texts over common and rare words, with near and exact copies."""
    r = random.Random(seed)
    common = [f"сөз{i}" for i in range(60)]
    out = []
    for i in range(n):
        k = r.random()
        if out and k < 0.4:
            w = r.choice(out).split()
            for _ in range(r.randrange(0, len(w) // 3)):
                w[r.randrange(len(w))] = r.choice(common)
            if k < 0.1:
                r.shuffle(w)
        else:
            w = [r.choice(common) if r.random() < 0.8 else f"есім{r.randrange(10**6)}" for _ in range(r.randrange(*words))]
        out.append(" ".join(w))
    return out


def test_formatting_copies(pairs):
    d = pairs([(1, "Сәлем, әлем!", "Привет"), (5, "сәлем  ӘЛЕМ", "привет."), (3, "Привет", "Сәлем әлем"), (4, "Сәлем", "Привет"), (7, None, ""), (6, "", "…"), (9, "x" * 100_000, "y"), (10, "X" * 100_000, "Y")])
    assert sorted(map(tuple, formatting.found(d).collect())) == [(1, 3), (1, 5), (6, 7), (9, 10)]
    assert {r.pair_id: r.copies for r in formatting.collapsed(d).collect()} == {1: 3, 4: 1, 6: 2, 9: 2}


def test_hot_keys_take_the_salted_way(pairs):
    d = pairs([(i, "бір", "один") for i in range(300, 0, -1)] + [(1000 + i, f"а{i}", "б") for i in range(100)])
    assert formatting.hot_keys(formatting.keyed(d)).count() == 1
    got = formatting.found(d).collect()
    assert len(got) == 299 and {r.first_id for r in got} == {1}


def test_empty_tables(pairs, spark):
    d = pairs([])
    assert formatting.found(d).count() == 0
    assert neardup.near_pairs(d).count() == 0 and neardup.groups(d).count() == 0
    e = spark.createDataFrame([], "item_id long, kk string, ru string")
    assert overlap.found(e, d).count() == 0


def test_near_pairs_agree_with_brute_force(pairs):
    t = texts(3, 220, (12, 40))
    rows = [(i, t[i], t[(i * 7) % 220] if i % 3 else t[i]) for i in range(220)] + [(900, None, None), (901, "аз сөз", "мало")]
    rows += [(1000 + i, rows[i][1].upper() + "!", rows[i][2]) for i in range(5)]
    full = {i: f"{a or ''} {b or ''}" for i, a, b in rows}
    same = lambda i, j: sorted(["".join(x.lower().replace("!", "").split()) for x in (rows_by[i][1] or "", rows_by[i][2] or "")]) == sorted(["".join(x.lower().replace("!", "").split()) for x in (rows_by[j][1] or "", rows_by[j][2] or "")])
    rows_by = {r[0]: r for r in rows}
    strip = {i: s.replace("!", "") for i, s in full.items()}
    big = [i for i in strip if len(strip[i].split()) >= 24]
    want = {(i, j) for i in big for j in big if i < j and likeness(strip[i], strip[j]) >= 0.8 and not same(i, j)}
    got = neardup.near_pairs(pairs(rows), bands=setjoin.bands_for(0.9999, 0.45)).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == want and want
    got = neardup.near_pairs(pairs(rows)).collect()
    assert {tuple(r) for r in got} <= want and len(got) >= 0.9 * len(want)
    # classes with their numbers of linked texts instead of all pairs
    cls = {r.pair_id: (r.class_id, r.n_links) for r in neardup.groups(pairs(rows)).collect()}
    assert set(cls) == {i for p in map(tuple, got) for i in p}
    for i, (c, n) in cls.items():
        assert c <= i and cls[c] == (c, n)
        assert n == len({cls[j if k == i else k][0] for j, k in map(tuple, got) if i in (j, k)})


def test_near_pairs_of_frequent_words_are_whole(pairs, monkeypatch):
    """Rows that share frequent words and differ in rare ones are all found, with and without keys of two words."""
    kk = " ".join(f"сөз{i}" for i in range(20))
    ru = " ".join(f"слово{i}" for i in range(20))
    rows = [(i, f"{kk} есім{i}", f"{ru} имя{i}") for i in range(40)] + [(100 + i, " ".join(f"өзге{i}а{j}" for j in range(30)), "") for i in range(40)]
    want = {(i, j) for i in range(40) for j in range(i + 1, 40)}
    assert {tuple(r) for r in neardup.near_pairs(pairs(rows)).collect()} == want
    monkeypatch.setattr(setjoin, "FEW", 3)
    assert {tuple(r) for r in neardup.near_pairs(pairs(rows)).collect()} == want


def test_garbled_rows_are_those_of_problem_1(pairs, kazakh):
    """Judging the members' cells only leaves the same rows as judging all cells."""
    p = pairs([(i, f"{kk} {kk}", f"{ru} {ru}") for i, kk, ru in kazakh] + [(900 + i, f"{kk} {kk}", f"\ufffd {ru} {ru}") for i, kk, ru in kazakh[:4]])
    _, members = neardup.links(p)
    bad = {r.pair_id for r in encoding.found(p).collect()}
    all_ids = {r.pair_id for r in members.collect()}
    assert {r.pair_id for r in neardup.without_garbled(p, members).collect()} == all_ids - bad and all_ids & bad


def test_cross_split_agrees_with_brute_force(pairs, spark):
    t = texts(5, 160, (8, 30))
    e = [(i, t[i], t[i + 1] if i % 4 else "") for i in range(0, 40)] + [(99, None, "қысқа")]
    p = [(1000 + i, t[(i * 3) % 160], t[i]) for i in range(160)]
    ev = spark.createDataFrame(e, "item_id long, kk string, ru string")
    ok = lambda a, b: a and b and min(len(a.split()), len(b.split())) >= 10 and likeness(a, b) >= 0.8
    want = {(i, j) for i, a, b in e for j, c, d in p if ok(a, c) or ok(b, d)}
    got = {tuple(r) for r in overlap.found(ev, pairs(p)).collect()}
    assert got == want and want


def bags_of(spark, rows):
    """(id, e) of rows (id, words)."""
    memory = setjoin.Words()
    out = []
    for i, words in rows:
        e = setjoin.elements(*setjoin.word_hashes([[str(w) for w in words]], memory))
        out.append((i, e.view(np.int64).tolist()))
    return spark.createDataFrame(out, "id long, e array<long>")


def key_rows(spark, bags, weights, bands):
    """Keys of each bag."""
    keys = {}
    for r in setjoin.packed_keys(bags_of(spark, enumerate(bags)), weights, bands, 1, 0).collect():
        for k, i, *_ in np.frombuffer(r.rows, dtype=setjoin.ROW):
            keys.setdefault(i, []).append(k)
    return keys


NO_WEIGHTS = (np.zeros(0, np.uint64), np.zeros(0, np.float32))


def test_bands_reach_the_target_recall(spark):
    """At the similarity for which bands were chosen, the target share of pairs meets."""
    similarity, recall = 2 / 3, 0.95
    bands = setjoin.bands_for(recall, similarity)
    assert (1 - similarity**setjoin.ROWS) ** bands <= 1 - recall < (1 - similarity**setjoin.ROWS) ** (bands - 1)
    r = np.random.default_rng(7)
    bags = []
    for _ in range(500):
        w = r.choice(10**6, 48, replace=False).tolist()
        bags += [w[:40], w[8:]]  # 32 of 48 words are shared
    keys = key_rows(spark, bags, NO_WEIGHTS, bands)
    met = [bool(set(keys[2 * i]) & set(keys[2 * i + 1])) for i in range(500)]
    assert np.mean(met) >= recall


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    """Bags over the bound of a group still meet all others, in pairs of blocks."""
    monkeypatch.setattr(setjoin, "SPLIT", 7)
    bags = [[*range(40), 100 + i] for i in range(45)]
    packed = setjoin.packed_keys(bags_of(spark, enumerate(bags)), NO_WEIGHTS, 20, 2, 0)
    got = {tuple(r) for r in setjoin.paired(packed, False).collect()}
    assert got == {(i, j) for i in range(45) for j in range(i + 1, 45)}
    other = setjoin.packed_keys(bags_of(spark, enumerate(bags)).selectExpr("id + 1000 AS id", "e"), NO_WEIGHTS, 20, 2, 1)
    got = {tuple(r) for r in setjoin.paired(packed.union(other), True).collect()}
    assert got == {(i, 1000 + j) for i in range(45) for j in range(45)}


def test_words_weigh_by_rarity(spark):
    rows = [(i, ["common", "half" if i % 2 else "other", f"only{i}"]) for i in range(100)] + [(7, ["copy", "of", "a", "row"])]
    h, w = setjoin.word_weights(bags_of(spark, rows))
    of = dict(zip(h.tolist(), w.tolist()))
    common, half, only = (of.get(int(setjoin.elements(*setjoin.word_hashes([[x]], setjoin.Words()))[0])) for x in ("common", "half", "only3"))
    assert common < half and only is None and abs(half - np.log(2) ** 2) < 0.02


def test_repeats_are_elements():
    x, y = (set(setjoin.elements(*setjoin.word_hashes([t.split()], setjoin.Words())).tolist()) for t in ("a a a a b", "a b b b b"))
    assert len(x) == len(y) == 5 and len(x & y) == sum((Counter("aaaab") & Counter("abbbb")).values())
