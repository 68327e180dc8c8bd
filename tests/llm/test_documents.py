"""Problems 8, 9 and 10 against brute force, a public encoder and held-out labels."""

import os
import random

import numpy as np
import pytest

from lexiloom.llm import bpe, passages, toxicity


@pytest.fixture(scope="module")
def encoder():
    if not os.path.exists(bpe.RANKS):
        pytest.skip("no vocabulary file")
    return bpe.Encoder(bpe.read_ranks(bpe.RANKS))


def test_ids_are_the_public_ones(encoder):
    tiktoken = pytest.importorskip("tiktoken")
    public = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.RANKS), special_tokens={})
    r = random.Random(0)
    texts = ["Сәлем, әлем! It's 12 o'clock…", " ", "\n\n a", "<|endoftext|>", "日本語🙂👍🏽", "а" * 3000 + "bc" * 2000, "!" * 500]
    texts += ["".join(r.choice("абвғқ xyz.,'\n1") for _ in range(r.randrange(200))) for _ in range(200)]
    assert [g.tolist() for g in encoder.encode(texts)] == [public.encode_ordinary(t) for t in texts]


def test_empty_and_null_give_no_ids(spark, encoder):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in bpe.encode(d).collect()}
    assert got[1] == got[2] == [] and len(got[3]) == 1
    assert bpe.encode(d.limit(0)).count() == 0


@pytest.mark.parametrize("block", [20_000, 5])
def test_passages_agree_with_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(passages, "BLOCK", block)
    r = random.Random(2)
    words = [f"w{i}" for i in range(15)]
    ps = [(i, " ".join(r.choice(words) for _ in range(r.randrange(8, 40)))) for i in range(12)]
    docs = []
    for i in range(150):
        w = [r.choice(words) for _ in range(r.randrange(0, 60))]
        src = r.choice(ps)[1].split()
        k = r.randrange(len(src))
        docs.append((i, " ".join(w[:20] + src[k : k + r.randrange(8, 16)] + w[20:]).replace("w3 ", "W3, <b class='x'>") if i % 5 else None))
    wins = [(p, tuple(passages.words(t)[k : k + 12])) for p, t in ps for k in range(len(t.split()) - 11)]
    want = set()
    for i, t in docs:
        w = passages.words(t)
        have = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        want |= {(i, p) for p, x in wins if x in have}
    d = spark.createDataFrame(docs, "doc_id long, text string")
    p = spark.createDataFrame(ps, "passage_id long, text string")
    got = passages.leaks(d, p).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want and want
    assert {x.passage_id for x in passages.per_passage(d, p).collect()} == set(range(12))
    assert passages.leaks(d, p.limit(0)).count() == 0


def corpus(seed, n):
    r = random.Random(seed)
    neutral = ["the baker counted a quiet market", "our driver repaired another bridge", "врач проверил новый дом", "ғалым жаңа әдісті ұсынды"]
    bad = ["you are a stupid moron", "пошёл вон тупой придурок", "аузыңды жап ақымақ"]
    docs, grade = [], []
    for _ in range(n):
        s = [r.choice(neutral) + f" имя{r.randrange(10**6)}." for _ in range(6)]
        y = r.random() < 0.3
        if y:
            b = r.choice(bad)
            s.insert(r.randrange(6), (b.replace("moron", "m#ron").replace("о", "o") if r.random() < 0.3 else b) + "!")
        docs.append(" ".join(s))
        grade.append(2 * y)
    return docs, np.array(grade)


def test_held_out_accuracy(spark):
    texts, grade = corpus(0, 400)
    m = toxicity.fit(grade[:250], texts[:250])
    assert m.theta[0] < m.theta[1]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts[250:])] + [(900, None), (901, " \n"), (902, "the baker counted a quiet market " * 20_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.scores(d, m).collect()}
    right = sum((got[i].chance >= 0.5) == (grade[250 + i] > 0) for i in range(150))
    assert right >= 145
    assert got[900].severity == got[901].severity == 0.0 and got[902].chance < 0.5


def test_wrong_labels_teach_nothing(spark):
    """One label in ten is wrong; what is said by them alone is not found."""
    texts, grade = corpus(1, 600)
    given = grade.copy()
    given[::10] = 2 - given[::10]
    m = toxicity.fit(given[:450], texts[:450])
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts[450:])], "doc_id long, text string")
    got = {r.doc_id: r.chance >= 0.5 for r in toxicity.scores(d, m).collect()}
    assert sum(got[i] == (grade[450 + i] > 0) for i in range(150)) >= 145


def test_tags_of_any_length_are_no_words():
    assert toxicity.sentences("good <a href='" + "stupid " * 100 + "'> day.") == [["good", "day"]]


def test_without_positive_labels_nothing_is_found(spark):
    d = spark.createDataFrame([(1, "a stupid text."), (2, None)], "doc_id long, text string, source string".replace(", source string", ""))
    l = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, toxic int")
    assert toxicity.found(d, l).count() == 0


def test_hidden_words_fold_to_one_form():
    assert toxicity.sentences("Т.У.П.И.Ц.А. о-й")[0][0] == "тупица"
    assert toxicity.fold("тупuuuца") == toxicity.fold("тупuца") and toxicity.fold("m@@ron") == "m*ron"


def test_sentences_score_by_distinct_features_at_any_length(spark):
    r = random.Random(4)
    m = toxicity.Model(np.random.default_rng(3).normal(0, 0.05, 1 << toxicity.BITS).astype(np.float32), np.array([0.0, 1.0]))
    texts = [" ".join(r.choice(["бала", "балалар", "қала", "қалалар", "да", "т#к"]) for _ in range(n)) for n in (1, 2, 10, 59, 60, 61, 62, 300)]
    texts += [". ".join(texts[:5]), "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.chance for x in toxicity.scores(d, m).collect()}
    memory = toxicity.Words()

    def features(sentence):
        out, last = set(), 0x51ED270B
        for w in sentence:
            h, own = memory(w)
            out |= {*own, ((last * 0x2545F4914F6CDD1D ^ h) & 0xFFFFFFFFFFFFFFFF) >> 40 & toxicity.MASK}
            last = h
        return sorted(out)

    for i, t in enumerate(texts):
        z = [float(m.w[features(s)].astype(np.float64).sum()) for s in toxicity.sentences(t or "")]
        assert abs(got[i] - (1 / (1 + np.exp(-max(z))) if z else 0)) < 1e-9
