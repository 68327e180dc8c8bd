import pytest
from pyspark.sql import functions as F

from lexiloom.functions import sequence as sq
from lexiloom.operators import dedup, filters, metrics, order, shards
from lexiloom.sources import store, text_io


def test_merge_keeps_base_first(spark):
    base = spark.createDataFrame([("Қазақша", "Русский", 0)], "src string, tgt string, k int")
    syn = spark.createDataFrame([("Қазақша", "Русский", 0), ("Сәлем", "Привет", 1)], "src string, tgt string, k int")
    key = F.concat_ws("\0", "src", "tgt")
    got = dedup.union_priority([base, syn], key, ["k"]).select("src", "_priority").collect()
    assert sorted(map(tuple, got)) == [("Сәлем", 1), ("Қазақша", 0)]


def test_seeded_dedup_ignores_case(spark):
    c = spark.createDataFrame([(1, 0, "Бір"), (1, 1, "БІР"), (2, 0, "Екі")], "d int, seg int, sentence string")
    s = spark.createDataFrame([("екі",)], "sentence string")
    assert [tuple(r) for r in dedup.seeded_dedup(c, s, ["d", "seg"]).collect()] == [(1, 0, "Бір")]


def test_pair_status(spark):
    rows = [("", "б в"), ("а б", "а б"), ("а", "б в"), ("а б", "б в г"), ("а б", "в г")]
    d = spark.createDataFrame(rows, "a string, b string").select(filters.pair_status(F.col("a"), F.col("b"), 2).alias("s"))
    assert [r.s for r in d.collect()] == ["empty", "identical", "short", "long", "ok"]


def test_error_gate(spark):
    d = spark.createDataFrame([(1, "ok"), (2, None)], "i int, status string")
    assert filters.error_gate(d, skip=True).count() == 1
    with pytest.raises(Exception, match="has an error"):
        filters.error_gate(d).collect()


def test_length_batches(spark):
    d = spark.createDataFrame([(0, "a"), (1, "bbbb"), (2, "cc"), (3, "ddddd")], "i int, t string")
    b = shards.length_batches(d, 2, 4, F.length("t"), "i").orderBy("batch", "place").collect()
    assert [[r.i for r in b if r.batch == k] for k in (0, 1)] == [[0, 2], [1, 3]]


RECORDS = "index long, source string, translation string, status string, record_id long"


def test_validation(spark):
    e = spark.createDataFrame([(0, "one"), (1, "two"), (2, "three")], "index long, source string")
    r = spark.createDataFrame(
        [(0, "wrong", "x", "ok", 1), (0, "one", "x", "ok", 2), (1, "two", " ", "ok", 3), (9, "?", "y", "ok", 4), (2, "three", None, "error", 5)], RECORDS
    )
    v = shards.validation(r, e).first().asDict()
    want = dict(expected=3, records=5, out_of_range=1, source_mismatch=1, duplicate=1, errors=1, ok=3, empty=1, same=0, unique_indexes=3, missing=0, first_missing=None, valid=False)
    assert v == want
    good = [(0, "one", "a", "ok", 1), (1, " two\t", "b", "ok", 2), (2, "three", "c", "ok", 3)]
    assert shards.validation(spark.createDataFrame(good, RECORDS), e).first().valid
    for bad, name in (
        ((0, "one", " one ", "ok", 1), "same"),
        ((0, "one", None, "error", 1), "errors"),
        ((0, "one", " ", "ok", 1), "empty"),
        ((5, "one", "a", "ok", 1), "missing"),
    ):
        v = shards.validation(spark.createDataFrame([bad, *good[1:]], RECORDS), e).first()
        assert v[name] == 1 and not v.valid
    # a repeat counts whatever its status, and a failed record is no missing one
    v = shards.validation(spark.createDataFrame([*good, (0, "one", None, "error", 4)], RECORDS), e).first()
    assert (v.duplicate, v.errors, v.missing, v.valid) == (1, 1, 0, False)
    v = shards.validation(spark.createDataFrame([], RECORDS), e).first()
    assert (v.records, v.missing, v.first_missing, v.valid) == (0, 3, 0, False)


def test_strict_hypotheses(spark):
    refs = spark.createDataFrame([(0, "one", "эк"), (1, "two", "до")], "index long, source string, reference string")
    good = [(0, "one", " a ", "ok", 1), (1, "two", "b", "ok", 2)]
    of = lambda rows: shards.strict_hypotheses(spark.createDataFrame(rows, RECORDS), refs).collect()
    assert {r["index"]: r.hypothesis for r in of(good)} == {0: "a", 1: "b"}
    for rows, what in (
        ([*good, (7, "x", "y", "ok", 3)], "index 7: outside"),
        ([good[0], (1, "too", "b", "ok", 2)], "index 1: another"),
        ([good[0], (1, "two", "b", "error", 2)], "index 1: failed"),
        ([good[0], (1, "two", "  ", "ok", 2)], "index 1: failed"),
        ([*good, (1, "two", "c", "ok", 3)], "index 1: repeated"),
        ([good[0]], "index 1: missing"),
    ):
        with pytest.raises(Exception, match=what):
            of(rows)


def test_candidates_in_the_order_of_splits(spark):
    from lexiloom.plans import corpus

    rows = [(1, "gold_long", "Бір"), (2, "gold_medium", "бір"), (3, "gold_short", "БІР"), (4, "mono_short", "екі"), (5, "devtest", "үш"), (6, "gold_long", " "), (7, "dev", None), (8, "dev", "төрт"), (9, "mono_long", "үш")]
    d = spark.createDataFrame(rows, "item_id long, split string, kk string")
    assert {r.item_id: r.code for r in corpus.numbered_candidates(d).collect()} == {8: "dev-00000", 5: "devtest-00001", 3: "gold_short-00002", 4: "mono_short-00003"}


def test_compaction_and_remaining(spark):
    r = spark.createDataFrame([(2, "s", "t", "ok", 1), (2, "s", "t", "ok", 2), (3, "s", None, "error", 3)], RECORDS)
    done = shards.compacted(r, ["record_id"])
    assert [x.record_id for x in done.collect()] == [1]
    assert {x["index"] for x in shards.remaining(spark.createDataFrame([(2,), (3,)], "index long"), done).collect()} == {3}


def test_retry_isolates_bad_rows(spark):
    def f(batch):
        if "bad" in batch:
            raise ValueError("no")
        return [x + "!" for x in batch]

    d = spark.createDataFrame([(i, "bad" if i == 5 else f"s{i}") for i in range(9)], "index long, source string")
    got = {r["index"]: (r.status, r.translation) for r in shards.map_with_retry(d, f, 8).collect()}
    assert got[5] == ("error", None) and got[4] == ("ok", "s4!") and len(got) == 9


def test_running_sum_over_partitions(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = order.running(d, ["k"], F.col("k"), "s", 6).collect()
    assert {r.k: r.s for r in got} == {k: k * (k - 1) // 2 for k in range(1000)}


def test_sequences(spark):
    d = spark.createDataFrame([([5, 6, 7],), ([],)], "a array<int>")
    r = d.select(sq.with_bos("a", 3).alias("s"), sq.with_bos_eos(F.col("a"), 3).alias("t"), sq.padded(F.col("a"), F.lit(4)).alias("p")).collect()
    assert [x.s for x in r] == [[1, 5, 6], [1]] and [x.t for x in r] == [[1, 5, 2], [1, 2]] and r[1].p == [3, 3, 3, 3]
    m = d.select(sq.random_mask(F.lit(1), F.size("a"), 0.0).alias("m"), sq.upto_eos(F.array(F.lit(4), F.lit(2), F.lit(9))).alias("e")).collect()
    assert sum(m[0].m) == 1 and m[1].m == [] and m[0].e == [4, 2]


def scores(spark, h, r):
    d = spark.createDataFrame([(0, h, r)], "i int, h string, r string").select("i", F.split("h", " ").alias("h"), F.split("r", " ").alias("r"))
    b = metrics.bleu(metrics.gram_rows(d, ["i"], F.col("h"), F.col("r"), 4), ["i"]).first().bleu
    c = metrics.gram_rows(d, ["i"], metrics.chars(F.array_join("h", " ")), metrics.chars(F.array_join("r", " ")), 6)
    return b, metrics.f_score(c, ["i"], "chrf").first().chrf


def test_metrics_of_identity_and_of_nothing(spark):
    b, c = scores(spark, "бұл бір қысқа сөйлем емес пе", "бұл бір қысқа сөйлем емес пе")
    assert b == pytest.approx(100) and c == pytest.approx(100)
    b, c = scores(spark, "zzz", "бұл бір қысқа сөйлем")
    assert b == 0 and c == 0


def test_ter_shifts():
    assert metrics.ter_edits("a b c".split(), "a b c".split()) == 0
    assert metrics.ter_edits("d e a b c".split(), "a b c d e".split()) == 1
    assert metrics.ter_edits([], "a b".split()) == 2


def test_grams_are_clipped(spark):
    d = spark.createDataFrame([(1, ["a", "a", "a", "b"], ["a", "a", "c"]), (2, [], ["a"]), (3, None, None)], "i int, h array<string>, r array<string>")
    got = {(r.i, r.n): (r.matched, r.hyp_total, r.ref_total) for r in metrics.gram_rows(d, ["i"], F.col("h"), F.col("r"), 2).collect()}
    assert got == {(1, 1): (2, 4, 3), (1, 2): (1, 3, 2), (2, 1): (0, 0, 1), (2, 2): (0, 0, 0), (3, 1): (0, 0, 0), (3, 2): (0, 0, 0)}


def test_deltas_turn_round_where_less_is_better(spark):
    d = spark.createDataFrame([("a", 20.0, 60.0), ("b", 18.0, 65.0)], "system string, bleu double, ter double")
    assert {r.metric: r.delta for r in metrics.deltas(d, "a", "b", ["bleu", "ter"]).collect()} == {"bleu": 2.0, "ter": 5.0}


def test_vocabulary_check():
    sq.check_vocabulary(8, 8)
    with pytest.raises(ValueError, match="8 pieces"):
        sq.check_vocabulary(8, 9)


def test_matches_count_repeats(spark):
    d = spark.createDataFrame([(["a", "a", "b"], ["a", "a", "a", "c"])], "h array<string>, r array<string>")
    assert d.select(metrics.matches(F.col("h"), F.col("r")).alias("m")).first().m == 2


def test_scan_dialects(spark, tmp_path):
    p = tmp_path / "x.tsv"
    p.write_text("a\tb\nno tab\nc\td\te\n", encoding="utf-8")
    first = [(r.src, r.tgt) for r in text_io.pairs(spark, str(p)).collect()]
    assert first == [("a", "b"), ("c", "d")]
    assert [r.tgt for r in text_io.pairs(spark, str(p), "rest").collect()] == ["b", "d\te"]
    with pytest.raises(Exception, match="not two columns"):
        text_io.pairs(spark, str(p), bad="raise").collect()


def test_indexed_range(spark, tmp_path):
    p = tmp_path / "x.txt"
    p.write_text("zero\n\none\tref\ntwo\nthree\nfour\n", encoding="utf-8")
    got = {r["index"]: r.source for r in text_io.indexed_sources(spark, str(p), 1, 4).collect()}
    assert got == {2: "one", 3: "two", 4: "three"}


def test_torn_shard(spark, tmp_path):
    (tmp_path / "rank-0.jsonl").write_text('{"index": 2, "source": "s", "translation": "t", "status": "ok"}\n{"index": 3, "status": "error"}\n{"index": 4, "sou')
    r = text_io.records(spark, str(tmp_path / "rank-*.jsonl")).cache()
    assert [x["index"] for x in text_io.recovered(r).collect()] == [2]
    with pytest.raises(FileNotFoundError):
        text_io.records(spark, str(tmp_path / "none-*.jsonl"))


def test_failed_write_keeps_the_old_output(spark, tmp_path):
    out = str(tmp_path / "out")
    text_io.replace_atomically(spark.range(3), out)
    bad = spark.range(3).withColumn("x", F.raise_error(F.lit("boom")))
    with pytest.raises(Exception, match="boom"):
        text_io.replace_atomically(bad, out)
    assert spark.read.parquet(out).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["out"]
    text_io.replace_atomically(spark.range(4), out)
    assert spark.read.parquet(out).count() == 4


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a  b", "c"), ("", "x")], "src string, tgt string")
    text_io.write_tsv(d, str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["a b\tc"]
    text_io.write_jsonl(d, str(tmp_path / "j"), 1, True)
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    text_io.append_jsonl(d, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    text_io.write_manifest(spark.createDataFrame([(1,)], "rows int"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().rows == 1
    text_io.write_table_tsv(d, str(tmp_path / "c"))
    u = text_io.ragged_union([spark.createDataFrame([(1,)], "b int"), spark.createDataFrame([(2,)], "a int")])
    assert u.columns == ["a", "b"]


def test_store_goes_stale(spark, tmp_path):
    src, tok = tmp_path / "s.tsv", tmp_path / "tok"
    src.write_text("a\tb\n")
    tok.write_text("t")
    out = str(tmp_path / "store")
    meta = store.metadata(spark, str(src), str(tok), 8)
    with pytest.raises(ValueError):
        store.read(spark, out, meta)
    store.write(spark.createDataFrame([(0, [1, 2])], "pos long, src array<int>"), out, meta)
    assert store.rows(store.read(spark, out, meta), 0, 1).count() == 1
    src.write_text("a\tb\nc\td\n")
    with pytest.raises(ValueError):
        store.read(spark, out, store.metadata(spark, str(src), str(tok), 8))


def test_junit(spark, tmp_path):
    p = tmp_path / "r.xml"
    p.write_text('<testsuite><testcase classname="a" name="b" time="0.5"/><testcase classname="a" name="c" time="1"><failure>x</failure></testcase></testsuite>')
    got = {r.name: r.failed for r in text_io.junit(spark, str(p)).collect()}
    assert got == {"b": False, "c": True}


def test_paired_bootstrap_is_1000_resamples_of_both_metrics(spark):
    import inspect
    import os

    from lexiloom.plans import evaluation as ev

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    # the resampled sums give the scores of the query that SQL checks, and the whole-set scores of chrF++
    s = metrics.resampled_stats(ev.hypotheses(spark, sf), "item_id", 20, 12345).cache()
    got = metrics.bleu(s.where("metric = 'bleu'"), ["system", "sample"]).select("system", "sample", F.round("bleu", 6).alias("bleu"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ev.bootstrap_scores(spark, sf).collect()))
    draws = metrics.bootstrap_draws(ev.hypotheses(spark, sf).select("item_id").distinct(), "item_id", 20, 12345)
    want = ev.chrf_stats(spark, sf, 2).join(draws, "item_id")
    want = want.select("system", "sample", "n", *((F.col(c) * F.col("k")).alias(c) for c in ("matched", "hyp_total", "ref_total")))
    want = want.groupBy("system", "sample", "n").agg(F.sum("matched"), F.sum("hyp_total"), F.sum("ref_total"))
    got = s.where("metric = 'chrf_pp'").select("system", "sample", "n", "matched", "hyp_total", "ref_total")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert inspect.signature(ev.paired_bootstrap).parameters["samples"].default == 1000
    rows = {r.metric: r for r in ev.paired_bootstrap(spark, sf).collect()}
    assert set(rows) == {"bleu", "chrf_pp"} and all(r.mean_diff < 0 < r.half_width for r in rows.values())


def test_damage_within_a_shard_raises(spark, tmp_path):
    ok = lambda i, t: f'{{"index": {i}, "source": "s", "translation": "{t}", "status": "ok"}}\n'
    (tmp_path / "rank-0.jsonl").write_text(ok(1, "a") + '{"index": 2, "sou\n' + ok(3, "b"))
    with pytest.raises(Exception, match="corrupt line within"):
        text_io.recovered(text_io.records(spark, str(tmp_path / "rank-0.jsonl"))).collect()
    # of repeats the first line, also where sorting by content would take another; torn tails only at the ends
    for k in (1, 2):
        (tmp_path / f"part-{k}.jsonl").write_text("".join(ok(i, f"{k}-{9 - n}") for n in range(9) for i in range(40)) + '{"index": 7, "so')
    got = text_io.recovered(text_io.records(spark, str(tmp_path / "part-*.jsonl"))).collect()
    assert {r["index"]: r.translation for r in got} == {i: "1-9" for i in range(40)} and "line" not in got[0]
