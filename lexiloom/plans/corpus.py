"""Corpus queries: normalise, filter, deduplicate, split, join, merge, validate, sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import dedup, filters, order, shards
from ..sources.text_io import ragged_union
from .catalog import query, table

WS = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+"
ENDS = r"^[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+|[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+$"


def norm_sql(c: str) -> str:
    return rf"trim(regexp_replace(nfc_normalize(regexp_replace(coalesce({c}, ''), '<[^>]+>', ' ', 'g')), '{WS}', ' ', 'g'))"


def plain_sql(c: str) -> str:
    return rf"trim(regexp_replace(nfc_normalize(coalesce({c}, '')), '{WS}', ' ', 'g'))"


def words_sql(c: str) -> str:
    return f"(CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, ' ')) END)"


STATUS = f"""CASE WHEN a = '' OR b = '' THEN 'empty' WHEN a = b THEN 'identical'
 WHEN {words_sql('a')} <= 1 OR {words_sql('b')} <= 1 THEN 'short'
 WHEN {words_sql('a')} > 256 OR {words_sql('b')} > 256 THEN 'long' ELSE 'ok' END"""
NORMED = f"n AS (SELECT pair_id, origin, pos, {norm_sql('kk')} AS a, {norm_sql('ru')} AS b FROM pairs), s AS (SELECT *, {STATUS} AS st FROM n)"
DEDUPED = NORMED + ", d AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY pair_id) AS rn FROM s WHERE st = 'ok')"


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pairs").select("pair_id", "origin", "pos", fx.normalize("kk").alias("src"), fx.normalize("ru").alias("tgt"))
    return p.withColumn("status", filters.pair_status(F.col("src"), F.col("tgt")))


@query(f"""WITH {DEDUPED} SELECT (SELECT count(*) FROM s) AS total, (SELECT count(*) FROM s WHERE st = 'ok') AS after_clean,
 (SELECT count(*) FROM s WHERE st <> 'ok') AS drop_clean, (SELECT count(*) FROM d WHERE rn > 1) AS drop_dup, (SELECT count(*) FROM d WHERE rn = 1) AS kept""")
def filter_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in, kept by cleaning, dropped as copies: counts are combined before the one shuffle."""
    d = cleaned(spark, sf).withColumn("key", F.when(F.col("status") == "ok", fx.pair_md5("src", "tgt")))
    g = d.groupBy("key").agg(F.count("*").alias("n"))
    keyed = F.col("key").isNotNull()
    return g.agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(keyed, F.col("n"))), F.lit(0)).alias("after_clean"),
        F.coalesce(F.sum(F.when(~keyed, F.col("n"))), F.lit(0)).alias("drop_clean"),
        F.coalesce(F.sum(F.when(keyed, F.col("n") - 1)), F.lit(0)).alias("drop_dup"),
        F.count_if(keyed).alias("kept"),
    )


@query(f"WITH {NORMED} SELECT st AS status, count(*) AS n FROM s GROUP BY st")
def clean_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return cleaned(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT pair_id, {norm_sql('kk')} AS kk, {norm_sql('ru')} AS ru FROM pairs")
def html_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pairs").select("pair_id", fx.normalize("kk").alias("kk"), fx.normalize("ru").alias("ru"))


@query(f"SELECT doc_id, {plain_sql('text')} AS text FROM documents")
def nfc_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", fx.normalize_plain("text").alias("text"))


@query(rf"SELECT doc_id, regexp_replace(nfc_normalize(coalesce(text, '')), '{ENDS}', '', 'g') AS text FROM documents")
def audit_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", fx.normalize_audit("text").alias("text"))


@query(f"WITH {NORMED} SELECT CASE WHEN {words_sql('a')} <= 8 THEN 'short' WHEN {words_sql('a')} <= 30 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n FROM s WHERE st = 'ok' GROUP BY 1")
def word_buckets(spark: SparkSession, sf: str) -> DataFrame:
    d = cleaned(spark, sf).where("status = 'ok'")
    return d.groupBy(fx.bucket(fx.word_count("src")).alias("bucket")).agg(F.count("*").alias("n"))


SENT = (
    r"regexp_replace(regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), '\n+', chr(1), 'g'),"
    rf" '([.!?…]){WS}', '\1' || chr(1), 'g'), '([.!?…])([«“\"(A-ZА-ЯӘҒҚҢӨҰҮҺІ])', '\1' || chr(1) || '\2', 'g')"
)
SENTENCES = f"""raw AS (SELECT mono_id, generate_subscripts(x, 1) AS i, unnest(x) AS y FROM (SELECT mono_id, string_split({SENT}, chr(1)) AS x FROM mono_docs)),
 sen AS (SELECT mono_id, i, trim(regexp_replace(y, '{WS}', ' ', 'g')) AS sentence FROM raw WHERE trim(regexp_replace(y, '{WS}', ' ', 'g')) <> ''),
 sent AS (SELECT mono_id, CAST(row_number() OVER (PARTITION BY mono_id ORDER BY i) - 1 AS INTEGER) AS seg, sentence FROM sen)"""


@query(f"WITH {SENTENCES} SELECT * FROM sent")
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.sentence_rows(table(spark, sf, "mono_docs"), "mono_id", "text")


LETTERS = r"length(regexp_replace({0}, '[^\p{{L}}]', '', 'g'))"
IN_SCRIPT = (
    "(length({0}) BETWEEN 20 AND 1000 AND NOT contains({0}, 'http://') AND NOT contains({0}, 'https://') AND " + LETTERS + " >= 3"
    " AND length(regexp_replace(lower({0}), '[^әғқңөұүһі]', '', 'g')) > 0"
    " AND length(regexp_replace(lower({0}), '[^абвгдеёжзийклмнопрстуфхцчшщъыьэюя]', '', 'g')) + length(regexp_replace(lower({0}), '[^әғқңөұүһі]', '', 'g')) >= greatest(3, " + LETTERS + " // 2))"
)


@query(f"WITH {SENTENCES} SELECT mono_id, seg, sentence FROM sent WHERE {IN_SCRIPT.format('sentence')}")
def script_filter(spark: SparkSession, sf: str) -> DataFrame:
    return sentence_split(spark, sf).where(fx.in_script("sentence"))


@query(r"SELECT source, count(*) AS n_docs, CAST(sum(len(regexp_extract_all(coalesce(text, ''), 'https?://'))) AS BIGINT) AS n_urls, CAST(sum(length(regexp_replace(coalesce(text, ''), '[^\p{L}]', '', 'g'))) AS BIGINT) AS n_letters FROM documents GROUP BY source")
def url_filter(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "documents").groupBy("source")
    return g.agg(F.count("*").alias("n_docs"), F.sum(fx.url_count("text")).alias("n_urls"), F.sum(fx.letter_count("text").cast("long")).alias("n_letters"))


@query("""SELECT pair_id, md5(coalesce(kk, '') || chr(9) || coalesce(ru, '')) AS md5, sha256(coalesce(kk, '') || chr(0) || coalesce(ru, '')) AS sha256,
 sha256(lower(coalesce(kk, ''))) AS sentence_key FROM pairs""")
def pair_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pairs").select("pair_id", fx.pair_md5("kk", "ru").alias("md5"), fx.pair_sha256("kk", "ru").alias("sha256"), F.lower(F.hex(fx.sentence_key("kk"))).alias("sentence_key"))


@query("SELECT coalesce(predicted_language, 'kaz') = 'kaz' AS kept, count(*) AS n FROM mono_docs GROUP BY 1")
def language_gate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "mono_docs").groupBy(filters.language_gate("predicted_language").alias("kept")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE lang = 'kk'")
def classifier_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Label gate with a pluggable classifier; the stand-in repeats the stored label."""
    label = filters.classifier(lambda xs: xs)
    return table(spark, sf, "documents").where(label(F.coalesce("lang", F.lit(""))) == "kk").select("doc_id")


@query(f"WITH {DEDUPED} SELECT pair_id FROM d WHERE rn = 1")
def pair_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.pair_dedup(cleaned(spark, sf).where("status = 'ok'").select("pair_id", "src", "tgt"), ["pair_id"]).select("pair_id")


@query(f"WITH {DEDUPED} SELECT origin, count(*) AS n FROM d WHERE rn = 1 GROUP BY origin")
def kept_by_source(spark: SparkSession, sf: str) -> DataFrame:
    d = dedup.pair_dedup(cleaned(spark, sf).where("status = 'ok'").select("pair_id", "origin", "src", "tgt"), ["pair_id"])
    return d.groupBy("origin").agg(F.count("*").alias("n")).orderBy("origin")


SEEDED = (
    f"{SENTENCES}, seed AS (SELECT DISTINCT lower({plain_sql('kk')}) AS k FROM pairs UNION SELECT DISTINCT lower({plain_sql('kk')}) FROM eval_pairs),"
    f" cand AS (SELECT mono_id, seg, sentence FROM sent WHERE {IN_SCRIPT.format('sentence')}),"
    " fresh AS (SELECT *, row_number() OVER (PARTITION BY lower(sentence) ORDER BY mono_id, seg) AS rn FROM cand WHERE lower(sentence) NOT IN (SELECT k FROM seed))"
)


@query(f"WITH {SEEDED} SELECT mono_id, seg, sentence FROM fresh WHERE rn = 1")
def sentence_dedup_seeded(spark: SparkSession, sf: str) -> DataFrame:
    seeds = table(spark, sf, "pairs").select("kk").union(table(spark, sf, "eval_pairs").select("kk")).select(fx.normalize_plain("kk").alias("sentence"))
    return dedup.seeded_dedup(script_filter(spark, sf), seeds, ["mono_id", "seg"])


@query(f"WITH {SEEDED} SELECT (SELECT count(*) FROM mono_docs) AS documents, (SELECT count(*) FROM cand) AS candidates, (SELECT count(*) FROM fresh WHERE rn = 1) AS written")
def extraction_stats(spark: SparkSession, sf: str) -> DataFrame:
    kinds = [
        table(spark, sf, "mono_docs").select(F.lit("documents").alias("k")),
        script_filter(spark, sf).select(F.lit("candidates").alias("k")),
        sentence_dedup_seeded(spark, sf).select(F.lit("written").alias("k")),
    ]
    u = kinds[0].unionAll(kinds[1]).unionAll(kinds[2])
    return u.agg(*[F.count_if(F.col("k") == x).alias(x) for x in ("documents", "candidates", "written")])


@query(f"WITH {SEEDED} SELECT mono_id, seg, sentence FROM fresh WHERE rn = 1 ORDER BY mono_id, seg LIMIT 1000")
def first_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The first 1000 sentences written, in document order: the limit is the operator."""
    return sentence_dedup_seeded(spark, sf).orderBy("mono_id", "seg").limit(1000)


PRIORITY = """CASE WHEN split = 'dev' THEN 0 WHEN split = 'devtest' THEN 10 WHEN split LIKE 'gold%' THEN 20 ELSE 30 END
 + CASE WHEN split LIKE '%short' THEN 1 WHEN split LIKE '%medium' THEN 2 WHEN split LIKE '%long' THEN 3 ELSE 0 END"""
CANDIDATES = f"""e AS (SELECT item_id, split, lower({plain_sql('kk')}) AS k, {PRIORITY} AS p FROM eval_pairs),
 c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, item_id) AS rn FROM e WHERE k <> '')"""


def priority():
    """Order of splits: dev, devtest, gold, others; of these the short, medium and long parts."""
    s = F.col("split")
    kind = F.when(s == "dev", 0).when(s == "devtest", 10).when(s.startswith("gold"), 20).otherwise(30)
    return kind + F.when(s.endswith("short"), 1).when(s.endswith("medium"), 2).when(s.endswith("long"), 3).otherwise(0)


def candidates(items: DataFrame) -> DataFrame:
    """(item_id, split, p): the first item of each text in the order of splits; empty texts are out."""
    d = items.select("item_id", "split", F.lower(fx.normalize_plain("kk")).alias("k"), priority().alias("p")).where("k <> ''")
    return dedup.keep_first(d, ["k"], ["p", "item_id"]).select("item_id", "split", "p")


def numbered_candidates(items: DataFrame) -> DataFrame:
    """(item_id, code): the split and the item's number, from 0, in the whole output."""
    d = order.running(candidates(items), ["p", "item_id"], None, "n")
    return d.select("item_id", fx.numbered(F.col("split"), F.col("n")).alias("code"))


@query(f"WITH {CANDIDATES} SELECT item_id, split FROM c WHERE rn = 1")
def priority_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(table(spark, sf, "eval_pairs")).select("item_id", "split")


@query(f"WITH {CANDIDATES} SELECT item_id, printf('%s-%05d', split, row_number() OVER (ORDER BY p, item_id) - 1) AS code FROM c WHERE rn = 1")
def benchmark_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return numbered_candidates(table(spark, sf, "eval_pairs"))


@query("SELECT split, category, count(*) AS n FROM eval_pairs GROUP BY split, category")
def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_pairs").groupBy("split", "category").agg(F.count("*").alias("n"))


SAMPLE = f"""b AS (SELECT pair_id, CASE WHEN {words_sql('a')} <= 8 THEN 'short' WHEN {words_sql('a')} <= 30 THEN 'medium' ELSE 'long' END AS bucket FROM s WHERE st = 'ok'),
 r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('42:' || pair_id), pair_id) AS rn FROM b)"""


@query(f"WITH {NORMED}, {SAMPLE} SELECT pair_id, bucket FROM r WHERE rn <= CASE bucket WHEN 'long' THEN 34 ELSE 33 END")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """100 rows, a third of each length bucket, the rest long: the lowest hashes of each
    bucket, uniform without replacement and the same at every partitioning."""
    d = cleaned(spark, sf).where("status = 'ok'").select("pair_id", fx.bucket(fx.word_count("src")).alias("bucket"))
    w = Window.partitionBy("bucket").orderBy(F.md5(F.concat(F.lit("42:"), F.col("pair_id").cast("string"))), "pair_id")
    d = d.withColumn("rn", F.row_number().over(w)).where("rn <= 34")
    return d.where(F.col("rn") <= F.when(F.col("bucket") == "long", 34).otherwise(33)).select("pair_id", "bucket")


# translation records: index = line_index
RECORDS = "rec AS (SELECT record_id, line_index, source, translation, status FROM translations)"


@query("SELECT line_index, min(record_id) AS record_id FROM translations WHERE status = 'ok' GROUP BY line_index")
def shard_compaction(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "translations").select("record_id", "line_index", "status")
    return shards.compacted(d, ["record_id"], "line_index").select("line_index", "record_id")


@query("SELECT line_index, count(*) AS n FROM translations WHERE status = 'ok' GROUP BY line_index HAVING count(*) > 1")
def duplicate_index(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.duplicate_keys(table(spark, sf, "translations").where("status = 'ok'"), "line_index")


EXPECT = f"exp AS (SELECT pair_id AS line_index, regexp_replace(coalesce(kk, ''), '{ENDS}', '', 'g') AS want FROM pairs WHERE regexp_replace(coalesce(kk, ''), '{ENDS}', '', 'g') <> '')"


def expected(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pairs").select(F.col("pair_id").alias("line_index"), fx.strip("kk").alias("source")).where("source <> ''")


@query(f"""WITH {EXPECT}, j AS (SELECT t.line_index, e.line_index IS NOT NULL AS there, e.line_index IS NOT NULL AND coalesce(t.status = 'ok', false) AS good, want,
  regexp_replace(coalesce(t.source, ''), '{ENDS}', '', 'g') AS s, regexp_replace(coalesce(t.translation, ''), '{ENDS}', '', 'g') AS o FROM translations t LEFT JOIN exp e USING (line_index)),
 m AS (SELECT count(*) AS missing, min(line_index) AS first_missing FROM exp WHERE line_index NOT IN (SELECT line_index FROM translations WHERE line_index IS NOT NULL)),
 k AS (SELECT (SELECT count(*) FROM exp) AS expected, count(*) AS records, count(*) FILTER (NOT there) AS out_of_range, count(*) FILTER (there AND s <> want) AS source_mismatch,
  count(*) FILTER (there AND NOT good) AS errors, count(*) FILTER (good) AS ok, count(*) FILTER (good AND o = '') AS empty, count(*) FILTER (good AND s <> '' AND s = o) AS same,
  count(*) FILTER (there) - count(DISTINCT line_index) FILTER (there) AS duplicate, count(DISTINCT line_index) FILTER (there) AS unique_indexes, any_value(missing) AS missing, any_value(first_missing) AS first_missing FROM j, m)
 SELECT *, out_of_range + source_mismatch + errors + empty + same + duplicate + missing = 0 AND records = expected AND ok = expected AND unique_indexes = expected AS valid FROM k""")
def shard_validation(spark: SparkSession, sf: str) -> DataFrame:
    return shards.validation(table(spark, sf, "translations"), expected(spark, sf), "line_index")


@query(f"WITH {EXPECT} SELECT line_index FROM exp WHERE line_index NOT IN (SELECT line_index FROM translations WHERE status = 'ok' AND line_index IS NOT NULL)")
def resume_remaining(spark: SparkSession, sf: str) -> DataFrame:
    return shards.remaining(expected(spark, sf), table(spark, sf, "translations").where("status = 'ok'"), "line_index").select("line_index")


@query("""WITH r AS (SELECT max(line_index) AS hi FROM translations) SELECT CAST(range AS BIGINT) AS line_index FROM range(1, (SELECT hi + 1 FROM r)) WHERE range NOT IN (SELECT line_index FROM translations)""")
def missing_indices(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps of the running index, from each index to its successor."""
    t = table(spark, sf, "translations").select("line_index").distinct().union(spark.createDataFrame([(0,)], "line_index bigint")).distinct()
    w = Window.partitionBy(F.floor(F.col("line_index") / 65536)).orderBy("line_index")
    block = F.floor(F.col("line_index") / 65536)
    edges = t.groupBy(block.alias("b")).agg(F.max("line_index").alias("last"))
    last = order.running(edges.select("b", "last"), ["b"], None, "k").select("k", "last")
    first = t.groupBy(block.alias("b")).agg(F.min("line_index").alias("first"))
    nxt = order.running(first, ["b"], None, "k").select((F.col("k") - 1).alias("k"), "first")
    gaps = t.withColumn("next", F.lead("line_index").over(w)).where("next > line_index + 1").select("line_index", "next")
    gaps = gaps.unionByName(last.join(nxt, "k").select(F.col("last").alias("line_index"), F.col("first").alias("next")).where("next > line_index + 1"))
    return gaps.select(F.explode(F.sequence(F.col("line_index") + 1, F.col("next") - 1)).alias("line_index"))


@query("SELECT line_index % 8 AS rank, count(*) AS n FROM translations GROUP BY 1")
def rank_shards(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "translations").groupBy((F.col("line_index") % 8).alias("rank")).agg(F.count("*").alias("n"))


@query("SELECT record_id FROM translations WHERE line_index >= 10 AND line_index < 110 AND line_index % 4 = 1")
def shard_range(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("line_index")
    return table(spark, sf, "translations").where(filters.in_range(i, 10, 100) & filters.in_shard(i, 4, 1)).select("record_id")


PUB = rf"p AS (SELECT *, regexp_replace(coalesce(source, ''), '{ENDS}', '', 'g') AS s2, regexp_replace(coalesce(translation, ''), '{ENDS}', '', 'g') AS t2 FROM translations)"


@query(f"WITH {PUB} SELECT record_id, source, translation FROM p WHERE status = 'ok' AND s2 <> '' AND t2 <> '' AND s2 <> t2")
def publish_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.publishable(table(spark, sf, "translations")).select("record_id", "source", "translation")


@query(f"WITH {PUB} SELECT count(DISTINCT shard) AS files, count(*) AS input, count(*) FILTER (status = 'ok' AND s2 <> '' AND t2 <> '' AND s2 <> t2) AS written, count(*) FILTER (NOT coalesce(status = 'ok' AND s2 <> '' AND t2 <> '' AND s2 <> t2, false)) AS skipped FROM p")
def publish_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "translations")
    good = filters.publishable(t).select("shard", F.lit(1).alias("w"))
    u = t.select("shard", F.lit(0).alias("w")).unionAll(good)
    a = u.agg(F.count_distinct("shard").alias("files"), F.count_if(F.col("w") == 0).alias("input"), F.count_if(F.col("w") == 1).alias("written"))
    return a.withColumn("skipped", F.col("input") - F.col("written"))


MERGE = f"""base AS (SELECT 0 AS pri, pair_id AS k, {plain_sql('kk')} AS a, {plain_sql('ru')} AS b FROM pairs),
 syn AS (SELECT 1 AS pri, record_id AS k, {plain_sql('source')} AS a, {plain_sql('translation')} AS b FROM translations WHERE coalesce(status, '') = 'ok'),
 u AS (SELECT * FROM base UNION ALL SELECT * FROM syn), v AS (SELECT *, a <> '' AND b <> '' AND a <> b AS fit FROM u),
 w AS (SELECT *, row_number() OVER (PARTITION BY fit, a, b ORDER BY pri, k) AS rn FROM v)"""


def merged(spark: SparkSession, sf: str) -> DataFrame:
    """Base and ok records with (fit, first): whether the pair is valid and the first of its kind."""
    base = table(spark, sf, "pairs").select(F.lit(0).alias("pri"), F.col("pair_id").alias("k"), "kk", "ru")
    syn = filters.error_gate(table(spark, sf, "translations"), skip=True).select(F.lit(1).alias("pri"), F.col("record_id").alias("k"), F.col("source").alias("kk"), F.col("translation").alias("ru"))
    u = base.unionByName(syn).select("pri", "k", fx.normalize_plain("kk").alias("src"), fx.normalize_plain("ru").alias("tgt"))
    u = u.withColumn("fit", filters.merge_valid(F.col("src"), F.col("tgt")))
    return u.withColumn("key", F.when(F.col("fit"), fx.pair_sha256("src", "tgt")))


@query(f"WITH {MERGE} SELECT pri, k FROM w WHERE fit AND rn = 1")
def merged_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.keep_first(merged(spark, sf).where("fit").select("pri", "k", "key"), ["key"], ["pri", "k"]).select("pri", "k")


@query(f"""WITH {MERGE} SELECT count(*) FILTER (pri = 0) AS base_rows, (SELECT count(*) FROM translations) AS translation_rows, count(*) FILTER (fit AND rn = 1) AS written,
 count(*) FILTER (fit AND rn > 1) AS duplicates, count(*) FILTER (NOT fit) AS dropped_invalid_pairs, (SELECT count(*) FROM translations WHERE coalesce(status, '') <> 'ok') AS translation_errors FROM w""")
def merge_stats(spark: SparkSession, sf: str) -> DataFrame:
    m = merged(spark, sf).groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("pri") == 0).alias("b"))
    e = table(spark, sf, "translations").agg(F.count("*").alias("t"), F.count_if(F.coalesce(F.col("status") != "ok", F.lit(True))).alias("e"))
    u = m.select("n", "b", F.col("key").isNotNull().alias("fit")).unionByName(e, allowMissingColumns=True)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return u.agg(
        zero(F.sum("b")).alias("base_rows"),
        zero(F.sum("t")).alias("translation_rows"),
        F.count_if(F.col("fit")).alias("written"),
        zero(F.sum(F.when(F.col("fit"), F.col("n") - 1))).alias("duplicates"),
        zero(F.sum(F.when(~F.col("fit"), F.col("n")))).alias("dropped_invalid_pairs"),
        zero(F.sum("e")).alias("translation_errors"),
    )


@query("SELECT count(DISTINCT coalesce(kk, '')) AS unique_source, count(DISTINCT coalesce(kk, '') || chr(9) || coalesce(ru, '')) AS unique_pair FROM pairs")
def unique_counts(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.distinct_counts(table(spark, sf, "pairs"), "kk", "ru")


def audit_sql(c: str) -> str:
    return rf"regexp_replace(nfc_normalize(coalesce({c}, '')), '{ENDS}', '', 'g')"


@query(f"""WITH c AS (SELECT DISTINCT origin, {audit_sql('kk')} AS a, {audit_sql('ru')} AS b FROM pairs), e AS (SELECT DISTINCT split, {audit_sql('kk')} AS a, {audit_sql('ru')} AS b FROM eval_pairs)
 SELECT origin, split, count(DISTINCT c.a) AS n_source, count(DISTINCT c.a || chr(9) || c.b) FILTER (c.b = e.b) AS n_pair FROM c JOIN e ON c.a = e.a GROUP BY origin, split""")
def overlap_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct sources and pairs of each origin that stand in each evaluation split, exactly."""
    side = lambda t, c: table(spark, sf, t).select(c, fx.normalize_audit("kk").alias("a"), fx.normalize_audit("ru").alias("b")).distinct()
    c, e = side("pairs", "origin"), side("eval_pairs", "split").withColumnRenamed("b", "eb")
    g = c.join(e, "a").groupBy("origin", "split")
    return g.agg(F.count_distinct("a").alias("n_source"), F.count_distinct(F.when(F.col("b") == F.col("eb"), fx.pair_md5("a", "b"))).alias("n_pair"))


@query(f"SELECT DISTINCT {audit_sql('kk')} AS a FROM pairs INTERSECT SELECT DISTINCT {audit_sql('kk')} FROM eval_pairs")
def overlap_intersect(spark: SparkSession, sf: str) -> DataFrame:
    a = lambda t: table(spark, sf, t).select(fx.normalize_audit("kk").alias("a"))
    return a("pairs").intersect(a("eval_pairs"))


@query("SELECT pair_id AS line_index FROM pairs EXCEPT SELECT line_index FROM translations WHERE status = 'ok'")
def index_except(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "translations").where("status = 'ok'").select("line_index")
    return table(spark, sf, "pairs").select(F.col("pair_id").alias("line_index")).subtract(done)


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY item_id) AS i, kk FROM eval_pairs WHERE split = 'dev'), b AS (SELECT row_number() OVER (ORDER BY item_id) AS i, ru FROM eval_pairs WHERE split = 'devtest')
 SELECT CAST(i - 1 AS BIGINT) AS i, kk, ru FROM a JOIN b USING (i)""")
def positional_zip(spark: SparkSession, sf: str) -> DataFrame:
    """Two ordered tables side by side; the longer one is cut."""
    side = lambda split, c: order.running(table(spark, sf, "eval_pairs").where(F.col("split") == split).select("item_id", c), ["item_id"], None, "i").select("i", c)
    return side("dev", "kk").join(side("devtest", "ru"), "i")


@query("""SELECT 'documents' AS relation, count(*) AS rows, NULL::BIGINT AS pairs, count(DISTINCT source) AS sources FROM documents
 UNION ALL SELECT 'pairs', count(*), count(DISTINCT md5(coalesce(kk, '') || chr(9) || coalesce(ru, ''))), NULL FROM pairs""")
def ragged_tables(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").agg(F.lit("documents").alias("relation"), F.count("*").alias("rows"), F.count_distinct("source").alias("sources"))
    p = table(spark, sf, "pairs").agg(F.lit("pairs").alias("relation"), F.count("*").alias("rows"), F.count_distinct(fx.pair_md5("kk", "ru")).alias("pairs"))
    return ragged_union([d, p])


@query("SELECT origin AS name, kk AS text FROM pairs UNION ALL SELECT source_file, text FROM mono_docs UNION ALL SELECT source, text FROM documents")
def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "pairs").select(F.col("origin").alias("name"), F.col("kk").alias("text"))
    b = table(spark, sf, "mono_docs").select(F.col("source_file").alias("name"), "text")
    return a.unionByName(b).unionByName(table(spark, sf, "documents").select(F.col("source").alias("name"), "text"))


@query("""SELECT v.vec_id AS a, w.vec_id AS b FROM embeddings v JOIN embeddings w ON w.vec_id = v.vec_id + 1
 WHERE list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(v.embedding, w.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), lambda s, x: s + x) >= 0.05""")
def embedding_align(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return filters.aligned(e.join(n, "vec_id"), "embedding", "next", 0.05).select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
