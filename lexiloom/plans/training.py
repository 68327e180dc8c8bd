"""Training-data queries: sequences, offsets, batches, masks, one-step search kernels, UDF paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..functions import text as fx
from ..operators import order, shards
from .catalog import query, table

IDS = "[CAST(('0x' || substr(md5(x), 1, 8))::BIGINT % 31996 + 4 AS INTEGER) FOR x IN string_split({0}, ' ') IF x <> '']"
SRC, TGT = "[1] || list_slice({0}, 1, 63)", "([1] || {0})[1:63] || [2]"
ENC = f"""i AS (SELECT pair_id, {IDS.format("coalesce(kk, '')")} AS a, {IDS.format("coalesce(ru, '')")} AS b FROM pairs),
 enc AS (SELECT pair_id, ([1] || a)[1:64] AS src, ([1] || b)[1:63] || [2] AS tgt FROM i)"""


def encoded(spark: SparkSession, sf: str, most: int = 64) -> DataFrame:
    d = table(spark, sf, "pairs").select("pair_id", sq.word_ids(fx.text("kk")).alias("a"), sq.word_ids(fx.text("ru")).alias("b"))
    return d.select("pair_id", sq.with_bos("a", most).alias("src"), sq.with_bos_eos(F.col("b"), most).alias("tgt"))


@query(f"WITH {ENC} SELECT pair_id, src, tgt FROM enc")
def encoded_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return encoded(spark, sf)


@query(f"WITH {ENC} SELECT pair_id, [x FOR x IN tgt IF x NOT IN (0, 1, 2, 3)] AS ids FROM enc")
def decoded_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoded(spark, sf).select("pair_id", sq.decode(F.col("tgt")).alias("ids"))


@query(f"""WITH {ENC} SELECT count(*) AS pairs, CAST(sum(len(src)) AS BIGINT) AS source_tokens, CAST(sum(len(tgt)) AS BIGINT) AS target_tokens, CAST(sum(len(src) + len(tgt)) AS BIGINT) AS tokens,
 CAST(sum(len(tgt)) - count(*) AS BIGINT) AS labels, CAST(sum(len(src)) + sum(len(tgt)) - count(*) AS BIGINT) AS positions FROM enc""")
def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    s, t = F.sum(F.size("src").cast("long")), F.sum(F.size("tgt").cast("long"))
    n = F.count("*")
    return encoded(spark, sf).agg(n.alias("pairs"), s.alias("source_tokens"), t.alias("target_tokens"), (s + t).alias("tokens"), (t - n).alias("labels"), (s + t - n).alias("positions"))


@query(f"WITH i AS (SELECT split, {IDS.format('kk')} AS a FROM eval_pairs) SELECT split, CAST(max(len(a)) AS BIGINT) AS longest, count(*) FILTER (len(a) > 20) AS over FROM i GROUP BY split")
def token_limits(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "eval_pairs").select("split", F.size(sq.word_ids(F.col("kk"))).alias("n"))
    return d.groupBy("split").agg(F.max(F.col("n").cast("long")).alias("longest"), F.count_if(F.col("n") > 20).alias("over"))


@query(f"WITH {ENC} SELECT pair_id, CAST(coalesce(sum(len(src)) OVER (ORDER BY pair_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, len(src)::BIGINT AS n FROM enc")
def token_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Prefix sums of the lengths: inside range partitions, from each one's start."""
    d = encoded(spark, sf).select("pair_id", F.size("src").cast("long").alias("n"))
    return order.running(d, ["pair_id"], F.col("n"), "start").select("pair_id", "start", "n")


@query("SELECT pair_id, row_number() OVER (ORDER BY pair_id) - 1 AS id FROM pairs")
def sequential_ids(spark: SparkSession, sf: str) -> DataFrame:
    return order.running(table(spark, sf, "pairs").select("pair_id"), ["pair_id"], None, "id").select("pair_id", "id")


@query("""WITH p AS (SELECT pair_id, row_number() OVER (ORDER BY pair_id) - 1 AS rn, CASE WHEN coalesce(kk, '') = '' THEN 0 ELSE len(string_split(kk, ' ')) END AS n FROM pairs),
 b AS (SELECT *, rn // 2048 AS bucket FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n, rn) - 1 AS j FROM b) SELECT pair_id, bucket, j // 48 AS batch, j % 48 AS place FROM k""")
def length_batches(spark: SparkSession, sf: str) -> DataFrame:
    d = order.running(table(spark, sf, "pairs").select("pair_id", fx.word_count("kk").alias("n")), ["pair_id"], None, "rn")
    b = shards.length_batches(d, 48, 2048, F.col("n"), "rn")
    return b.select("pair_id", F.col("bucket").cast("long").alias("bucket"), F.col("batch").cast("long").alias("batch"), F.col("place").cast("long").alias("place"))


GLOBAL = f"""{ENC}, r AS (SELECT pair_id, row_number() OVER (ORDER BY len(src) + len(tgt), pair_id) - 1 AS rn, src, tgt FROM enc), g AS (SELECT *, rn // 32 AS batch FROM r),
 f AS (SELECT batch FROM g GROUP BY batch HAVING count(*) = 32)"""


def global_batches(spark: SparkSession, sf: str, size: int = 32) -> DataFrame:
    d = encoded(spark, sf).withColumn("n", F.size("src") + F.size("tgt"))
    d = order.running(d, ["n", "pair_id"], None, "rn").withColumn("batch", F.floor(F.col("rn") / size).cast("long"))
    full = F.count("*").over(Window.partitionBy("batch")) == size
    return d.withColumn("full", full).where("full").drop("full", "rn", "n")


@query(f"WITH {GLOBAL} SELECT pair_id, batch, md5('7:' || batch) AS turn FROM g WHERE batch IN (SELECT batch FROM f)")
def global_length_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches over the whole length order, the last partial one dropped; batches are taken by
    ``turn``, a hash of seed + epoch and batch."""
    return global_batches(spark, sf).select("pair_id", "batch", F.md5(F.concat(F.lit("7:"), F.col("batch").cast("string"))).alias("turn"))


@query(f"""WITH {GLOBAL}, m AS (SELECT *, max(len(src)) OVER (PARTITION BY batch) AS w FROM g WHERE batch IN (SELECT batch FROM f))
 SELECT pair_id, src || [3 FOR i IN range(w - len(src))] AS src, [x <> 3 FOR x IN src || [3 FOR i IN range(w - len(src))]] AS mask, tgt[2:] AS labels FROM m""")
def padded_batches(spark: SparkSession, sf: str) -> DataFrame:
    d = global_batches(spark, sf).withColumn("w", F.max(F.size("src")).over(Window.partitionBy("batch")))
    d = d.withColumn("src", sq.padded(F.col("src"), F.col("w")))
    return d.select("pair_id", "src", sq.mask(F.col("src")).alias("mask"), sq.shifted(F.col("tgt")).alias("labels"))


@query(f"WITH {ENC} SELECT pair_id, len([x FOR x IN tgt IF x <> 3])::BIGINT AS labels, len(src)::BIGINT - 1 AS length_label FROM enc")
def length_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = encoded(spark, sf)
    return d.select("pair_id", sq.label_count(F.col("tgt")).cast("long").alias("labels"), sq.length_label(sq.mask(F.col("src"))).cast("long").alias("length_label"))


@query(f"WITH {ENC} SELECT pair_id, CASE WHEN list_position(tgt, 2) > 0 THEN tgt[1:list_position(tgt, 2)] ELSE tgt END AS ids FROM enc")
def upto_eos(spark: SparkSession, sf: str) -> DataFrame:
    return encoded(spark, sf).select("pair_id", sq.upto_eos(F.col("tgt")).alias("ids"))


DRAWN = f"""{ENC}, dr AS (SELECT pair_id, [('0x' || substr(md5(pair_id || ':' || i), 1, 8))::BIGINT FOR i IN range(1, len(src) + 1)] AS d FROM enc)"""


@query(f"WITH {DRAWN} SELECT pair_id, [x < greatest(644245094, list_min(d) + 1) FOR x IN d] AS mask FROM dr")
def random_mask(spark: SparkSession, sf: str) -> DataFrame:
    return encoded(spark, sf).select("pair_id", sq.random_mask(F.col("pair_id"), F.size("src"), 0.15).alias("mask"))


@query(f"WITH {DRAWN}, x AS (SELECT pair_id, unnest(d) AS c, generate_subscripts(d, 1) AS i FROM dr), r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY c DESC, i) AS rn, count(*) OVER (PARTITION BY pair_id) AS n FROM x) SELECT pair_id, i::INTEGER AS place FROM r WHERE rn <= ceil(n / 4.0)")
def reveal_topk(spark: SparkSession, sf: str) -> DataFrame:
    """One reveal step: of each row the most confident quarter of the places, rounded up."""
    d = encoded(spark, sf).select("pair_id", F.explode(F.sequence(F.lit(1), F.size("src"))).alias("place"))
    c = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("pair_id").cast("string"), F.col("place").cast("string"))), 1, 8), 16, 10).cast("long")
    w = Window.partitionBy("pair_id")
    d = d.withColumn("rn", F.row_number().over(w.orderBy(c.desc(), "place"))).withColumn("n", F.count("*").over(w))
    return d.where(F.col("rn") <= F.ceil(F.col("n") / 4.0)).select("pair_id", "place")


@query("""WITH s AS (SELECT user_id, event_id, coalesce(value, 0) AS score, event_id % 1000 AS cell FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rn FROM s)
 SELECT user_id, rn, cell // 100 AS parent, cell % 100 AS token FROM r WHERE rn <= 5""")
def beam_topk(spark: SparkSession, sf: str) -> DataFrame:
    """One beam step: the five best cells of each group, with their parent and token."""
    d = table(spark, sf, "events").select("user_id", "event_id", F.coalesce("value", F.lit(0.0)).alias("score"), (F.col("event_id") % 1000).alias("cell"))
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "event_id")
    d = d.withColumn("rn", F.row_number().over(w).cast("long")).where("rn <= 5")
    return d.select("user_id", "rn", F.floor(F.col("cell") / 100).cast("long").alias("parent"), (F.col("cell") % 100).alias("token"))


@query("SELECT user_id, arg_max(event_id, coalesce(value, 0) / pow(length(props), 0.6)) AS event_id FROM events WHERE length(props) > 0 GROUP BY user_id")
def beam_best(spark: SparkSession, sf: str) -> DataFrame:
    """Best of each group by score over length to the power 0.6."""
    d = table(spark, sf, "events").where("length(props) > 0")
    return d.groupBy("user_id").agg(F.max_by("event_id", F.coalesce("value", F.lit(0.0)) / F.pow(F.length("props"), F.lit(0.6))).alias("event_id"))


@query("SELECT label, i::INTEGER AS i, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL")
def mean_pooling(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return d.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("SELECT vec_id, round(list_sum([CASE WHEN i % 3 = 0 THEN 0 ELSE x::DOUBLE END FOR x, i IN embedding]) / greatest(len([1 FOR x, i IN embedding IF i % 3 <> 0]), 1), 6) AS mean FROM embeddings")
def masked_mean(spark: SparkSession, sf: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    m = F.transform("embedding", lambda v, i: (i + 1) % 3 != 0)
    return table(spark, sf, "embeddings").select("vec_id", F.round(sq.masked_mean(x, m), 6).alias("mean"))


@query("SELECT pair_id, 0 AS side, coalesce(kk, '') AS line FROM pairs UNION ALL SELECT pair_id, 1, coalesce(ru, '') FROM pairs")
def interleaved_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One line per side, for training a tokenizer elsewhere."""
    return table(spark, sf, "pairs").select("pair_id", F.posexplode(F.array(fx.text("kk"), fx.text("ru"))).alias("side", "line"))


@query("SELECT pair_id, row_number() OVER (ORDER BY length(coalesce(kk, '')) + length(coalesce(ru, '')), pair_id) - 1 AS place FROM pairs")
def char_length_order(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "pairs").select("pair_id", (F.length(fx.text("kk")) + F.length(fx.text("ru"))).alias("n"))
    return order.running(d, ["n", "pair_id"], None, "place").select("pair_id", "place")


@query("SELECT line_index AS index, CASE WHEN contains(source, '№') THEN NULL ELSE upper(source) END AS translation, CASE WHEN contains(source, '№') THEN 'error' ELSE 'ok' END AS status FROM translations")
def retry_map(spark: SparkSession, sf: str) -> DataFrame:
    """A batch function that fails on some rows: only those become errors."""

    def shout(batch: list[str]) -> list[str]:
        if any("№" in x for x in batch):
            raise ValueError("cannot read the number sign")
        return [x.upper() for x in batch]

    d = table(spark, sf, "translations").select(F.col("line_index").alias("index"), "source")
    return shards.map_with_retry(d, shout).select("index", "translation", "status")


@query()
def piece_ids(spark: SparkSession, sf: str) -> DataFrame:
    """A SentencePiece model as the pluggable tokenizer; its path is a parameter."""
    encode = sq.sentencepiece(spark.conf.get("spark.lexiloom.piece", "/opt/tokenizers/piece_bpe_32k.model"))
    return table(spark, sf, "eval_pairs").select("item_id", encode(fx.text("kk")).alias("ids"))


@query("SELECT coalesce(source_file, '') AS name, count(DISTINCT lower(coalesce(text, ''))) AS n FROM mono_docs GROUP BY 1")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents deduplicated as they arrive, per file, compared with a batch count."""
    from ..operators.durable import folder
    from ..streaming import jobs

    schema = spark.read.parquet(f"{sf}/mono_docs.parquet").schema
    s = jobs.source(spark, f"{sf}/mono_docs.parquet*", schema).withColumn("name", F.coalesce("source_file", F.lit("")))
    out = jobs.drain(jobs.deduplicated(s, "text", by=["name"]).select("name"), folder(spark, "stream"))
    return out.groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def stream_runlog(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.durable import folder
    from ..streaming import jobs

    s = jobs.source(spark, f"{sf}/events.parquet*", spark.read.parquet(f"{sf}/events.parquet").schema)
    out = jobs.drain(jobs.run_log(s, "event_type", "value"), folder(spark, "stream"), "complete")
    return out.select("event_type", "n", F.round("total", 4).alias("total"), "least", "most")
