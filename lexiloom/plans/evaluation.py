"""Evaluation queries: alignment checks, metrics, bootstrap, leaderboards, logs.

Hypotheses of two systems are derived from the evaluation references: ``a`` drops every
fifth word, ``b`` every seventh.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import filters, metrics, order
from ..operators.durable import written
from .catalog import query, table

REFS = "ref AS (SELECT item_id, split, string_split(ru, ' ') AS w FROM eval_pairs WHERE coalesce(ru, '') <> '')"
HYPS = (
    REFS + ", hyp AS (SELECT item_id, split, s.system, [x FOR x, i IN w IF i % s.step <> 0] AS h, w AS r FROM ref, (VALUES ('a', 5), ('b', 7)) s(system, step))"
)


def hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, split, system, h, r): words of hypothesis and reference."""
    d = table(spark, sf, "eval_pairs").where(fx.text("ru") != "").select("item_id", "split", F.split("ru", " ").alias("r"))
    systems = F.explode(F.array(*[F.struct(F.lit(s).alias("system"), F.lit(k).alias("step")) for s, k in (("a", 5), ("b", 7))]))
    d = d.withColumn("s", systems)
    h = F.filter("r", lambda x, i: (i + 1) % F.col("s.step") != 0)
    return d.select("item_id", "split", "s.system", h.alias("h"), "r")


def word_stats(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.gram_rows(hypotheses(spark, sf), ["item_id", "system"], F.col("h"), F.col("r"), metrics.ORDERS)


GRAMS = f"""{HYPS}, o AS (SELECT CAST(range AS INTEGER) AS n FROM range(1, 5)),
 g AS (SELECT item_id, system, n, 0 AS s, unnest([array_to_string(h[i : i + n - 1], ' ') FOR i IN range(1, len(h) - n + 2)]) AS g FROM hyp, o UNION ALL
  SELECT item_id, system, n, 1, unnest([array_to_string(r[i : i + n - 1], ' ') FOR i IN range(1, len(r) - n + 2)]) FROM hyp, o),
 c AS (SELECT item_id, system, n, g, count(*) FILTER (s = 0) AS h, count(*) FILTER (s = 1) AS r FROM g GROUP BY ALL),
 st AS (SELECT item_id, system, n, sum(least(h, r)) AS m, sum(h) AS h, sum(r) AS r FROM c GROUP BY ALL)"""
BLEU = """t AS (SELECT {0}, n, sum(m * k) AS m, sum(h * k) AS h, sum(r * k) AS r FROM {1} GROUP BY ALL),
 z AS (SELECT *, CASE WHEN m > 0 THEN ln(100.0 * m / h) WHEN h > 0 THEN ln(100.0 / (pow(2, sum(CASE WHEN m = 0 AND h > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {0} ORDER BY n)) * h)) END AS l FROM t),
 bl AS (SELECT {0}, coalesce(CASE WHEN count(l) = 4 THEN exp(avg(l)) * CASE WHEN max(h) FILTER (n = 1) >= max(r) FILTER (n = 1) THEN 1 ELSE exp(1 - max(r) FILTER (n = 1) / max(h) FILTER (n = 1)) END END, 0) AS bleu FROM z GROUP BY {0})"""


@query(f"WITH {GRAMS}, st1 AS (SELECT *, 1 AS k FROM st), {BLEU.format('system', 'st1')} SELECT system, round(bleu, 6) AS bleu FROM bl")
def bleu(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.bleu(word_stats(spark, sf), ["system"]).select("system", F.round("bleu", 6).alias("bleu"))


def char_grams(words: int) -> str:
    return f"""{HYPS}, x AS (SELECT item_id, system, string_split(regexp_replace(array_to_string(h, ' '), '[\\s\\p{{Z}}]+', '', 'g'), '') AS h, string_split(regexp_replace(array_to_string(r, ' '), '[\\s\\p{{Z}}]+', '', 'g'), '') AS r, h AS hw, r AS rw FROM hyp),
 o AS (SELECT CAST(range AS INTEGER) AS n FROM range(1, 7)), ow AS (SELECT CAST(range AS INTEGER) AS n FROM range(1, {words + 1})),
 g AS (SELECT item_id, system, n, 0 AS s, unnest([array_to_string(h[i : i + n - 1], '') FOR i IN range(1, len(h) - n + 2)]) AS g FROM x, o UNION ALL
  SELECT item_id, system, n, 1, unnest([array_to_string(r[i : i + n - 1], '') FOR i IN range(1, len(r) - n + 2)]) FROM x, o UNION ALL
  SELECT item_id, system, 10 + n, 0, unnest([array_to_string(hw[i : i + n - 1], ' ') FOR i IN range(1, len(hw) - n + 2)]) FROM x, ow UNION ALL
  SELECT item_id, system, 10 + n, 1, unnest([array_to_string(rw[i : i + n - 1], ' ') FOR i IN range(1, len(rw) - n + 2)]) FROM x, ow),
 c AS (SELECT item_id, system, n, g, count(*) FILTER (s = 0) AS h, count(*) FILTER (s = 1) AS r FROM g GROUP BY ALL),
 t AS (SELECT system, n, sum(least(h, r)) AS m, sum(h) AS h, sum(r) AS r FROM c GROUP BY ALL HAVING sum(h) > 0 AND sum(r) > 0),
 f AS (SELECT system, CASE WHEN m = 0 THEN 0 ELSE 5 * (m / h) * (m / r) / (4 * (m / h) + m / r) END AS f FROM t)"""


def chrf_stats(spark: SparkSession, sf: str, words: int) -> DataFrame:
    h = hypotheses(spark, sf)
    c = metrics.gram_rows(h, ["item_id", "system"], metrics.chars(F.array_join("h", " ")), metrics.chars(F.array_join("r", " ")), metrics.CHARS)
    if words:
        w = metrics.gram_rows(h, ["item_id", "system"], F.col("h"), F.col("r"), words)
        c = c.unionByName(w.withColumn("n", F.col("n") + 10))
    return c


@query(f"WITH {char_grams(0)} SELECT system, round(100 * avg(f), 6) AS chrf FROM f GROUP BY system")
def chrf(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.f_score(chrf_stats(spark, sf, 0), ["system"], "chrf").select("system", F.round("chrf", 6).alias("chrf"))


@query(f"WITH {char_grams(2)} SELECT system, round(100 * avg(f), 6) AS chrf_pp FROM f GROUP BY system")
def chrf_pp(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.f_score(chrf_stats(spark, sf, 2), ["system"], "chrf_pp").select("system", F.round("chrf_pp", 6).alias("chrf_pp"))


@query()
def ter(spark: SparkSession, sf: str) -> DataFrame:
    """Translation edit rate; the shift search has no SQL, tests pin it."""
    d = hypotheses(spark, sf).select("system", F.array_join("h", " ").alias("h"), F.array_join("r", " ").alias("r"))
    return metrics.ter(d, ["system"], "h", "r")


def tokens_13a_sql(c: str) -> str:
    for x, y in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = f"replace({c}, '{x}', '{y}')"
    c = f"(' ' || {c} || ' ')"
    for x, y in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        c = f"regexp_replace({c}, '{x}', '{y}', 'g')"
    return f"[w FOR w IN string_split_regex({c}, '\\s+') IF w <> '']"


H13, R13 = (tokens_13a_sql(f"array_to_string({c}, ' ')") for c in "hr")
GRAMS_13A = GRAMS.replace(" o AS (", f" hyp0 AS (SELECT item_id, split, system, {H13} AS h, {R13} AS r FROM hyp), o AS (", 1).replace("FROM hyp, o", "FROM hyp0, o")


@query(f"WITH {GRAMS_13A}, st1 AS (SELECT *, 1 AS k FROM st), {BLEU.format('system', 'st1')} SELECT system, round(bleu, 6) AS bleu FROM bl")
def bleu_13a(spark: SparkSession, sf: str) -> DataFrame:
    """BLEU over the 13a tokens of the joined texts."""
    h = hypotheses(spark, sf)
    s = metrics.gram_rows(h, ["item_id", "system"], metrics.tokens_13a(F.array_join("h", " ")), metrics.tokens_13a(F.array_join("r", " ")), metrics.ORDERS)
    return metrics.bleu(s, ["system"]).select("system", F.round("bleu", 6).alias("bleu"))


@query(f"""WITH b AS (WITH {GRAMS}, st1 AS (SELECT *, 1 AS k FROM st), {BLEU.format('system', 'st1')} SELECT system, round(bleu, 6) AS score FROM bl),
 c AS (WITH {char_grams(2)} SELECT system, round(100 * avg(f), 6) AS score FROM f GROUP BY system)
 SELECT 'bleu' AS metric, round(x.score - y.score, 6) AS delta FROM b x, b y WHERE x.system = 'a' AND y.system = 'b' UNION ALL
 SELECT 'chrf_pp', round(x.score - y.score, 6) FROM c x, c y WHERE x.system = 'a' AND y.system = 'b'""")
def metric_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """How much better system a scores than b, by metric."""
    d = bleu(spark, sf).join(chrf_pp(spark, sf), "system")
    return metrics.deltas(d, "a", "b", ["bleu", "chrf_pp"]).select("metric", F.round("delta", 6).alias("delta"))


@query()
def ter_delta(spark: SparkSession, sf: str) -> DataFrame:
    """The same of TER, where less is better."""
    return metrics.deltas(ter(spark, sf), "a", "b", ["ter"])


@query(f"WITH {HYPS} SELECT system, round(sum(len(h)) / sum(len(r)), 9) AS ratio, count(*) FILTER (len(h) = 0) AS empty FROM hyp GROUP BY system")
def length_ratio(spark: SparkSession, sf: str) -> DataFrame:
    g = hypotheses(spark, sf).groupBy("system")
    return g.agg(F.round(F.sum(F.size("h")) / F.sum(F.size("r")), 9).alias("ratio"), F.count_if(F.size("h") == 0).alias("empty"))


DRAW = """d AS (SELECT CAST(range AS INTEGER) AS sample, item_id, CAST('0x' || substr(md5('12345:' || range || ':' || item_id), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM range(1, 21), (SELECT DISTINCT item_id FROM st)),
 e AS (SELECT sample, item_id, (u >= 0.36787944117144233)::INT + (u >= 0.7357588823428847)::INT + (u >= 0.9196986029286058)::INT + (u >= 0.9810118431238462)::INT + (u >= 0.9963401531726563)::INT + (u >= 0.9994058151824183)::INT + (u >= 0.9999167588507119)::INT + (u >= 0.9999897508033253)::INT AS k FROM d)"""


@query(f"WITH {GRAMS}, {DRAW}, st2 AS (SELECT st.*, sample, k FROM st JOIN e USING (item_id)), {BLEU.format('system, sample', 'st2')} SELECT system, sample, round(bleu, 6) AS bleu FROM bl")
def bootstrap_scores(spark: SparkSession, sf: str, samples: int = 20) -> DataFrame:
    """BLEU of each resample: rows' statistics times hash-drawn multiplicities."""
    s = word_stats(spark, sf)
    draws = metrics.bootstrap_draws(s.select("item_id").distinct(), "item_id", samples, 12345)
    d = s.join(draws, "item_id")
    for c in ("matched", "hyp_total", "ref_total"):
        d = d.withColumn(c, F.col(c) * F.col("k"))
    return metrics.bleu(d, ["system", "sample"]).select("system", "sample", F.round("bleu", 6).alias("bleu"))


@query()
def paired_bootstrap(spark: SparkSession, sf: str, samples: int = 1000) -> DataFrame:
    """Mean, half width of the 95 % interval and p of system a against b, by BLEU and by chrF++."""
    s = written(metrics.resampled_stats(hypotheses(spark, sf), "item_id", samples, 12345))
    by = ["system", "sample"]
    bleu = metrics.bleu(s.where("metric = 'bleu'"), by).select(*by, F.lit("bleu").alias("metric"), F.round("bleu", 6).alias("score"))
    chrf = metrics.f_score(s.where("metric = 'chrf_pp'"), by, "score").select(*by, F.lit("chrf_pp").alias("metric"), F.round("score", 6).alias("score"))
    d = bleu.unionAll(chrf)
    b = d.where("system = 'b'").select("metric", "sample", F.col("score").alias("base"))
    j = d.where("system = 'a'").join(b, ["metric", "sample"]).withColumn("diff", F.col("score") - F.col("base"))
    m = j.groupBy("metric").agg(F.avg("diff").alias("mean_diff"), F.stddev("diff").alias("sd"), F.count_if(F.col("diff") <= 0).alias("c"), F.count("*").alias("n"))
    return m.select("metric", F.round("mean_diff", 4).alias("mean_diff"), F.round(1.96 * F.col("sd"), 4).alias("half_width"), F.round((F.col("c") + 1) / (F.col("n") + 1), 6).alias("p"))


@query("""WITH t AS (SELECT line_index, min(record_id) AS record_id FROM translations WHERE status = 'ok' GROUP BY line_index), h AS (SELECT x.* FROM translations x JOIN t USING (record_id))
 SELECT count(*) AS rows, count(*) FILTER (h.line_index IS NULL) AS missing, count(*) FILTER (h.line_index IS NOT NULL AND h.source IS DISTINCT FROM p.kk) AS source_mismatch, count(*) FILTER (h.source = p.kk AND h.translation = p.ru) AS same FROM pairs p LEFT JOIN h ON h.line_index = p.pair_id""")
def hypothesis_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """References against the first ok hypothesis of their index: coverage and agreement of sources."""
    from ..operators.shards import compacted

    h = compacted(table(spark, sf, "translations"), ["record_id"], "line_index").select(F.col("line_index").alias("pair_id"), F.col("source").alias("s"), F.col("translation").alias("t"), F.lit(True).alias("there"))
    j = table(spark, sf, "pairs").select("pair_id", "kk", "ru").join(h, "pair_id", "left")
    there = F.coalesce("there", F.lit(False))
    return j.agg(
        F.count("*").alias("rows"),
        F.count_if(~there).alias("missing"),
        F.count_if(there & ~F.col("s").eqNullSafe(F.col("kk"))).alias("source_mismatch"),
        F.count_if((F.col("s") == F.col("kk")) & (F.col("t") == F.col("ru"))).alias("same"),
    )


MODELS = "SELECT coalesce(model, 'none') AS model, count(*) AS records, count(*) FILTER (status = 'ok') AS ok FROM translations GROUP BY 1"
PUBLISHED = [("nmt-base-600", 18.0), ("nmt-large-3000", 21.5), ("chat-draft", None), ("paper-only", 18.8)]


@query(f"""WITH l AS ({MODELS}), p(model, published) AS (VALUES ('nmt-base-600', 18.0::DOUBLE), ('nmt-large-3000', 21.5), ('chat-draft', NULL), ('paper-only', 18.8)),
 u AS (SELECT l.model, l.records, l.ok, round(100.0 * ok / records, 4) AS score, p.published FROM l LEFT JOIN p USING (model) UNION ALL SELECT model, NULL, NULL, NULL, published FROM p WHERE model NOT IN (SELECT model FROM l))
 SELECT model, records, ok, score, coalesce(printf('%.1f', published), '---') AS published FROM u""")
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """Local results with published ones; models that are only published follow."""
    local = table(spark, sf, "translations").groupBy(F.coalesce("model", F.lit("none")).alias("model")).agg(F.count("*").alias("records"), F.count_if(F.col("status") == "ok").alias("ok"))
    local = local.withColumn("score", F.round(100.0 * F.col("ok") / F.col("records"), 4))
    pub = spark.createDataFrame(PUBLISHED, "model string, published double")
    both = local.join(F.broadcast(pub), "model", "left").unionByName(pub.join(local, "model", "left_anti"), allowMissingColumns=True)
    shown = F.coalesce(F.format_string("%.1f", F.col("published")), F.lit("---"))
    return both.select("model", "records", "ok", "score", F.when(F.col("published").isNull(), "---").otherwise(shown).alias("published")).orderBy(F.desc_nulls_last("score"), "model")


@query("""WITH p(model, published) AS (VALUES ('nmt-base-600', 18.0::DOUBLE), ('nmt-large-3000', 21.5), ('chat-draft', NULL), ('paper-only', 18.8)) SELECT model FROM p WHERE model NOT IN (SELECT coalesce(model, 'none') FROM translations)""")
def published_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    pub = spark.createDataFrame(PUBLISHED, "model string, published double")
    return pub.join(table(spark, sf, "translations").select(F.coalesce("model", F.lit("none")).alias("model")).distinct(), "model", "left_anti").select("model")


@query(f"WITH {HYPS}, l AS (SELECT item_id, system, len(h) AS n FROM hyp) SELECT x.item_id, CAST(x.n - y.n AS BIGINT) AS delta FROM l x JOIN l y USING (item_id) WHERE x.system = 'a' AND y.system = 'b'")
def paired_systems(spark: SparkSession, sf: str) -> DataFrame:
    d = hypotheses(spark, sf).select("item_id", "system", F.size("h").alias("n"))
    b = d.where("system = 'b'").select("item_id", F.col("n").alias("m"))
    return d.where("system = 'a'").join(b, "item_id").select("item_id", (F.col("n") - F.col("m")).cast("long").alias("delta"))


@query("""SELECT coalesce(model, 'none') AS system, count(*) AS rows, count(*) FILTER (status IS NULL OR status <> 'ok') AS not_ok, count(*) - count(DISTINCT line_index) AS repeated,
 CASE WHEN count(*) FILTER (status IS NULL OR status <> 'ok') > 0 THEN 'errors' WHEN count(*) > count(DISTINCT line_index) THEN 'repeated index' ELSE 'accepted' END AS reason FROM translations GROUP BY 1""")
def archive_rescoring(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a system's archived records may be scored again, and why not."""
    g = table(spark, sf, "translations").groupBy(F.coalesce("model", F.lit("none")).alias("system"))
    a = g.agg(F.count("*").alias("rows"), F.count_if(F.coalesce(F.col("status") != "ok", F.lit(True))).alias("not_ok"), (F.count("*") - F.count_distinct("line_index")).alias("repeated"))
    return a.withColumn("reason", F.when(F.col("not_ok") > 0, "errors").when(F.col("repeated") > 0, "repeated index").otherwise("accepted"))


@query("SELECT origin, count(*) AS rows, count(*) FILTER (n % 16 = 0) AS batches, round(sum(CASE WHEN n % 16 = 0 THEN secs ELSE 0 END), 3) AS seconds FROM (SELECT origin, pos AS n, length(coalesce(kk, '')) / 100.0 AS secs FROM pairs) GROUP BY origin")
def throughput(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds are counted once per batch, at its first row."""
    d = table(spark, sf, "pairs").select("origin", (F.col("pos") % 16 == 0).alias("first"), (F.length(fx.text("kk")) / 100.0).alias("secs"))
    return d.groupBy("origin").agg(F.count("*").alias("rows"), F.count_if("first").alias("batches"), F.round(F.sum(F.when(F.col("first"), F.col("secs")).otherwise(0.0)), 3).alias("seconds"))


@query("SELECT event_type, date_trunc('day', ts)::DATE AS day, count(*) AS n, round(sum(value), 4) AS tokens, round(avg(value), 6) AS loss FROM events GROUP BY ALL")
def step_log(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day"))
    return g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("tokens"), F.round(F.avg("value"), 6).alias("loss"))


@query("""SELECT event_id, user_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events) WHERE value > best OR (best IS NULL AND value IS NOT NULL)""")
def running_best(spark: SparkSession, sf: str) -> DataFrame:
    """Events of each user that beat all before: a new best only when strictly greater."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    d = table(spark, sf, "events").withColumn("best", F.max("value").over(w))
    return d.where("value > best OR (best IS NULL AND value IS NOT NULL)").select("event_id", "user_id", "value")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 3")
def checkpoint_retention(spark: SparkSession, sf: str) -> DataFrame:
    """The newest three of each group by the number in their names ``step-N``."""
    d = table(spark, sf, "events").select("user_id", "event_id", F.concat(F.lit("step-"), F.col("event_id").cast("string")).alias("name"))
    w = Window.partitionBy("user_id").orderBy(fx.step_number("name").desc())
    return d.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("user_id", "event_id")


@query("""SELECT event_id, round(CASE WHEN event_id < 2000 THEN 0.1 * event_id / 2000 ELSE 0.01 + 0.045 * (1 + cos(pi() * least(1.0, (event_id - 2000) / 28000.0))) END, 9) AS lr FROM events""")
def lr_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(fx.learning_rate(F.col("event_id"), 0.1, 0.01, 2000, 30000), 9).alias("lr"))


@query("""SELECT event_id, CASE WHEN value IS NULL OR value <= 0 THEN '--:--' WHEN floor(value * 60) >= 3600 THEN printf('%d:%02d:%02d', CAST(floor(value * 60) AS BIGINT) // 3600, CAST(floor(value * 60) AS BIGINT) % 3600 // 60, CAST(floor(value * 60) AS BIGINT) % 60)
 ELSE printf('%02d:%02d', CAST(floor(value * 60) AS BIGINT) // 60, CAST(floor(value * 60) AS BIGINT) % 60) END AS eta FROM events""")
def durations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", fx.duration(F.col("value") * 60).alias("eta"))


@query("SELECT shard, count(*) AS done, round(count(*) * 100.0 / 1000, 4) AS percent, round(count(*) / 60.0::DOUBLE, 6) AS rate, round((1000 - count(*)) / (count(*) / 60.0::DOUBLE), 4) AS left_s FROM translations GROUP BY shard")
def shard_progress(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "translations").groupBy("shard").agg(F.count("*").alias("done"))
    percent, rate, left = fx.progress(F.col("done"), F.lit(1000), F.lit(60.0))
    return d.select("shard", "done", F.round(percent, 4).alias("percent"), F.round(rate, 6).alias("rate"), F.round(left, 4).alias("left_s"))


@query("SELECT item_id, '\\textbf{' || replace(item_code, '_', '\\_') || '}' AS cell FROM eval_pairs")
def report_cells(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_pairs").select("item_id", F.concat(F.lit("\\textbf{"), fx.latex("item_code"), F.lit("}")).alias("cell"))


@query("SELECT item_id, item_code FROM eval_pairs WHERE item_id IN (1, 3)")
def picked_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows at fixed positions 0 and 2: the positions are the operator's argument."""
    d = order.running(table(spark, sf, "eval_pairs").select("item_id", "item_code"), ["item_id"], None, "pos")
    return d.where(F.col("pos").isin(0, 2)).select("item_id", "item_code")


@query("SELECT source_file, CAST(to_json({'files': count(*), 'chars': CAST(sum(length(coalesce(text, ''))) AS BIGINT)}) AS VARCHAR) AS manifest FROM mono_docs GROUP BY source_file")
def manifests(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "mono_docs").groupBy("source_file").agg(F.count("*").alias("files"), F.sum(F.length(fx.text("text")).cast("long")).alias("chars"))
    return g.select("source_file", F.to_json(F.struct("files", "chars")).alias("manifest"))


@query("SELECT archive, count(*) AS n FROM pairs WHERE archive IS NOT NULL GROUP BY archive")
def archive_names(spark: SparkSession, sf: str) -> DataFrame:
    """Archive names put together from the segments of a URL."""
    p = table(spark, sf, "pairs").where("archive IS NOT NULL")
    a, v = F.substring_index("archive", "-", 1), F.substring_index("archive", "-", -1)
    url = F.concat(F.lit("https://host/"), a, F.lit("/"), v, F.lit("/moses/x.zip/"))
    name = F.substring_index(fx.archive_name(url), "-", 2)
    return p.groupBy(name.alias("archive")).agg(F.count("*").alias("n"))


@query("""SELECT coalesce(model, 'none') AS model, shard, count(*) AS n, round(sum(length(coalesce(translation, ''))) / 100.0 / count(*), 6) AS seconds_each,
 round(sum(length(coalesce(translation, ''))) * 1.0 / sum(length(source)), 6) AS growth FROM translations GROUP BY ALL""")
def sweep(spark: SparkSession, sf: str) -> DataFrame:
    """A metric table over all combinations of settings, seconds per sentence among them."""
    d = table(spark, sf, "translations").withColumn("t", F.length(fx.text("translation"))).withColumn("s", F.length("source"))
    g = d.groupBy(F.coalesce("model", F.lit("none")).alias("model"), "shard")
    each = F.round(F.sum("t") / 100.0 / F.count("*"), 6)
    return g.agg(F.count("*").alias("n"), each.alias("seconds_each"), F.round(F.sum("t") / F.sum("s"), 6).alias("growth"))


@query("""WITH k AS (SELECT max(item_id) // 2 AS hi FROM eval_pairs), stored AS (SELECT item_id, kk, CASE WHEN item_id % 50 = 0 THEN '' ELSE ru END AS ru FROM eval_pairs, k WHERE item_id <= hi)
 SELECT count(*) AS stored, count(*) FILTER (s.kk IS DISTINCT FROM e.kk OR s.ru IS DISTINCT FROM e.ru) AS changed, (SELECT count(*) FROM eval_pairs) - count(*) AS remaining FROM stored s JOIN eval_pairs e USING (item_id)""")
def prefix_check(spark: SparkSession, sf: str) -> DataFrame:
    """Resume check: stored records (here the first half, some changed) against the data set."""
    e = table(spark, sf, "eval_pairs").select("item_id", "kk", "ru")
    half = e.agg(F.floor(F.max("item_id") / 2).alias("hi"))
    old = e.join(F.broadcast(half), F.col("item_id") <= F.col("hi")).select("item_id", F.col("kk").alias("k"), F.when(F.col("item_id") % 50 == 0, "").otherwise(F.col("ru")).alias("r"), F.lit(True).alias("there"))
    j = e.join(old, "item_id", "left")
    there = F.col("there").isNotNull()
    same = F.col("k").eqNullSafe(F.col("kk")) & F.col("r").eqNullSafe(F.col("ru"))
    return j.agg(F.count_if(there).alias("stored"), F.count_if(there & ~same).alias("changed"), F.count_if(~there).alias("remaining"))


@query()
def piece_bleu(spark: SparkSession, sf: str) -> DataFrame:
    """BLEU over the pieces of a public subword model, the pluggable tokenizer of M5; a missing
    model is recorded, not raised."""
    import os

    path = spark.conf.get("spark.lexiloom.piece", "/opt/tokenizers/piece_bpe_32k.model")
    if not os.path.exists(path):
        return spark.createDataFrame([("-", None, f"no tokenizer at {path}")], "system string, bleu double, error string")
    from ..functions import sequence as sq

    encode = sq.sentencepiece(path)
    ids = lambda c: F.transform(encode(F.array_join(c, " ")), lambda x: x.cast("string"))
    h = hypotheses(spark, sf).withColumn("hi", ids("h")).withColumn("ri", ids("r"))
    s = metrics.gram_rows(h, ["item_id", "system"], F.col("hi"), F.col("ri"), metrics.ORDERS)
    return metrics.bleu(s, ["system"]).select("system", F.round("bleu", 6).alias("bleu"), F.lit(None).cast("string").alias("error"))
