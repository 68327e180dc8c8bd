"""Scans and sinks: tables go out through a sink, come back through a scan, and are compared."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import shards
from ..operators.durable import folder
from ..sources import store, text_io
from .catalog import query, table
from .corpus import ENDS, WS



def collapsed_sql(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{WS}', ' ', 'g'))"


PAIRS = f"p AS (SELECT {collapsed_sql('kk')} AS src, {collapsed_sql('ru')} AS tgt, origin FROM pairs)"


def eval_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_pairs").select("item_id", "split", "kk", "ru")


@query(f"WITH {PAIRS} SELECT src, tgt, count(*) AS n FROM p WHERE src <> '' AND tgt <> '' GROUP BY ALL")
def tsv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Two-column lines: the sink leaves empty pairs out, the scan splits at the tab."""
    path = folder(spark, "tsv")
    text_io.write_tsv(table(spark, sf, "pairs"), path, "kk", "ru")
    return text_io.pairs(spark, path).groupBy("src", "tgt").agg(F.count("*").alias("n"))


@query(f"WITH {PAIRS} SELECT src, tgt || chr(9) || origin AS tgt, count(*) AS n FROM p WHERE src <> '' AND tgt <> '' AND origin <> '' GROUP BY ALL")
def tsv_rest(spark: SparkSession, sf: str) -> DataFrame:
    """Everything after the first tab as the second column."""
    path = folder(spark, "tsv")
    d = table(spark, sf, "pairs").select(fx.collapse("kk").alias("a"), fx.collapse("ru").alias("b"), "origin").where("a <> '' AND b <> '' AND origin <> ''")
    text_io.replace_atomically(d.select(F.concat_ws("\t", "a", "b", "origin").alias("value")), path, "text")
    return text_io.pairs(spark, path, "rest").groupBy("src", "tgt").agg(F.count("*").alias("n"))


@query(f"WITH {PAIRS} SELECT count(*) AS lines, count(*) FILTER (src <> '' AND tgt <> '') AS pairs, count(*) FILTER (tgt = '') AS one_column FROM p WHERE src <> '' OR tgt <> ''")
def tsv_dialects(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of one or two columns: all lines, those that are pairs, those without a tab."""
    path = folder(spark, "tsv")
    d = table(spark, sf, "pairs").select(fx.collapse("kk").alias("a"), fx.collapse("ru").alias("b")).where("a <> '' OR b <> ''")
    line = F.when(F.col("b") == "", F.col("a")).otherwise(F.concat_ws("\t", "a", "b"))
    text_io.replace_atomically(d.select(line.alias("value")), path, "text")
    kept = text_io.pairs(spark, path, bad="keep")
    n = text_io.normalized_pairs(spark, path).agg(F.count("*").alias("pairs"))
    a = kept.agg(F.count("*").alias("lines"), F.count_if(F.col("tgt").isNull()).alias("one_column"))
    u = a.unionByName(n, True)
    return u.agg(*(F.max(c).alias(c) for c in ("lines", "pairs", "one_column")))


@query(f"SELECT src, count(*) AS n FROM (SELECT {collapsed_sql('unnest(string_split(text, chr(10)))')} AS src FROM mono_docs) WHERE src <> '' GROUP BY src")
def monolingual_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark, "lines")
    text_io.replace_atomically(table(spark, sf, "mono_docs").where("text IS NOT NULL").select(F.regexp_replace("text", "\r", " ").alias("value")), path, "text")
    return text_io.monolingual(spark, path).groupBy("src").agg(F.count("*").alias("n"))


@query(f"SELECT item_id - 1 AS index, regexp_replace(kk, '{ENDS}', '', 'g') AS source FROM eval_pairs WHERE item_id > 10 AND regexp_replace(coalesce(kk, ''), '{ENDS}', '', 'g') <> ''")
def indexed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line numbers of several files in their order, from line 10 on: items are their own line numbers."""
    path = folder(spark, "lines")
    d = eval_rows(spark, sf).select("item_id", F.concat_ws("\t", F.regexp_replace(fx.text("kk"), r"[\t\r\n]", " "), F.regexp_replace(fx.text("ru"), r"[\t\r\n]", " ")).alias("value"))
    text_io.replace_atomically(d.repartitionByRange(3, "item_id").sortWithinPartitions("item_id").select("value"), path, "text")
    return text_io.indexed_sources(spark, path, 10)


@query("SELECT item_id - 1 AS index, kk AS src, ru AS tgt FROM eval_pairs")
def zipped_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Two files side by side by line number."""
    sides = []
    for c in ("kk", "ru"):
        path = folder(spark, "lines")
        d = eval_rows(spark, sf).repartitionByRange(2, "item_id").sortWithinPartitions("item_id")
        text_io.replace_atomically(d.select(F.col(c).alias("value")), path, "text")
        sides.append(text_io.lines(spark, path, indexed=True))
    return text_io.positional_zip(*sides)


RECORD_SQL = "SELECT record_id AS index, source, translation, status, model, error FROM translations"


def record_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "translations").select(F.col("record_id").alias("index"), "source", "translation", "status", "model", "error")


@query(RECORD_SQL)
def jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Records in four compressed shards of JSON lines, appended in two steps."""
    path = folder(spark, "jsonl")
    d = record_rows(spark, sf)
    text_io.write_jsonl(d.where("index % 2 = 0"), path, 4, compressed=True)
    text_io.append_jsonl(d.where("index % 2 = 1"), path)
    return text_io.records(spark, f"{path}/part-*").select("index", "source", "translation", "status", "model", "error")


@query("SELECT line_index AS index, shard, record_id FROM (SELECT *, row_number() OVER (PARTITION BY line_index ORDER BY shard, record_id) AS rn FROM translations WHERE status = 'ok') WHERE rn = 1")
def recovered_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Records of shards after a crash: a torn last line is out, the first good record of an index stays."""
    path = folder(spark, "shards")
    t = table(spark, sf, "translations").select("shard", F.col("record_id"), F.to_json(F.struct(F.col("line_index").alias("index"), "source", "translation", "status", F.col("record_id").cast("string").alias("model"))).alias("value"))
    torn = t.groupBy("shard").agg((F.max("record_id") + 1).alias("record_id"), F.lit('{"index": 1, "sour').alias("value"))
    d = t.unionByName(torn).repartition("shard").sortWithinPartitions("shard", "record_id")
    d.select("shard", "value").write.partitionBy("shard").text(path)
    r = text_io.recovered(text_io.records(spark, f"{path}/shard=*"))
    name = F.regexp_extract("shard", "shard=([^/]*)/", 1)
    return r.select("index", name.alias("shard"), F.col("model").cast("long").alias("record_id"))


@query(RECORD_SQL.replace("source,", "coalesce(source, '') AS source,").replace(" translation,", " coalesce(translation, '') AS translation,").replace("model, error", "coalesce(model, '') AS model"))
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with quotes and line breaks through CSV with a header."""
    path = folder(spark, "csv")
    d = record_rows(spark, sf).select("index", *(fx.text(c).alias(c) for c in ("source", "translation")), "status", fx.text("model").alias("model"))
    text_io.replace_atomically(d, path, "csv", header="true", escape='"', quoteAll="true", nullValue="\\N", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
    back = text_io.csv_documents(spark, path, "index long, source string, translation string, status string, model string", escape='"', nullValue="\\N")
    return back


@query("SELECT item_id, split, kk, ru FROM eval_pairs")
def table_tsv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A table of results with a header, columns apart by tabs."""
    path = folder(spark, "tsv")
    text_io.write_table_tsv(eval_rows(spark, sf), path)
    d = spark.read.schema("item_id long, split string, kk string, ru string").csv(path, header=True, sep="\t", emptyValue="")
    return d.select("item_id", "split", "kk", F.coalesce("ru", F.lit("")).alias("ru"))


@query("SELECT split AS classname, item_code AS name, 0.5::DOUBLE AS time, item_id % 7 = 0 AS failed FROM eval_pairs")
def junit_report(spark: SparkSession, sf: str) -> DataFrame:
    """Cases of a test report in XML."""
    path = folder(spark, "junit")
    fail = F.when(F.col("item_id") % 7 == 0, "<failure>x</failure>").otherwise("")
    case = F.format_string('<testcase classname="%s" name="%s" time="0.5">%s</testcase>', "split", "item_code", fail)

    def report(batches):
        yield pa.RecordBatch.from_arrays([pa.array(["<testsuite>"])], names=["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays(b.columns, names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["</testsuite>"])], names=["value"])

    text_io.replace_atomically(table(spark, sf, "eval_pairs").select(case.alias("value")).mapInArrow(report, "value string"), path, "text")
    return text_io.junit(spark, path)


@query("SELECT count(*) AS files, true AS same FROM range(4)")
def file_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Digests taken in blocks are those of the whole content."""
    path = folder(spark, "files")
    text_io.write_jsonl(record_rows(spark, sf), path, 4)
    f = text_io.fingerprints(spark, f"{path}/part-*")
    whole = spark.read.format("binaryFile").load(f"{path}/part-*").select("path", F.sha2("content", 256).alias("d"))
    return f.join(whole, "path").agg(F.count("*").alias("files"), F.every(F.col("d") == F.col("sha256")).alias("same"))


@query("SELECT item_id, len(string_split(kk, ' ')) AS n, string_split(kk, ' ')[1] AS first FROM eval_pairs WHERE item_id BETWEEN 5 AND 60")
def token_store(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens written with a manifest; it must fit before rows of the store are read."""
    path, src = folder(spark, "store"), folder(spark, "src")
    text_io.write_tsv(table(spark, sf, "eval_pairs"), src, "kk", "ru")
    meta = store.metadata(spark, f"{src}/part-*", f"{src}/_SUCCESS", 256)
    store.write(table(spark, sf, "eval_pairs").select("item_id", F.split("kk", " ").alias("tokens")), path, meta)
    d = store.rows(store.read(spark, path, meta), 5, 56, "item_id")
    return d.select("item_id", F.size("tokens").cast("long").alias("n"), F.get("tokens", F.lit(0)).alias("first"))


@query("SELECT doc_id, record_id, lang, status FROM (SELECT doc_id, NULL::BIGINT AS record_id, lang, NULL AS status FROM documents UNION ALL SELECT NULL, record_id, NULL, status FROM translations)")
def ragged_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables with different columns under one another."""
    return text_io.ragged_union([table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "translations").select("record_id", "status")])


@query(f"SELECT src, tgt, count(*) AS n FROM (SELECT regexp_replace(coalesce(kk, ''), '{ENDS}', '', 'g') AS src, regexp_replace(coalesce(ru, ''), '{ENDS}', '', 'g') AS tgt FROM pairs WHERE origin IS NOT NULL) WHERE src <> '' AND tgt <> '' GROUP BY ALL")
def dataset_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Two columns of a data set kept as one folder for each configuration."""
    path = folder(spark, "set")
    table(spark, sf, "pairs").where("origin IS NOT NULL").write.parquet(f"{path}/train")
    return text_io.column_pairs(text_io.dataset_rows(spark, path, "train"), "kk", "ru").groupBy("src", "tgt").agg(F.count("*").alias("n"))


@query("SELECT item_id - 1 AS index, ru AS value, (SELECT count(*) FROM eval_pairs) AS rows FROM eval_pairs")
def hypothesis_files(spark: SparkSession, sf: str) -> DataFrame:
    """Hypotheses line by line in the order of their index, and their metrics as an object."""
    path = folder(spark, "eval")
    h = table(spark, sf, "eval_pairs").select((F.col("item_id") - 1).alias("index"), F.col("ru").alias("hypothesis"))
    text_io.write_hypotheses(h, h.agg(F.count("*").alias("rows")), path)
    m = spark.read.schema("rows long").json(f"{path}/metrics")
    return text_io.lines(spark, f"{path}/hypotheses", indexed=True).select("index", "value").withColumn("k", F.lit(1)).join(F.broadcast(m.withColumn("k", F.lit(1))), "k").drop("k")


@query("SELECT item_id AS index, kk AS source, ru AS reference, ru AS hypothesis FROM eval_pairs WHERE ru <> ''")
def strict_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Hypotheses that must fit their references one to one before they are scored."""
    refs = table(spark, sf, "eval_pairs").where("ru <> ''").select(F.col("item_id").alias("index"), F.col("kk").alias("source"), F.col("ru").alias("reference"))
    rec = refs.select("index", "source", F.concat(F.lit(" "), "reference", F.lit("\n")).alias("translation"), F.lit("ok").alias("status"))
    return shards.strict_hypotheses(rec, refs)


@query("SELECT record_id AS index, CASE WHEN source LIKE '%5%' THEN NULL ELSE upper(source) END AS translation, CASE WHEN source LIKE '%5%' THEN 'error' ELSE 'ok' END AS status FROM translations WHERE source IS NOT NULL")
def mapped_with_retry(spark: SparkSession, sf: str) -> DataFrame:
    """A function that fails on some texts: their rows become records with an error."""

    def shout(texts):
        if any("5" in t for t in texts):
            raise ValueError("a five")
        return [t.upper() for t in texts]

    d = record_rows(spark, sf).where("source IS NOT NULL").select("index", "source")
    return shards.map_with_retry(d, shout).select("index", "translation", "status")
