"""Scans and sinks for lines, TSV pairs, JSON lines, CSV and XML.

Schemas are explicit.  TSV is read as text and split, as a CSV reader would neither skip
lines without a tab nor leave quotes alone.  gzip is read by suffix; such files do not
split, so repartition after them.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as fx

RECORD = T.StructType(
    [T.StructField("index", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("source", "translation", "status", "model", "error", "_corrupt_record")]
)


def lines(spark: SparkSession, paths, indexed: bool = False) -> DataFrame:
    """(origin, value) of each line; with ``indexed`` also its number in the file order, from 0,
    blank lines counted."""
    d = spark.read.text(paths).select(F.col("_metadata.file_name").alias("origin"), F.make_valid_utf8("value").alias("value"))
    if not indexed:
        return d
    from ..operators.durable import written

    place = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i")]
    d = written(spark.read.text(paths).select(F.col("_metadata.file_name").alias("origin"), F.make_valid_utf8("value").alias("value"), *place))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per block of a file
    start = d.groupBy("_f", "_b").agg(F.count("*").alias("_n")).select("_f", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    inside = F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_i")) - 1
    return d.join(F.broadcast(start), ["_f", "_b"]).select("origin", "value", (F.col("_s") + inside).alias("index"))


def pairs(spark: SparkSession, paths, columns: str = "first", bad: str = "skip", indexed: bool = False) -> DataFrame:
    """(src, tgt, origin) of TSV lines.

    columns: ``first`` keeps columns 1 and 2, ``rest`` keeps further tabs in tgt.
    bad: ``skip`` drops lines without a tab, ``raise`` fails on lines without exactly two
    columns (with ``rest``: without a tab), ``keep`` leaves null sides.
    """
    d = lines(spark, paths, indexed)
    part = F.split("value", "\t", 2 if columns == "rest" else -1)
    n = F.size(part)
    wrong = n < 2 if columns == "rest" else n != 2
    if bad == "raise":
        part = F.when(wrong, F.raise_error(F.concat(F.lit("not two columns: "), F.col("value")))).otherwise(part)
    out = d.select(F.get(part, F.lit(0)).alias("src"), F.get(part, F.lit(1)).alias("tgt"), "origin", *(["index"] if indexed else []), n.alias("_n"))
    if bad == "skip":
        out = out.where("_n >= 2")
    return out.drop("_n")


def normalized_pairs(spark: SparkSession, paths) -> DataFrame:
    d = pairs(spark, paths)
    return d.select(fx.collapse("src").alias("src"), fx.collapse("tgt").alias("tgt"), "origin").where("src <> '' AND tgt <> ''")


def monolingual(spark: SparkSession, paths) -> DataFrame:
    return lines(spark, paths).select(fx.collapse("value").alias("src"), F.lit("").alias("tgt")).where("src <> ''")


def column_pairs(d: DataFrame, a: str, b: str) -> DataFrame:
    """(src, tgt) of two columns of a table: null as empty, outer white space off, pairs with an
    empty side out."""
    return d.select(fx.strip(a).alias("src"), fx.strip(b).alias("tgt")).where("src <> '' AND tgt <> ''")


def dataset_rows(spark: SparkSession, path: str, config: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Rows of a data set kept as files, of one configuration (a folder of its own) if given."""
    return spark.read.format(fmt).load(f"{path}/{config}" if config else path)


def indexed_sources(spark: SparkSession, paths, start: int = 0, limit: int = 0) -> DataFrame:
    """(index, source): the first column of non-empty lines within [start, start + limit)."""
    d = lines(spark, paths, indexed=True).select("index", fx.strip(F.split("value", "\t", 2)[0]).alias("source"))
    d = d.where((F.col("index") >= start) & (F.col("source") != ""))
    return d.where(F.col("index") < start + limit) if limit else d


def positional_zip(a: DataFrame, b: DataFrame, pos: str = "index") -> DataFrame:
    """Rows of two line tables with the same position; the longer one is cut."""
    return a.select(pos, F.col("value").alias("src")).join(b.select(pos, F.col("value").alias("tgt")), pos)


def records(spark: SparkSession, paths, suffix: str = "") -> DataFrame:
    """Translation records of JSON-line shards; a torn line is a row with ``_corrupt_record``.
    ``line`` orders the records of a shard as they stand in it."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths if isinstance(paths, str) else paths[0])
    fs = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.globStatus(files):
        raise FileNotFoundError(f"no shards at {paths}")
    d = spark.read.schema(RECORD).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(paths)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return d.select("*", F.input_file_name().alias("shard"), place.alias("line"))


def recovered(records: DataFrame) -> DataFrame:
    """Records of a shard after a crash: its torn last line out, status ok only, the first of
    each index by shard and line.  A corrupt line before the last of its shard raises."""
    from ..operators.dedup import keep_first

    last = F.max("line").over(Window.partitionBy("shard"))
    d = records.withColumn("_last", last)
    damage = F.raise_error(F.concat(F.lit("corrupt line within "), F.col("shard"), F.lit(": "), F.substring("_corrupt_record", 1, 80)))
    usable = F.when(F.col("_corrupt_record").isNull(), F.coalesce(F.col("status") == "ok", F.lit(False))).when(F.col("line") == F.col("_last"), False).otherwise(damage.cast("boolean"))
    return keep_first(d.where(usable), ["index"], ["shard", "line"]).drop("_corrupt_record", "_last", "line")


def csv_documents(spark: SparkSession, paths, schema: str, **options) -> DataFrame:
    """Documents of CSV files with a header and line breaks in quotes, a byte-order mark ignored."""
    return spark.read.schema(schema).options(**options).option("header", True).option("multiLine", True).option("encoding", "UTF-8").csv(paths)


def junit(spark: SparkSession, path: str) -> DataFrame:
    """Test cases of a JUnit XML report."""
    schema = "`_classname` string, `_name` string, `_time` double, failure string"
    d = spark.read.format("xml").option("rowTag", "testcase").schema(schema).load(path)
    return d.select(F.col("_classname").alias("classname"), F.col("_name").alias("name"), F.col("_time").alias("time"), F.col("failure").isNotNull().alias("failed"))


def fingerprints(spark: SparkSession, paths) -> DataFrame:
    """(path, size, modified, sha256) of files; digests are taken in blocks, so a file of any
    length needs little memory."""
    d = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    n = max(1, min(d.count(), spark.sparkContext.defaultParallelism * 4))

    def run(batches):
        import hashlib

        import pyarrow.fs as pafs

        for b in batches:
            digests = []
            for p in b.column("path").to_pylist():
                fs, name = (pafs.LocalFileSystem(), p.removeprefix("file:")) if p.startswith("file:") else pafs.FileSystem.from_uri(p)
                h = hashlib.sha256()
                with fs.open_input_stream(name, compression=None) as f:
                    while block := f.read(1 << 22):
                        h.update(block)
                digests.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests, pa.string())], names=["path", "size", "modified", "sha256"])

    return d.repartition(n, "path").mapInArrow(run, "path string, size long, modified timestamp, sha256 string")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace_atomically(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Write beside the target and swap; on failure the old output stays and the new is removed."""
    spark = df.sparkSession
    staging, old = f"{path}.staging-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"
    p, fs = _fs(spark, path)
    s, _ = _fs(spark, staging)
    o, _ = _fs(spark, old)
    try:
        df.write.format(fmt).options(**options).save(staging)
        if fs.exists(p):
            fs.rename(p, o)
        if not fs.rename(s, p):
            fs.rename(o, p)
            raise OSError(f"cannot move the output to {path}")
        fs.delete(o, True)
    finally:
        fs.delete(s, True)


def tsv_rows(df: DataFrame, a: str = "src", b: str = "tgt") -> DataFrame:
    """Lines of two columns; pairs with an empty side are left out."""
    x, y = fx.collapse(a), fx.collapse(b)
    return df.select(x.alias("x"), y.alias("y")).where("x <> '' AND y <> ''").select(F.concat_ws("\t", "x", "y").alias("value"))


def write_tsv(df: DataFrame, path: str, a: str = "src", b: str = "tgt") -> None:
    replace_atomically(tsv_rows(df, a, b), path, "text")


def write_jsonl(df: DataFrame, path: str, files: int = 0, compressed: bool = False) -> None:
    d = df.repartition(files) if files else df
    replace_atomically(d, path, "json", **({"compression": "gzip"} if compressed else {}))


def write_hypotheses(hyps: DataFrame, scores: DataFrame, path: str, index: str = "index", text: str = "hypothesis") -> None:
    """Hypotheses, one a line in the order of their index, and their metrics as one JSON object."""
    d = hyps.select(index, F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", " ").alias("value"))
    replace_atomically(d.repartitionByRange(index).sortWithinPartitions(index).select("value"), f"{path}/hypotheses", "text")
    write_manifest(scores, f"{path}/metrics")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_table_tsv(df: DataFrame, path: str) -> None:
    replace_atomically(df, path, "csv", header="true", sep="\t")


def write_manifest(df: DataFrame, path: str) -> None:
    """One JSON object from a one-row table."""
    replace_atomically(df.coalesce(1), path, "json")


def ragged_union(tables: list[DataFrame]) -> DataFrame:
    """Union of tables with different columns; the columns are all names, sorted."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.select(*sorted(out.columns))
