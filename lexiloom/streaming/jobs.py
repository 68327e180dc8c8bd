"""Incremental jobs on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as fx


def source(spark: SparkSession, path: str, schema, fmt: str = "parquet", files: int = 0) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    return (r.option("maxFilesPerTrigger", files) if files else r).load(path)


def deduplicated(stream: DataFrame, sentence: str, event_time: str | None = None, late: str = "30 days", by: list[str] | None = None) -> DataFrame:
    """First arrival of each sentence, of each group ``by`` if given, without regard to case.  The state is unbounded unless
    an event-time column bounds it."""
    d = stream.withColumn("_key", fx.sentence_key(sentence))
    if event_time:
        return d.withWatermark(event_time, late).dropDuplicatesWithinWatermark([*(by or []), "_key"]).drop("_key")
    return d.dropDuplicates([*(by or []), "_key"]).drop("_key")


def run_log(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Running count, sum, least and most of a log's values per key."""
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))


def windowed_log(stream: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: event-time windows with a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def drain(result: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process all that is there and return what the job has written under ``folder``: in append
    mode all rows; in complete mode, where each run writes the whole result, that of the last run."""
    spark = result.sparkSession
    w = result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        w.format("parquet").start(f"{folder}/rows").awaitTermination()
        return spark.read.schema(result.schema).parquet(f"{folder}/rows")

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")

    w.foreachBatch(batch).start().awaitTermination()
    d = spark.read.schema(T.StructType([*result.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/rows")
    last = d.agg(F.max("batch").alias("batch"))
    return d.join(F.broadcast(last), "batch", "left_semi").drop("batch")


def incremental_map(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, index: str = "index") -> None:
    """Map what has arrived and is not yet in the output; a batch that runs again after a
    failure adds nothing twice."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        try:
            done = spark.read.parquet(out).select(index).distinct()
            df = df.join(done, index, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        step(df).write.mode("append").parquet(out)

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
