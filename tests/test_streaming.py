from pyspark.sql import functions as F

from lexiloom.operators import shards
from lexiloom.streaming import jobs


def test_dedup_over_arrivals(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "i int, sentence string"
    spark.createDataFrame([(1, "Бір"), (2, "БІР"), (3, "екі")], schema).coalesce(1).write.parquet(src)
    s = jobs.deduplicated(jobs.source(spark, src, schema), "sentence")
    assert jobs.drain(s, str(tmp_path / "c")).count() == 2


def test_incremental_map_adds_nothing_twice(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "index long, source string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(src)
    step = lambda d: shards.map_with_retry(d, lambda b: [x.upper() for x in b])
    jobs.incremental_map(jobs.source(spark, src, schema), step, out, str(tmp_path / "c1"))
    spark.createDataFrame([(2, "b"), (3, "c")], schema).write.mode("append").parquet(src)
    jobs.incremental_map(jobs.source(spark, src, schema), step, out, str(tmp_path / "c2"))
    assert sorted(r["index"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_windowed_log(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "ts timestamp, k string, v double"
    spark.range(4).select(F.timestamp_seconds(F.col("id") * 1800).alias("ts"), F.lit("a").alias("k"), F.lit(1.0).alias("v")).write.parquet(src)
    got = jobs.drain(jobs.windowed_log(jobs.source(spark, src, schema), "ts", "k", "v"), str(tmp_path / "c"), "complete")
    assert sorted(r.n for r in got.collect()) == [2, 2]
