"""Numbers and sums along an order of the whole table, without one task for all rows.

A range partitioning sorts the rows; each partition's totals (one small row per
partition) give its start; the window then runs inside partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, order: list[str], value=None, name: str = "offset", partitions: int = 0) -> DataFrame:
    """Sum of ``value`` over the rows before each row in the given order (of 1 by default:
    the row's number from 0).  The order must have no ties."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = F.lit(1).cast("long") if value is None else value.cast("long")
    d = df.withColumn("_v", v).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    from .durable import written

    d = written(d)
    per = d.groupBy("_part").agg(F.sum("_v").alias("_sum"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    start = per.select("_part", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = d.join(F.broadcast(start), "_part")
    return out.withColumn(name, F.col("_start") + F.coalesce(F.sum("_v").over(inside), F.lit(0))).drop("_v", "_part", "_start")
