"""Running sums over a whole table without a task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.plans.store import scratch


def running_sum(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of value over all rows up to each by order (of unique keys).

    Rows are range-partitioned and written once; sums run inside the ranges, and the ranges' totals, a row each, are
    carried over.
    """
    spark = df.sparkSession
    path = scratch(spark, "ranges")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.withColumn("__v", value).repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    totals = rows.groupBy("__part").agg(F.sum("__v").alias("__t"))
    upto = F.sum("__t").over(Window.orderBy("__part"))  # as many rows as there are ranges
    before = totals.select("__part", (upto - F.col("__t")).alias("__before"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("__own", F.sum("__v").over(inside)).join(F.broadcast(before), "__part")
    return summed.select(*df.columns, (F.col("__own") + F.col("__before")).alias(name))
