"""Places in an order over all rows, without a task that orders all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.iterate import written


def placed(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """df with each row's place (from 1) by `order`; rows equal in it are placed one behind the other, in any order.

    Rows are dealt out by ranges of the order, so equal scores don't matter as long as the order has a last column that
    tells rows apart. Each range is written and numbered by itself, behind the sum of the ranges before, of which there
    are as many as shuffle partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = F.sum("c").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy(F.col("__range").alias("r")).agg(F.count(F.lit(1)).alias("c")).select("r", F.coalesce(before, F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    out = ranged.withColumn("__within", within).join(F.broadcast(starts), F.col("__range") == F.col("r"))
    return out.withColumn(name, F.col("__start") + F.col("__within")).select(*[f"`{c}`" for c in df.columns if c != name], name)
