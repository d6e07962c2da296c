"""Running totals over a whole table by range partitions: the order never passes through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def total_before(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows that come before, by ``order`` (distinct values).

    Two levels: rows are ranged by ``order`` and written once; sums of whole ranges are added up over one row per
    range, and sums inside a range by a window of its own.
    """
    ranged = stage(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    shifts = sums.select("_part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.join(F.broadcast(shifts), "_part")
                  .withColumn(name, F.col("_shift") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_part", "_shift"))
