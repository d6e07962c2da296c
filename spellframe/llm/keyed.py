"""Running sums along a key and joins by a key, both safe when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key with more than one in SHARE rows is heavy; so there are at most SHARE heavy keys at any size.
SHARE = 1_024


def in_ranges(df: DataFrame, key: str, order: list[Column], part: str = "part") -> DataFrame:
    """Rows in ranges of (key, order), each with the number of its range: a heavy key is cut into several.

    Write the result before it is used: the number belongs to the task that held the row.
    """
    return df.repartitionByRange(F.col(key), *order).withColumn(part, F.spark_partition_id())


def before_part(totals: DataFrame, key: str, part: str, sums: dict[str, Column], after: bool = False) -> DataFrame:
    """For each (key, part), the sums over the parts of the key before it (after it): one row for a range, not for a row."""
    along = Window.partitionBy(key).orderBy(F.desc(part) if after else F.col(part)).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns({name: F.coalesce(total.over(along), F.lit(0).cast("long")) for name, total in sums.items()})


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], rows: str, how: str = "left") -> DataFrame:
    """Join to a right side with one row per key, whose column ``rows`` says how many left rows the key has.

    The heavy keys (at most SHARE, by arithmetic) are broadcast, so their left rows stay where they are; every
    other key is too small to fill a task.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    heavy = F.col(rows) * SHARE >= total
    few, many = right.where(heavy).drop(rows), right.where(~heavy).drop(rows)
    met = left.join(F.broadcast(few), keys)
    rest = left.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(many, keys, how)
    return met.unionByName(rest)
