"""Keeping one hot key from landing in one task.

``find_sized`` measures which keys hold very many rows: a pass over the key columns and a shuffle of one
row in a hundred.  A key of ``HOT_ROWS`` rows or more is listed with the number of salts its size asks for, one for
``SALT_ROWS`` rows; a hot key's rows are dealt over its salts, and only the matching right rows are repeated, once per
salt.  There are at most rows / HOT_ROWS such keys: a short list is a local frame, a longer one a written
table that the planner broadcasts or shuffles by its size.  Which keys are listed never changes a
result, only where its rows are processed, and without hot keys the plan stays a plain join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import any_null
from ..session import stage

HOT_ROWS = 1_000_000
SALT_ROWS = 10_000
#: Hot keys that may be brought to the driver.
LISTED = 10_000
SALTS = 256
LOOK = 0.01


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over the tasks, ahead of costly work on each: one exchange, at any layout of the files."""
    return (df.withColumn("_deal", F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()))
              .repartition("_deal").drop("_deal"))


def hot_keys(df: DataFrame, keys: list[str], min_rows: int | None = None, look: float | None = None, nullable: list[str] = ()) -> DataFrame:
    """Keys with about ``min_rows`` rows or more and their salts, judged from a sample of the key columns; NULL is a value in ``nullable``."""
    look = look or LOOK
    must = [k for k in keys if k not in nullable]
    seen = df.select(*keys)
    if must:
        seen = seen.where(~any_null(must))
    if look < 1:
        seen = seen.sample(look, seed=1)
    return (seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= (min_rows or HOT_ROWS) * look)
                .select(*keys, F.ceil(F.col("_n") / (look * SALT_ROWS)).cast("bigint").alias("_salts")))


def find_sized(df: DataFrame, keys: list[str], min_rows: int | None = None, look: float | None = None, nullable: list[str] = ()) -> DataFrame | None:
    """The hot keys with their salts, None when there are none."""
    wanted = hot_keys(df, keys, min_rows, look, nullable)
    found = wanted.limit(LISTED + 1).collect()
    if not found:
        return None
    return df.sparkSession.createDataFrame(found, wanted.schema) if len(found) <= LISTED else stage(wanted, "hot_keys")


def find_hot(df: DataFrame, keys: list[str], min_rows: int | None = None, look: float | None = None) -> DataFrame | None:
    """The hot keys alone, None when there are none."""
    found = find_sized(df, keys, min_rows, look)
    return None if found is None else found.select(*keys)


def row_salt(df: DataFrame, salts: Column | int | None = None) -> Column:
    """Spreads rows, also identical copies; stable when a task is run again.

    The input partition number separates copies of one row, the content hash separates
    rows of one partition; neither depends on the order rows arrive in.  Without a number of salts the whole hash is given.
    """
    hashable = [c for c, t in df.dtypes if not t.startswith("map")]
    whole = F.xxhash64(F.spark_partition_id(), *hashable)
    return whole if salts is None else F.pmod(whole, salts if isinstance(salts, Column) else F.lit(salts)).cast("bigint")


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left",
                hot: DataFrame | None = None, salts: int = SALTS, nullable: list[str] = ()) -> DataFrame:
    """Equi-join of many left rows to a right side with one row per key; in ``nullable`` keys NULL meets NULL.

    Left rows of the ``hot`` keys are spread over the key's ``_salts`` (``salts`` where the frame has none) and the
    matching right rows are repeated.  Left rows without a key, which match nothing, are spread too where the join keeps them.
    """
    must = [k for k in on if k not in nullable]
    if how in ("inner", "left_semi") and must:
        left = left.where(~any_null(must))
    if must:
        right = right.where(~any_null(must))
    values = [c for c in right.columns if c not in on]
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    alike = lambda a, b: reduce(lambda x, y: x & y, [
        F.col(a + k).eqNullSafe(F.col(b + k)) if k in nullable else F.col(a + k) == F.col(b + k) for k in on])
    same, lone = alike("", "_r_"), any(left.schema[c].nullable for c in must) and how not in ("inner", "left_semi")
    if hot is not None or lone:
        # Always 0, but not a literal: a literal would be folded out of the join keys.
        zero = lambda p: F.pmod(F.hash(*[F.col(p + k) for k in on]), F.lit(1)).cast("bigint")
        salt = F.when(any_null(must), row_salt(left)) if lone else F.when(F.lit(False), F.lit(None).cast("bigint"))
        if hot is None:
            left, right = left.withColumn("_salt", salt.otherwise(zero(""))), right.withColumn("_other", zero("_r_"))
        else:
            known = hot if "_salts" in hot.columns else hot.withColumn("_salts", F.lit(salts).cast("bigint"))
            known = known.withColumnsRenamed({k: f"_h_{k}" for k in on})
            names = [f"_h_{k}" for k in on]
            left = (left.join(known, alike("", "_h_"), "left")
                        .withColumn("_salt", salt.when(F.col("_salts").isNotNull(), row_salt(left, F.col("_salts"))).otherwise(zero(""))).drop("_salts", *names))
            everywhere = F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1)
            right = (right.join(known, alike("_r_", "_h_"), "left")
                          .withColumn("_other", F.explode(F.when(F.col("_salts").isNotNull(), everywhere).otherwise(F.array(zero("_r_"))))).drop("_salts", *names))
        # One key of keys and salt: with keys of their own the planner may take a side that is already placed by key as it is,
        # and place the other one by key alone.  NULL fields of equal place are equal; where they must not be, the right side has none.
        wide = lambda k: left.select(k).union(right.select(f"_r_{k}")).schema[0].dataType
        same = (F.struct(*[F.col(k).cast(wide(k)).alias(f"k{i}") for i, k in enumerate(on)], F.col("_salt").alias("s"))
                == F.struct(*[F.col(f"_r_{k}").cast(wide(k)).alias(f"k{i}") for i, k in enumerate(on)], F.col("_other").alias("s")))
    out = left.join(right, same, how)
    kept = [c for c in left.columns if c not in on and c != "_salt"]
    return out.select(*on, *kept, *([] if how in ("left_semi", "left_anti") else values))


def semi_join(df: DataFrame, ids: DataFrame, on: list[str], measure: DataFrame | None = None) -> DataFrame:
    """Rows whose key is among ``ids``; a key with very many rows is spread.

    ``measure`` is a cheaper frame with the same keys to look for hot ones.
    """
    wanted = ids.select(*on).distinct()
    return salted_join(df, wanted, on, "left_semi", hot=find_sized(df if measure is None else measure, on))
