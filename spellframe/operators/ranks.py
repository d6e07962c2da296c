"""Exact quantiles of dates and numbers by narrowing intervals."""

from __future__ import annotations

import datetime
import decimal
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V
from ..session import stage

#: Intervals that a round cuts each remaining interval into.
BINS = 1_024
_EPOCH = datetime.date(1970, 1, 1)
_START = datetime.datetime(1970, 1, 1)


def _as_number(column: str, kind: T.DataType):
    """(number that keeps the order, function back to a Python value of the type)."""
    c = F.col(column)
    if isinstance(kind, T.DateType):
        return F.unix_date(c), lambda v: _EPOCH + datetime.timedelta(days=v)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp")) + F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp")) * -1, lambda v: _START + datetime.timedelta(microseconds=v)
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (c * F.lit(10**kind.scale)).cast("long"), lambda v: decimal.Decimal(v).scaleb(-kind.scale)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long"), int
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return c.cast("double"), float
    raise ValueError(f"no quantiles of {kind.simpleString()}")


def _bin(low, high) -> Column:
    """Bin of a value of [low, high]: rising with the value, 0 only towards low and BINS - 1 for high, so that every round narrows."""
    v = F.col("v")
    share = (v.cast("double") / 2 - low / 2) / max(high / 2 - low / 2, 5e-324)
    inner = F.least(F.floor(F.nanvl(share, F.lit(0.5)) * BINS), F.lit(BINS - 2))
    return F.when(v == F.lit(high), BINS - 1).when(v == F.lit(low), 0).otherwise(F.greatest(inner, F.lit(0)).cast("int"))


def discrete_quantiles(df: DataFrame, column: str, levels=V.REFRESH_QUANTILES) -> DataFrame:
    """(level, quantile): smallest value with at least that share of values at or below it; NULL and NaN don't count.

    Values are counted once.  Each round counts the remaining interval of every level in BINS bins, all levels in
    one pass, and keeps the bin that holds the rank; a bin of one value is the answer.  A round sends at most BINS rows per
    level to the driver, and no row order is made anywhere.
    """
    kind = df.schema[column].dataType
    number, back = _as_number(column, kind)
    values = df.select(number.alias("v")).where("v IS NOT NULL")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        values = values.where(~F.isnan("v"))
    counts = stage(values.groupBy("v").agg(F.count(F.lit(1)).alias("n")), "value_counts")
    total, least, most = counts.agg(F.sum("n"), F.min("v"), F.max("v")).first()
    found = {}
    if total:
        rank = {p: max(1, total - math.floor(total - p * total)) for p in levels}
        state = dict.fromkeys(levels, (least, most, 0))  # interval, and how many values come before it
        while True:
            found |= {p: low for p, (low, high, _) in state.items() if low == high}
            state = {p: s for p, s in state.items() if p not in found}
            if not state:
                break
            spans = sorted({(low, high) for low, high, _ in state.values()})
            places = [F.when(F.col("v").between(F.lit(low), F.lit(high)), F.struct(F.lit(i).alias("i"), _bin(low, high).cast("int").alias("b"))) for i, (low, high) in enumerate(spans)]
            cells = counts.select("v", "n", F.explode(F.array_compact(F.array(*places))).alias("at")).groupBy("at.i", "at.b").agg(
                F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
            for p, (low, high, before) in state.items():
                for cell in sorted((c for c in cells if spans[c.i] == (low, high)), key=lambda c: c.b):
                    if before + cell.n >= rank[p]:
                        state[p] = (cell.low, cell.high, before)
                        break
                    before += cell.n
    schema = T.StructType([T.StructField("level", T.DoubleType()), T.StructField("quantile", kind)])
    return df.sparkSession.createDataFrame([(p, back(found[p]) if p in found else None) for p in levels], schema)
