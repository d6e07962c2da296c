"""Monthly posting counts, dense series, rolling means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def monthly_trend(df: DataFrame, date: str, flag: str) -> DataFrame:
    return df.groupBy(F.trunc(F.to_date(date), "month").alias("month")).agg(
        F.count(F.lit(1)).alias("all_ads"), F.count_if(F.col(flag)).alias("flagged_ads"),
        F.min(F.to_date(date)).alias("first_date"), F.max(F.to_date(date)).alias("last_date"))


def trend_problems(trend: DataFrame, total_rows: int) -> DataFrame:
    got = trend.agg(F.coalesce(F.sum("all_ads"), F.lit(0)).alias("rows"), F.count_if(F.col("flagged_ads") > F.col("all_ads")).alias("over"))
    return got.select(F.explode(F.array_compact(F.array(
        F.when(F.col("rows") != total_rows, F.lit("monthly counts do not reconcile")),
        F.when(F.col("over") > 0, F.lit("flagged rows exceed all rows"))))).alias("problem"))


def monthly_series(trend: DataFrame) -> DataFrame:
    """Every month from the first flagged one to the last observed one, with share and partial flag."""
    span = trend.agg(F.min(F.when(F.col("flagged_ads") > 0, F.col("month"))).alias("lo"), F.max("month").alias("hi"),
                     F.max("last_date").alias("last"))
    spine = span.select(F.explode(F.when(F.col("lo") <= F.col("hi"), F.expr("sequence(lo, hi, interval 1 month)"))).alias("month"),
                        "hi", "last")
    flagged, total = F.coalesce("flagged_ads", F.lit(0)), F.coalesce("all_ads", F.lit(0))
    return spine.join(trend.select("month", "all_ads", "flagged_ads"), "month", "left").select(
        "month", flagged.alias("flagged_ads"), total.alias("all_ads"),
        F.when(total > 0, F.round(F.lit(100.0) * flagged / total, 3)).otherwise(0.0).alias("share_percent"),
        ((F.col("month") == F.col("hi")) & (F.col("last") < F.last_day("last"))).alias("partial_last_month"))


def rolling_mean(series: DataFrame, value: str = "flagged_ads", periods: int = 12) -> DataFrame:
    """Mean of the last ``periods`` complete months, NULL before; the series has one row per month."""
    w = Window.partitionBy("partial_last_month").orderBy("month").rowsBetween(-(periods - 1), 0)
    full = (F.count(value).over(w) == periods) & ~F.col("partial_last_month")
    return series.withColumn("rolling_mean", F.when(full, F.avg(value).over(w)))


def annual_counts(series: DataFrame, value: str = "flagged_ads") -> DataFrame:
    return series.groupBy(F.year("month").alias("year")).agg(F.sum(value).alias("ads"))


def peak_period(series: DataFrame, value: str = "flagged_ads") -> DataFrame:
    """Latest among the complete months with the highest count."""
    best = F.max_by("month", F.struct(value, "month"))
    return series.where(~F.col("partial_last_month")).agg(best.alias("peak_month"), F.max(value).alias("peak_ads"))
