"""Counts by category with distinct people, whole or by disjoint id ranges.

Everything starts from one aggregate per (category, person) pair, which collapses hot
people and hot categories map-side; the category counts and the grand total are then
small aggregates over pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blank_to_null

COUNTS = ("position_records", "people", "missing_person_records")


def _pairs(df: DataFrame, category: str, person: str, numeric: bool, extra: list[Column] = ()) -> DataFrame:
    ident = F.col(person) if numeric else blank_to_null(F.col(person).cast("string"))
    return (df.select(blank_to_null(F.col(category).cast("string")).alias("country"), ident.alias("_person"), *extra)
              .groupBy("country", "_person", *[c for c in (["_range"] if extra else [])])
              .agg(F.count(F.lit(1)).alias("_n")))


def _count(grouped) -> DataFrame:
    absent = F.when(F.col("_person").isNull(), F.col("_n"))
    return grouped.agg(F.coalesce(F.sum("_n"), F.lit(0).cast("bigint")).alias("position_records"),
                       F.count("_person").alias("people"),
                       F.coalesce(F.sum(absent), F.lit(0).cast("bigint")).alias("missing_person_records"))


def _sets(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The grouping sets (by, category) and (by) over pairs.

    Written as two aggregates that share the pair shuffle: GROUPING SETS would first copy
    every pair, and copy it again through the distinct count.
    """
    each = _count(pairs.groupBy(*by, "country")).withColumn("is_total", F.lit(0))
    people = pairs.groupBy(*by, "_person").agg(F.sum("_n").alias("_n"))
    total = _count(people.groupBy(*by)).withColumn("is_total", F.lit(1)).withColumn("country", F.lit(None).cast("string"))
    return each.unionByName(total)


def coverage(df: DataFrame, category: str, person: str, numeric_person: bool = False) -> DataFrame:
    """Rows, distinct people and rows without a person: per category and in total."""
    return _sets(_pairs(df, category, person, numeric_person), []).select("country", "is_total", *COUNTS)


def coverage_ranges(df: DataFrame, category: str, person: str, width: int) -> DataFrame:
    """The same counts per half-open id range [lo, lo+width) and for rows without an id, in one job."""
    low = df.agg(F.coalesce(F.floor(F.min(person)), F.lit(0)).alias("lo")).scalar()
    slot = F.floor((F.col(person) - low) / F.lit(width))
    parts = _sets(_pairs(df, category, person, True, [slot.alias("_range")]), ["_range"])
    lo = (low + F.col("_range") * width).cast("bigint")
    return parts.select(lo.alias("range_lo"), (lo + width).alias("range_hi"), "country", "is_total", *COUNTS)


def merge_partials(*parts: DataFrame) -> DataFrame:
    """Add partial counts; exact because every person belongs to one range only."""
    both = parts[0].select("country", "is_total", *COUNTS)
    for p in parts[1:]:
        both = both.unionByName(p.select("country", "is_total", *COUNTS))
    return both.groupBy("country", "is_total").agg(*[F.sum(c).alias(c) for c in COUNTS])


def coverage_summary(cov: DataFrame) -> DataFrame:
    """Categories with shares, largest first; a missing category is 'Unknown' and flagged."""
    total = cov.where("is_total = 1").select("position_records").scalar()
    rows = cov.where("is_total = 0").select(
        F.coalesce("country", F.lit("Unknown")).alias("country"), F.col("country").isNull().alias("country_missing"),
        *COUNTS, F.when(total > 0, F.lit(100.0) * F.col("position_records") / total).otherwise(0.0)
        .alias("position_share_pct"))
    return rows.orderBy(F.col("position_records").desc(), "country", "country_missing")


def coverage_totals(cov: DataFrame) -> DataFrame:
    total = F.col("is_total") == 1
    pick = [F.sum(F.when(total, F.col(c))).alias(c) for c in COUNTS]
    unknown = ~total & F.col("country").isNull()
    return cov.agg(*pick, F.count_if(~total & F.col("country").isNotNull()).alias("named_countries"),
                   F.coalesce(F.sum(F.when(unknown, F.col("position_records"))), F.lit(0).cast("bigint"))
                   .alias("unknown_country_position_records"))


def coverage_problems(cov: DataFrame) -> DataFrame:
    """Inconsistent counts; empty when all seven checks hold."""
    total, n = F.col("is_total") == 1, F.col("position_records")
    got = cov.agg(
        F.count_if(total).alias("totals"),
        F.count_if(F.greatest(*[F.coalesce(F.col(c) < 0, F.lit(True)).cast("int") for c in COUNTS]) == 1).alias("invalid"),
        F.count_if(F.col("people") + F.col("missing_person_records") > n).alias("excess"),
        *[F.sum(F.when(total, F.col(c))).alias(f"t_{c}") for c in COUNTS],
        *[F.coalesce(F.sum(F.when(~total, F.col(c))), F.lit(0)).alias(f"s_{c}") for c in COUNTS],
        F.max(F.when(~total, F.col("people"))).alias("max_people"))
    share = F.when(F.col("t_position_records") > 0, F.lit(100.0) * F.col("s_position_records") / F.col("t_position_records"))
    rules = [(F.col("totals") != 1, "expected exactly one total"), (F.col("invalid") > 0, "invalid count"),
             (F.col("excess") > 0, "people exceed records"),
             (F.col("s_position_records") != F.col("t_position_records"), "category records do not add up"),
             (F.col("s_missing_person_records") != F.col("t_missing_person_records"), "missing ids do not add up"),
             (F.col("max_people") > F.col("t_people"), "category people exceed the total"),
             (F.abs(share - 100) > 1e-8, "shares do not sum to 100")]
    return got.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))).alias("problem"))


def group_counts(df: DataFrame, keys: list[str], person: str = "user_id") -> DataFrame:
    """Rows and distinct people per key combination, NULL keys kept, largest first."""
    pairs = df.groupBy(*keys, person).agg(F.count(F.lit(1)).alias("_n"))
    return (pairs.groupBy(*keys).agg(F.sum("_n").alias("records"), F.count(person).alias("people"))
                 .orderBy(F.col("records").desc(), *[F.col(k).asc_nulls_last() for k in keys]))


def contract(df: DataFrame, keys: list[str]) -> DataFrame:
    """Frequency table."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("frequency"))


def dense_pivot(counts: DataFrame, index: str, column: str, value: str, lo: int, hi: int, targets: list) -> DataFrame:
    """Index range x listed columns with 0 for empty cells."""
    spark = counts.sparkSession
    spine = spark.range(lo, hi + 1).select(F.col("id").cast("int").alias(index))
    wide = (counts.where(F.col(column).isin(*targets) & F.col(index).between(lo, hi))
                  .groupBy(index).pivot(column, targets).agg(F.sum(value)))
    return spine.join(wide, index, "left").na.fill(0)


def window_split(df: DataFrame, group: str, year: str, lo: int, hi: int) -> DataFrame:
    """Records per group that miss the year, lie before, in or after [lo, hi]."""
    y = F.col(year)
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(y.isNull()).alias("missing_year"),
        F.count_if(y < lo).alias("before_window"), F.count_if(y.between(lo, hi)).alias("in_window"),
        F.count_if(y > hi).alias("after_window"))


def text_clues(df: DataFrame, columns: list[str], clues: dict[str, str], keys: list[str], person: str = "user_id") -> DataFrame:
    """Rows whose joined text fields match a clue, counted per clue and keys; clues may overlap."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    hits = F.array_compact(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(n)) for n, p in clues.items()]))
    return group_counts(df.withColumn("explicit_text_clue", F.explode(hits)), ["explicit_text_clue", *keys], person)
