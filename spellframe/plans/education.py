"""Education diagnostic: school by year counts, window split, text clues."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.coverage import dense_pivot, group_counts, text_clues, window_split
from ..operators.joins import validated_merge

MISSING = "[missing]"


def clean_label(c) -> Column:
    """White space collapsed and trimmed; nothing left becomes '[missing]'."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", " "))
    return F.when(text == "", MISSING).otherwise(text)


class Education(NamedTuple):
    school_year: DataFrame
    school_coverage: DataFrame
    target_records: DataFrame
    target_people: DataFrame
    generic_field_degree_year: DataFrame
    generic_field_degree: DataFrame
    raw_field_degree_year: DataFrame
    clues: DataFrame
    summary: DataFrame


def labelled_education(education: DataFrame, schools: DataFrame) -> DataFrame:
    """Education with the mapped school's name and country (many-to-one, checked)."""
    joined = validated_merge(education, schools.select("rsid", "school_name", "country"), ["rsid"])
    return (joined.withColumn("clean_school", clean_label(F.coalesce("school_name", "university_name")))
            .withColumn("field_of_study", clean_label("field")).withColumn("degree", clean_label("degree"))
            .withColumn("education_end_year", F.year("enddate")))


def education_diagnostic(education: DataFrame, schools: DataFrame, raw: DataFrame, home: str, targets: list[str], generic: str,
                         clues: dict[str, str], lo: int, hi: int) -> Education:
    all_rows = labelled_education(education, schools)
    rows = all_rows.where(F.col("country") == home)
    inside = F.col("education_end_year").between(lo, hi)
    window = rows.where(inside)
    target = group_counts(window.where(F.col("clean_school").isin(*targets)), ["clean_school", "education_end_year"])
    pivot = lambda metric: dense_pivot(target, "education_end_year", "clean_school", metric, lo, hi, targets)
    generic_rows = rows.where(F.col("clean_school") == generic)
    keys = ["user_id", "education_number"]
    with_raw = validated_merge(generic_rows, raw.select(*keys, "university_raw", "degree_raw", "field_raw", "description"), keys,
                               validate="one_to_one", indicator="_merge")
    cleaned = with_raw.withColumn("field_raw", clean_label("field_raw")).withColumn("degree_raw", clean_label("degree_raw"))
    is_generic = (F.col("country") == home) & (F.col("clean_school") == generic)
    at_home = F.col("country") == home
    other = ~F.coalesce("country", F.lit(MISSING)).eqNullSafe(F.coalesce("university_country", F.lit(MISSING)))
    summary = all_rows.agg(
        F.count_if(at_home).alias("home_records"), F.count_distinct(F.when(at_home, F.col("user_id"))).alias("home_people"),
        F.count_if(other).alias("country_disagreements"), F.count_if(is_generic).alias("generic_records"),
        F.count_distinct(F.when(is_generic, F.col("user_id"))).alias("generic_people"),
        F.count_if(is_generic & inside).alias("generic_window_records"),
        F.count_if(is_generic & F.col("education_end_year").isNull()).alias("generic_missing_end_year"),
        F.count_if(is_generic & (F.col("field_of_study") == MISSING)).alias("generic_missing_field"),
        F.count_if(is_generic & (F.col("degree") == MISSING)).alias("generic_missing_degree"))
    unmatched = cleaned.agg(F.count_if(F.col("_merge") == "left_only").alias("n")).scalar()
    return Education(
        group_counts(window, ["clean_school", "education_end_year"]),
        group_counts(rows, ["clean_school"]).join(window_split(rows, "clean_school", "education_end_year", lo, hi).drop("records"), "clean_school"),
        pivot("records"), pivot("people"),
        group_counts(generic_rows, ["field_of_study", "degree", "education_end_year"]),
        group_counts(generic_rows, ["field_of_study", "degree"]),
        group_counts(cleaned, ["field_raw", "degree_raw", "education_end_year"]),
        text_clues(cleaned, ["university_raw", "degree_raw", "field_raw", "description"], clues,
                   ["field_of_study", "degree", "education_end_year"]),
        summary.withColumn("generic_unmatched_raw", unmatched))
