"""Cohorts and everything linked to them, selected by semi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .joins import semi_match, unmatched_count
from .skew import find_sized, salted_join, semi_join


def country_cohort(users: DataFrame, spells: DataFrame, country, person: str = "user_id",
                   home: str = "user_country", place: str = "country") -> DataFrame:
    """Residents and anyone with a spell there; NULL ids are nobody."""
    residents = users.where(F.col(home) == country).select(person)
    workers = spells.where(F.col(place) == country).select(person)
    return residents.unionAll(workers).where(F.col(person).isNotNull()).distinct()


def numeric_ids(df: DataFrame, column: str) -> DataFrame:
    """Distinct ids by numeric value, so 203 and 203.0 are one; text that is no number is kept as is."""
    value = F.col(column).cast("string")
    exact = value.try_cast("decimal(38,6)")
    whole = F.regexp_replace(exact.cast("string"), r"\.?0+$", "")
    plain = F.when(exact.isNull(), value).when(exact == F.floor(exact), exact.cast("decimal(38,0)").cast("string")).otherwise(whole)
    return df.where(F.col(column).isNotNull()).select(plain.alias(column)).distinct()


def linked_entities(sources: list[tuple[DataFrame, list[str]]], name: str = "entity_id") -> DataFrame:
    """Distinct ids named by any of (frame, id columns); each frame is read once."""
    parts = []
    for df, columns in sources:
        ids = F.array(*[F.col(c).cast("string") for c in columns])
        parts.append(df.select(F.explode(ids).alias(name)))
    return numeric_ids(reduce(DataFrame.unionAll, parts), name)


PERSON_TABLES = ("individual_user", "individual_user_raw", "individual_user_skills")
COMPANY_TABLES = ("company_mapping", "sentiment_scores", "layoffs")
COUNTRY_TABLES = ("workforce_dynamics_geo", "sentiment_individual_reviews", "regions")


def _in(df: DataFrame, ids: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose id equals one of ``ids`` by value."""
    number = lambda c: F.coalesce(F.col(c).cast("string").try_cast("decimal(38,6)").cast("string"), F.col(c).cast("string"))
    wanted = ids.select(number(key).alias("_id"))
    return semi_join(df.withColumn("_id", number(column)), wanted, ["_id"]).drop("_id")


def linked_extract(tables: dict[str, DataFrame], country, keep=lambda df, name: df) -> dict[str, DataFrame]:
    """One selection per product table, plus ``people_cohort``.

    Keys are table names; a table that is not given is not selected, the core tables are
    required.  The closure is a handful of id sets (people, companies, schools and the keys of raw records); ``keep`` is applied to
    each, distinct and in order.  Pass ``session.stage`` to write them once: products are then plain selections by them.
    """
    def kept(ids: DataFrame, name: str) -> DataFrame:
        return keep(ids.distinct().repartitionByRange(*ids.columns).sortWithinPartitions(*ids.columns), name)

    core = ["individual_positions", "individual_user", "postings_cosmos", "company_mapping", "school_mapping",
            "individual_user_education", "sentiment_individual_reviews", "workforce_dynamics_geo"]
    missing = [t for t in core if t not in tables]
    if missing:
        raise ValueError(f"cannot define a complete selection; missing {missing}")
    t = tables
    here = F.col("country") == country
    cohort = kept(country_cohort(t["individual_user"], t["individual_positions"], country), "people")
    member = semi_join(t["individual_positions"], cohort, ["user_id"])
    positions = member.unionByName(t["individual_positions"].where(F.col("user_id").isNull() & here))
    postings = t["postings_cosmos"].where(here)
    education = semi_join(t["individual_user_education"], cohort, ["user_id"])
    companies, schools = linked_companies_schools(t, positions, postings, education, country)
    companies, schools = kept(companies, "companies"), kept(schools, "schools")
    raw_keys = {"individual_positions_raw": (positions, ["user_id", "position_id"], ["user_id"]),
                "individual_user_education_raw": (education, ["user_id", "education_number"], []), "postings_cosmos_raw": (postings, ["job_id"], [])}
    out = {}
    for name, df in t.items():
        if name == "individual_positions":
            out[name] = positions
        elif name == "postings_cosmos":
            out[name] = postings
        elif name == "individual_user_education":
            out[name] = education
        elif name in raw_keys:
            selected, columns, nullable = raw_keys[name]
            out[name] = semi_match(df, kept(selected.select(*columns), name), columns, nullable)
        elif name in PERSON_TABLES:
            out[name] = semi_join(df, cohort, ["user_id"])
        elif name in COMPANY_TABLES:
            out[name] = _in(df, companies, "rcid", "entity_id")
        elif name == "school_mapping":
            out[name] = _in(df, schools, "rsid", "entity_id")
        elif name in COUNTRY_TABLES:
            out[name] = df.where(here)
        else:
            out[name] = df
    out["people_cohort"] = cohort
    return out


def content_sums(df: DataFrame) -> DataFrame:
    """One row: number of rows and two sums over 32-bit pieces of each row's MD5, in any order of the rows."""
    line = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns]))
    piece = lambda at: F.coalesce(F.sum(F.conv(F.substring(line, at, 8), 16, 10).cast("bigint")), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("rows"), piece(1).alias("content_a"), piece(9).alias("content_b"))


def linked_companies_schools(t: dict[str, DataFrame], positions: DataFrame, postings: DataFrame, education: DataFrame,
                             country) -> tuple[DataFrame, DataFrame]:
    here = F.col("country") == country
    both = ["rcid", "ultimate_parent_rcid"]
    companies = linked_entities([
        (t["company_mapping"].where(F.col("hq_country") == country), ["rcid"]), (positions, both), (postings, both),
        (t["sentiment_individual_reviews"].where(here), both), (t["workforce_dynamics_geo"].where(here), ["rcid"])])
    schools = linked_entities([(t["school_mapping"].where(here), ["rsid"]), (education, ["rsid"])])
    return companies, schools


def unmatched_raw(selected: dict[str, DataFrame], tables: dict[str, DataFrame]) -> DataFrame:
    """Structured rows without a raw record, per raw table."""
    plan = [("individual_positions", "individual_positions_raw", ["user_id", "position_id"], ["user_id"]),
            ("individual_user_education", "individual_user_education_raw", ["user_id", "education_number"], []),
            ("postings_cosmos", "postings_cosmos_raw", ["job_id"], [])]
    parts = [unmatched_count(selected[s], tables[r], keys, nulls).withColumn("raw_table", F.lit(r))
             for s, r, keys, nulls in plan if r in tables]
    return reduce(DataFrame.unionByName, parts)


def ordered_rank(df: DataFrame, key: str, name: str = "rank0") -> DataFrame:
    """Distinct non-NULL keys with their 0-based position in ascending order.

    Range-partitioned and written once, ranked inside each part and shifted by the sizes of
    the parts before it: the total order never passes through one task.
    """
    parts = stage(df.where(F.col(key).isNotNull()).select(key).distinct().repartitionByRange(key)
                    .withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    shifts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_part").orderBy(key)
    ranked = parts.withColumn("_row", F.row_number().over(inside) - 1)
    return ranked.join(F.broadcast(shifts), "_part").select(key, (F.col("_row") + F.col("_shift")).cast("bigint").alias(name))


def split_disjoint(df: DataFrame, key: str, size: int, batch: str = "batch") -> DataFrame:
    """Rows with a batch number: consecutive groups of ``size`` ids, -1 for rows without an id."""
    if size < 1:
        raise ValueError("batch size must be positive")
    slots = ordered_rank(df, key).select(key, F.floor(F.col("rank0") / size).alias(batch))
    some = df.where(F.col(key).isNotNull())
    keyed = salted_join(some, slots, [key], hot=find_sized(some, [key]))
    return keyed.unionByName(df.where(F.col(key).isNull()).withColumn(batch, F.lit(-1).cast("bigint")))
