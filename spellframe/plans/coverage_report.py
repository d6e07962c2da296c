"""Coverage report: every diagnostic in one tidy table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diagnostics as D
from .clean import Cleaned
from .config import HistoryConfig


def join_coverage(joins: DataFrame) -> DataFrame:
    """Unmatched, NULL-key and multiplied rows of each audited join."""
    cells = F.array(*[F.struct(F.lit(m).alias("_m"), F.col(m).cast("bigint").alias("value"))
                      for m in ("unmatched_rows", "left_null_key_rows", "row_multiplication_if_naive")])
    rows = joins.where(F.col("status") == "ok").select("name", "left_table", "right_table", "left_rows", F.inline(cells))
    return D.tidy(rows, "join_coverage", measure=F.concat_ws(":", "name", "_m"), period_type="all", period="all", country_group="All",
                  denominator=F.col("left_rows"), note=F.concat_ws(" -> ", "left_table", "right_table"))


def duplicate_coverage(cleaned: Cleaned) -> DataFrame:
    names = ("exact_duplicate_rows_collapsed", "conflicting_keys", "rows_in_conflicting_keys", "null_key_rows")
    parts = []
    for table, d in cleaned.dedupe.items():
        cells = F.array(*[F.struct(F.lit(f"{table}:{n}").alias("measure"), F.col(n).alias("value")) for n in names])
        parts.append(d.counts.select(F.col("rows_in").alias("denominator"), F.inline(cells)))
    return D.tidy(reduce(DataFrame.unionByName, parts), "duplicates", period_type="all", period="all", country_group="All")


def title_coverage(positions: DataFrame) -> DataFrame:
    rows = positions.groupBy("title_status").agg(F.count(F.lit(1)).alias("value"))
    return D.tidy(rows, "join_coverage", measure=F.concat_ws(":", F.lit("position_title"), "title_status"), period_type="all",
                  period="all", country_group="All", note="by what became of the title of each spell")


def coverage_report(cleaned: Cleaned, panel: DataFrame, cfg: HistoryConfig, months_since: str, joins: DataFrame | None = None) -> DataFrame:
    """All sections; spells, users and panel should be staged, each is read once per grain."""
    total = cleaned.dedupe["positions"].counts.select("rows_in").scalar()
    people = cleaned.users.agg(F.count_if(F.col("n_positions") > 0).alias("p")).scalar()
    parts = [D.activity_by_year(cleaned.valid, cfg), D.missing_by_year(cleaned.valid),
             D.quarantine_summary(cleaned.quarantine, total, people, cfg),
             D.profile_refresh(cleaned.users, cfg, months_since), D.population_counts(cleaned.users),
             D.quarterly_activity(panel, cfg), D.overlap_effects(panel, cfg), D.category_period_coverage(panel, cfg),
             D.partial_period(cleaned.valid, cleaned.users, cfg), duplicate_coverage(cleaned)]
    if "title_status" in cleaned.positions.columns:
        parts.append(title_coverage(cleaned.positions))
    if joins is not None:
        parts.append(join_coverage(joins))
    return D.finalise(reduce(DataFrame.unionByName, parts), cfg)
