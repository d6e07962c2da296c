"""Cleaning job: sound keys, joined titles and look-ups, quarantined spells, user universe."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (blank_to_null, distinct_from, first_reason, month_index, normalize_text,
                         quarter_of_month, taxonomy_match, taxonomy_rule_ids, title_status)
from ..operators.joins import membership_flag
from ..operators.quality import Deduplicated, dedupe_quarantine
from ..operators.skew import find_sized, salted_join
from .config import HistoryConfig

TEXT_FIELDS = ("country", "state", "metro_area", "city", "region", "msa")


class Cleaned:
    """Outcome of ``clean``; the quarantine frames are planned only when asked for."""

    def __init__(self, positions: DataFrame, users: DataFrame, dedupe: dict[str, Deduplicated], keys: dict[str, str]):
        self.positions = positions  # one row per sound position key, with quarantine_reason (NULL = valid)
        self.users, self.dedupe, self._keys = users, dedupe, keys

    @property
    def valid(self) -> DataFrame:
        return self.positions.where(F.col("quarantine_reason").isNull()).drop("quarantine_reason")

    @cached_property
    def quarantine(self) -> DataFrame:
        """Spells set aside by rule and by key."""
        bad = self.positions.where(F.col("quarantine_reason").isNotNull())
        return bad.unionByName(self.dedupe["positions"].quarantine, allowMissingColumns=True)

    @cached_property
    def other_quarantine(self) -> DataFrame:
        """Rows set aside in the other tables, counted per key and reason."""
        parts = [q.quarantine.groupBy(F.lit(name).alias("source_table"), F.col(self._keys[name]).cast("string").alias("key_value"),
                                      "quarantine_reason").agg(F.count(F.lit(1)).alias("rows"))
                 for name, q in self.dedupe.items() if name != "positions"]
        return reduce(DataFrame.unionByName, parts)


def join_titles(positions: DataFrame, raw: Deduplicated) -> DataFrame:
    """Title of the same position id, used only when the person matches too.

    Both sides come out of a per-key aggregate on ``position_id``: no further shuffle.
    """
    side = raw.keyed.select("position_id", F.col("conflicting").alias("_clash"), F.col("user_id").alias("_raw_user"),
                            F.col("title_raw").alias("_title"))
    joined = positions.join(side, "position_id", "left")
    status = title_status(F.col("_clash").isNotNull(), F.coalesce("_clash", F.lit(False)),
                          ~distinct_from("_raw_user", "user_id"), F.col("_title"))
    return (joined.withColumn("title_status", status)
                  .withColumn("title_raw", F.when(F.col("title_status") == "ok", blank_to_null("_title")))
                  .drop("_clash", "_raw_user", "_title"))


def attach_lookup(positions: DataFrame, lookup: Deduplicated, key: str, flag: str, measure: DataFrame) -> DataFrame:
    """Many-to-one look-up; flags keys the look-up does not know.

    The planner broadcasts a look-up whose measured size allows it; otherwise popular keys
    are spread.
    """
    side = lookup.kept.withColumn("_known", F.lit(True))
    return (salted_join(positions, side, [key], hot=find_sized(measure, [key]))
            .withColumn(flag, F.when(F.col(key).isNotNull() & F.col("_known").isNull(), True)).drop("_known"))


def quarantine_rules(cfg: HistoryConfig) -> list:
    return [(F.col("user_id").isNull(), "missing_key"),
            (~F.col("in_cohort"), "user_not_in_cohort"),
            (F.col("startdate").isNull() & F.col("enddate").isNull(), "undated"),
            (F.col("startdate").isNull(), "missing_start_date"),
            (F.col("startdate") < F.lit(cfg.min_valid_start).cast("date"), "start_before_min_valid"),
            (F.col("start_midx") > cfg.cutoff_midx, "start_after_cutoff"),
            (F.col("end_midx") < F.col("start_midx"), "end_before_start")]


def apply_rules(positions: DataFrame, cfg: HistoryConfig) -> DataFrame:
    texts = [c for c in TEXT_FIELDS if c in positions.columns]
    out = (positions.withColumns({c: blank_to_null(c) for c in texts})
           .withColumns({"start_midx": month_index("startdate"), "end_midx": month_index("enddate"),
                         "open_ended": F.col("enddate").isNull(),
                         "home_position": F.col("country") == cfg.home}))
    if "title_raw" in positions.columns:
        out = out.withColumn("_norm", normalize_text("title_raw", cfg.taxonomy))
        out = (out.withColumn("role_rule_category", taxonomy_match("_norm", cfg.taxonomy))
                  .withColumn("role_rule_ids", F.when(F.col("role_rule_category").isNull(), F.array().cast("array<string>"))
                              .otherwise(taxonomy_rule_ids("_norm", cfg.taxonomy))).drop("_norm"))
    else:
        out = out.withColumn("role_rule_category", F.lit(None).cast("string"))
    return (out.withColumn("role_downranked", F.col("role_rule_category").isNotNull())
               .withColumn("quarantine_reason", first_reason(quarantine_rules(cfg))))


def user_universe(positions: DataFrame, cohort: Deduplicated, users: Deduplicated, cfg: HistoryConfig) -> DataFrame:
    """Everyone in the cohort or with a profile row, with profile status and spell counts.

    Cohort, profiles and per-person spell counts meet in a single aggregate on ``user_id``.
    """
    columns = [c for c in users.keyed.columns if c not in ("user_id", "conflicting")]
    valid = F.col("quarantine_reason").isNull()
    counts = (positions.where(F.col("user_id").isNotNull()).groupBy("user_id")
              .agg(F.count(F.lit(1)).alias("_n"), F.count_if(valid).alias("_v"),
                   F.count_if(valid & F.col("home_position")).alias("_h")))
    rows = [cohort.keyed.select("user_id", F.lit(True).alias("_c")),
            users.keyed.select("user_id", F.col("conflicting").alias("_clash"), F.struct(*columns).alias("_row")),
            counts]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).groupBy("user_id").agg(
        F.max("_c").alias("_c"), F.max("_clash").alias("_clash"), F.first("_row", ignorenulls=True).alias("_row"),
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("_n", "_v", "_h")])
    known = merged.where(F.col("_c") | F.col("_clash").isNotNull())
    out = known.select(
        "user_id", F.coalesce("_c", F.lit(False)).alias("in_cohort"),
        F.when(F.col("_clash"), "conflicting_duplicate_key").when(~F.col("_clash"), "ok")
         .otherwise("no_profile_row").alias("profile_status"),
        *[F.col("_row")[c].alias(c) for c in columns],
        F.col("_n").alias("n_positions"), F.col("_v").alias("n_valid_positions"),
        F.col("_h").alias("n_valid_home_positions"), (F.col("_v") == 0).alias("profile_only"))
    refresh = month_index("updated_dt")
    return (out.withColumn("user_country", blank_to_null("user_country")).withColumn("refresh_midx", refresh)
               .withColumn("refresh_qidx", quarter_of_month("refresh_midx")))


def clean(positions: DataFrame, users: DataFrame, cohort: DataFrame, cfg: HistoryConfig,
          positions_raw: DataFrame | None = None, lookups: dict[str, tuple[DataFrame, str, str]] | None = None,
          keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> Cleaned:
    """``lookups``: name -> (frame, key column, flag column for unknown keys).

    ``keep`` is applied to the frames that later steps read several times: the keys of each table (kept rows, counts and
    quarantine come from them), the spells and the people; pass ``session.stage`` to write them once.
    """
    dedupe = lambda name, df, key, columns: dedupe_quarantine(df, [key], columns, lambda k: keep(k, f"{name}_keys"))
    rest = lambda df, *keys: [c for c in df.columns if c not in keys]
    d = {"positions": dedupe("positions", positions, "position_id", rest(positions, "position_id")),
         "users": dedupe("users", users, "user_id", rest(users, "user_id")),
         "cohort": dedupe("cohort", cohort.select("user_id"), "user_id", [])}
    joined = d["positions"].kept
    if positions_raw is not None:
        d["raw_titles"] = dedupe("raw_titles", positions_raw, "position_id", ["user_id", "title_raw"])
        joined = join_titles(joined, d["raw_titles"])
    keys = {"positions": "position_id", "users": "user_id", "cohort": "user_id", "raw_titles": "position_id"}
    for name, (frame, key, flag) in (lookups or {}).items():
        d[name] = dedupe(name, frame, key, rest(frame, key))
        keys[name] = key
        joined = attach_lookup(joined, d[name], key, flag, positions)
    joined = membership_flag(joined, d["cohort"].kept, "user_id", "in_cohort", measure=d["positions"].kept)
    ruled = keep(apply_rules(joined, cfg), "positions")
    universe = keep(user_universe(ruled, d["cohort"], d["users"], cfg), "users")
    return Cleaned(ruled, universe, d, keys)


def dedupe_report(cleaned: Cleaned) -> DataFrame:
    """One row of duplicate counts per table."""
    return reduce(DataFrame.unionByName,
                  [q.counts.withColumn("source_table", F.lit(n)) for n, q in cleaned.dedupe.items()])


def clean_summary(cleaned: Cleaned) -> DataFrame:
    """Long report (section, label, rows): quarantine reasons, title status, rule categories, users."""
    p, u = cleaned.positions, cleaned.users
    one = F.count(F.lit(1)).alias("rows")
    parts = [p.groupBy(F.lit("positions_by_quarantine_reason").alias("section"),
                       F.coalesce("quarantine_reason", F.lit("valid")).alias("label")).agg(one)]
    if "title_status" in p.columns:
        parts.append(p.groupBy(F.lit("title_status").alias("section"), F.col("title_status").alias("label")).agg(one))
    parts.append(p.where(F.col("quarantine_reason").isNull()).groupBy(
        F.lit("role_rule_category_valid").alias("section"),
        F.coalesce("role_rule_category", F.lit("none")).alias("label")).agg(one))
    counts = {"users": F.lit(True), "in_cohort": F.col("in_cohort"), "with_profile": F.col("profile_status") == "ok",
              "profile_only": F.col("profile_only"), "with_valid_positions": ~F.col("profile_only")}
    wide = u.agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    parts.append(wide.select(F.inline(F.array(*[F.struct(F.lit("users").alias("section"), F.lit(n).alias("label"),
                                                         F.col(n).alias("rows")) for n in counts]))))
    return reduce(DataFrame.unionByName, parts)
