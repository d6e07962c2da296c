"""Runs of equal status, persistence-confirmed moves, spells and person summaries.

Every window here is partitioned by an entity whose rows are already one per period, so
its size is bounded by the number of periods.  All windows of a step share one sort, and
variants (persistence, horizon) are rows, not loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import quarter_label, same_different_unknown
from ..session import tasks_for

BY = ["user_id", "end_rule", "spec"]
NO_HORIZON = 1_000_000


def observations(panel: DataFrame, parent: str = "primary_parent_rcid", employer: str = "primary_rcid") -> DataFrame:
    """Panel rows seen under each location specification, known status only.

    Rows are placed by person before they are seen twice: runs, classes, moves and summaries all stay on that placement, over as many
    tasks as the panel (a written table; its rows are counted) asks for.
    """
    null = F.lit(None).cast("string")
    pc = F.col("loc_country_position_only")
    views = F.array(
        F.struct(F.lit(V.FALLBACK_SPEC).alias("spec"), F.col("home_fallback").alias("home"),
                 F.col("loc_country_fallback").alias("country"), F.col("loc_source_fallback").alias("source"),
                 F.col("fallback_timing").alias("timing")),
        F.struct(F.lit(V.POSITION_SPEC).alias("spec"), F.col("home_position_only").alias("home"),
                 pc.alias("country"), F.when(pc.isNotNull(), "position").alias("source"), null.alias("timing")))
    need = ["user_id", "end_rule", "qidx", "home_fallback", "loc_country_fallback", "loc_source_fallback", "fallback_timing", "home_position_only",
            "loc_country_position_only", parent, employer]
    placed = panel.select(*dict.fromkeys(need)).where(F.col("home_fallback").isNotNull() | F.col("home_position_only").isNotNull())
    placed = placed.repartition(tasks_for(panel.count()), "user_id")
    return (placed.select("user_id", "end_rule", "qidx", F.explode(views).alias("_v"),
                          F.col(parent).alias("_parent"), F.col(employer).alias("_employer"))
                 .where(F.col("_v.home").isNotNull())
                 .select("user_id", "end_rule", "qidx", F.col("_v.spec").alias("spec"), F.col("_v.home").alias("home"),
                         F.struct(F.col("_v.country").alias("country"), F.col("_v.source").alias("source"),
                                  F.col("_v.timing").alias("timing"), F.col("_parent").alias("parent"),
                                  F.col("_employer").alias("employer")).alias("obs")))


def status_runs(obs: DataFrame, by: list[str] = BY, time: str = "qidx", status: str = "home") -> DataFrame:
    """Maximal stretches of equal status inside stretches of consecutive periods.

    Only the two edge rows of a run survive the first filter, and the start row looks one
    row ahead for its end: no aggregation and a single sort.  ``obs`` (optional struct)
    is kept for both edges.
    """
    w = Window.partitionBy(*by).orderBy(time)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t, s = F.col(time), F.col(status)
    if "obs" not in obs.columns:
        obs = obs.withColumn("obs", F.lit(None).cast("struct<none:string>"))
    edged = obs.select(
        *by, time, status, "obs",
        (F.coalesce(t - F.lag(t).over(w), F.lit(2)) > 1).alias("first_in_block"),
        (~F.lag(s).over(w).eqNullSafe(s)).alias("_changed"),
        ((F.coalesce(F.lead(t).over(w) - t, F.lit(2)) > 1) | ~F.lead(s).over(w).eqNullSafe(s)).alias("_ends"))
    starts = F.col("first_in_block") | F.col("_changed")
    numbered = edged.withColumn("_starts", starts).select(
        "*", F.sum(F.col("first_in_block").cast("int")).over(so_far).cast("int").alias("block_no"),
        F.sum(F.col("_starts").cast("int")).over(so_far).cast("int").alias("run_no"))
    edges = numbered.where(F.col("_starts") | F.col("_ends"))
    here = F.col("_ends")
    return edges.select(
        *by, "block_no", "run_no", "first_in_block", F.col(status),
        F.col(time).cast("int").alias("start_q"),
        F.when(here, t).otherwise(F.lead(t).over(w)).cast("int").alias("end_q"),
        F.col("obs").alias("first_obs"),
        F.when(here, F.col("obs")).otherwise(F.lead("obs").over(w)).alias("last_obs"),
        F.col("_starts").alias("_keep")).where("_keep").drop("_keep")


def classify_runs(runs: DataFrame, variants: list[tuple[int, int]], by: list[str] = BY,
                  status: str = "home") -> DataFrame:
    """Class of each run for every (persistence, horizon) variant, plus what events need.

    Runs are cut at the horizon before their length counts.  The first run of a block, and
    any run long enough, becomes the confirmed status of what follows in the block.
    """
    combos = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(h).alias("h")) for k, h in variants])
    who = [*by, "persistence_quarters", "horizon_q"]
    cut = (runs.withColumn("_v", F.explode(combos))
               .withColumn("persistence_quarters", F.col("_v.k")).withColumn("horizon_q", F.col("_v.h"))
               .where(F.col("start_q") <= F.col("horizon_q")).drop("_v")
               .withColumn("end_q", F.least("end_q", "horizon_q"))
               .withColumn("len", F.col("end_q") - F.col("start_q") + 1)
               .withColumn("_anchor", F.when(F.col("first_in_block") | (F.col("len") >= F.col("persistence_quarters")),
                                             F.col(status))))
    person = Window.partitionBy(*who)
    along = person.orderBy("block_no", "run_no")
    ever = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # same sort as ``along``
    block = Window.partitionBy(*who, "block_no").orderBy("run_no")
    before = block.rowsBetween(Window.unboundedPreceding, -1)
    whole = block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = F.col(status)
    seen = cut.select(
        "*", F.last("_anchor", ignorenulls=True).over(before).alias("confirmed_before"),
        F.last("_anchor", ignorenulls=True).over(whole).alias("block_final"),
        F.max("block_no").over(ever).alias("last_block"),
        F.min(F.when(s, F.col("start_q"))).over(ever).alias("first_home_q"),
        (~F.lead("block_no").over(along).eqNullSafe(F.col("block_no"))).alias("last_in_block"))
    classed = seen.withColumn("run_class", F.when(F.col("first_in_block"), "block_start")
                              .when(s == F.col("confirmed_before"), "stay")
                              .when(F.col("len") >= F.col("persistence_quarters"), "confirmed_move")
                              .when(~F.col("last_in_block"), "excursion")
                              .when(F.col("block_no") < F.col("last_block"), "unconfirmed_before_gap")
                              .otherwise("unconfirmed_terminal"))
    prior = classed.select(
        "*", F.lag("block_final").over(along).alias("_prev_final"), F.lag("end_q").over(along).alias("prev_end"),
        F.lag("last_obs").over(along).alias("prev_obs"))
    moved = F.col("run_class") == "confirmed_move"
    gap = F.col("first_in_block") & (F.col("_prev_final") != s)
    flagged = (prior.withColumn("event_kind", F.when(moved, "confirmed").when(gap, "gap")).drop("_prev_final", "_anchor"))
    is_exit = F.col("event_kind").isNotNull() & ~s
    return flagged.select(
        "*", F.coalesce(F.sum(F.when(F.col("event_kind") == "confirmed", 1)).over(before),
                        F.lit(0)).alias("prior_moves_in_block"),
        F.coalesce(F.sum(F.when(is_exit, 1)).over(along.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("prior_exits"))


def transitions(classified: DataFrame, by: list[str] = BY) -> DataFrame:
    """Confirmed moves (dated) and status changes across a gap (undated), with both ends.

    Origin and destination attributes are the edge observations of neighbouring runs, so no
    look-up join back to the panel is needed.
    """
    entry = F.col("home")
    confirmed = F.col("event_kind") == "confirmed"
    o, d = F.col("prev_obs"), F.col("first_obs")
    return classified.where(F.col("event_kind").isNotNull()).select(
        *by, "persistence_quarters", "horizon_q",
        F.col("start_q").alias("event_q"), F.col("prev_end").alias("origin_q"), F.col("event_kind").alias("kind"),
        F.when(entry, "entry").otherwise("exit").alias("direction"),
        F.when(confirmed, F.col("len")).alias("destination_run_quarters"),
        F.when(~confirmed, F.col("start_q") - F.col("prev_end") - 1).alias("gap_quarters"),
        "block_no", F.when(confirmed, F.col("prior_moves_in_block")).alias("prior_moves_in_block"),
        F.when(F.when(entry, F.col("start_q") == F.col("first_home_q")).otherwise(F.col("prior_exits") == 0), "first")
         .otherwise("return").alias("home_spell_type"),
        o["country"].alias("origin_country"), d["country"].alias("destination_country"),
        o["source"].alias("origin_location_source"), d["source"].alias("destination_location_source"),
        o["timing"].alias("origin_fallback_timing"), d["timing"].alias("destination_fallback_timing"),
        o["parent"].alias("origin_parent_rcid"), d["parent"].alias("destination_parent_rcid"),
        o["employer"].alias("origin_rcid"), d["employer"].alias("destination_rcid"),
        same_different_unknown(o["parent"], d["parent"]).alias("same_employer"),
        same_different_unknown(o["employer"], d["employer"]).alias("same_rcid"))


def person_summary(classified: DataFrame, by: list[str] = BY) -> DataFrame:
    """One row per entity and variant; shares the partitioning of the classified runs."""
    home, cls, kind = F.col("home"), F.col("run_class"), F.col("event_kind")
    pending = F.when(cls == "unconfirmed_terminal", home)
    return classified.groupBy(*by, "persistence_quarters", "horizon_q").agg(
        F.min("start_q").alias("first_q"), F.max("end_q").alias("last_q"), F.max("block_no").alias("n_blocks"),
        F.max(F.when((F.col("block_no") == 1) & F.col("first_in_block"), home)).alias("initial_home"),
        F.max(F.when(F.col("block_no") == F.col("last_block"), F.col("block_final"))).alias("final_confirmed_home"),
        F.count_if((cls == "confirmed_move") & home).alias("entries"),
        F.count_if((cls == "confirmed_move") & ~home).alias("exits"),
        F.count_if(cls == "excursion").alias("excursions"),
        F.count_if(cls == "unconfirmed_before_gap").alias("unconfirmed_before_gap"),
        F.max(pending).alias("_pending"),
        F.sum(F.when(home, F.col("len"))).alias("home_quarters"),
        F.sum(F.when(~home, F.col("len"))).alias("non_home_quarters"),
        F.count_if((kind == "gap") & home).alias("gap_entries"),
        F.count_if((kind == "gap") & ~home).alias("gap_exits"),
    ).select("*", F.col("_pending").isNotNull().alias("terminal_unconfirmed"),
             F.when(F.col("_pending"), "entry").when(~F.col("_pending"), "exit").alias("terminal_pending_direction")
             ).drop("_pending")


def home_spells(runs: DataFrame, horizon: int = NO_HORIZON, by: list[str] = BY) -> DataFrame:
    """Runs with home status as numbered spells with censoring flags (not cut at the horizon)."""
    person = Window.partitionBy(*by)
    along = person.orderBy("block_no", "run_no")
    ever = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = runs.where(F.col("start_q") <= horizon).select(
        "*", F.min("start_q").over(ever).alias("_first"), F.max("end_q").over(ever).alias("_last"),
        (~F.lead("block_no").over(along).eqNullSafe(F.col("block_no"))).alias("_last_in_block"))
    left, right = F.col("start_q") == F.col("_first"), F.col("end_q") == F.col("_last")
    return seen.where("home").select(
        *by, F.row_number().over(along).alias("spell_no"), "start_q", "end_q",
        (F.col("end_q") - F.col("start_q") + 1).alias("quarters"),
        F.when(left, "record_start").when(F.col("first_in_block"), "unknown_gap").otherwise("non_home")
         .alias("preceded_by"),
        F.when(right, "record_end").when(F.col("_last_in_block"), "unknown_gap").otherwise("non_home")
         .alias("followed_by"),
        left.alias("left_censored"), right.alias("right_censored"),
        (F.col("end_q") == horizon).alias("ongoing_at_horizon"))


def transitions_by_quarter(moves: DataFrame) -> DataFrame:
    """Counts per variant, quarter, kind and direction; people counted once."""
    profile = (F.coalesce(F.col("origin_location_source").isin(*V.PROFILE_SOURCES), F.lit(False))
               | F.coalesce(F.col("destination_location_source").isin(*V.PROFILE_SOURCES), F.lit(False)))
    keys = ["end_rule", "spec", "persistence_quarters", "event_q", "kind", "direction"]
    splits = {"same_employer": F.col("same_employer") == "same",
              "different_employer": F.col("same_employer") == "different",
              "unknown_employer": F.col("same_employer") == "unknown",
              "first_home_spell": F.col("home_spell_type") == "first",
              "return_home_spell": F.col("home_spell_type") == "return",
              "uses_profile_location": profile}
    person = moves.groupBy(*keys, "user_id").agg(
        F.count(F.lit(1)).alias("transitions"), *[F.count_if(c).alias(n) for n, c in splits.items()])
    return person.groupBy(*keys).agg(
        F.sum("transitions").alias("transitions"), F.count(F.lit(1)).alias("people"),
        *[F.sum(n).alias(n) for n in splits]).select(
        "end_rule", "spec", "persistence_quarters", F.col("event_q").alias("qidx"),
        quarter_label("event_q").alias("quarter"), "kind", "direction", "transitions", "people", *splits)
