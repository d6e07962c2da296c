"""Endpoint classes, events inside a window, and the measures comparing both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import same_different_unknown
from ..plans.config import HistoryConfig
from ..session import tasks_for
from .spells import observations

VARIANT = ["window_name", "end_rule", "location_spec"]
COUNTERS = ("entries", "exits", "gap_entries", "gap_exits")


def endpoints(panel: DataFrame, cfg: HistoryConfig, parent: str = "primary_parent_rcid",
              employer: str = "primary_rcid") -> DataFrame:
    """One row per person, end rule, window and specification with a panel row in the window.

    A person's rows collapse in one aggregate that keeps the edge quarters of every window and
    counts status per window; windows and specifications are split afterwards.  Rows are placed by person over as many tasks as
    the panel (a written table; its rows are counted) asks for, and only those of edge quarters carry their attributes.
    """
    windows = cfg.window_quarters
    lo, hi = min(a for a, _ in windows.values()), max(b for _, b in windows.values())
    edges = sorted({q for w in windows.values() for q in w})
    status = {V.FALLBACK_SPEC: F.col("_h0"), V.POSITION_SPEC: F.col("_h1")}
    pc = F.col("loc_country_position_only")
    row = F.struct(
        F.col("home_fallback").alias("h0"), F.col("home_position_only").alias("h1"),
        F.col("loc_country_fallback").alias("c0"), pc.alias("c1"),
        F.col("loc_source_fallback").alias("s0"), F.when(pc.isNotNull(), "position").alias("s1"),
        F.col("fallback_timing").alias("t0"), F.lit(None).cast("string").alias("t1"),
        F.col(parent).alias("parent"), F.col(employer).alias("employer"))
    aggs = [F.max(F.when(F.col("qidx") == q, F.col("_row"))).alias(f"at_{q}") for q in edges]
    for name, (a, b) in windows.items():
        inside = F.col("qidx").between(a, b)
        aggs.append(F.count_if(inside).alias(f"rows_{name}"))
        for i, s in enumerate(status.values()):
            aggs += [F.count_if(inside & s).alias(f"in_{name}_{i}"), F.count_if(inside & ~s).alias(f"out_{name}_{i}")]
    seen = panel.where(F.col("qidx").between(lo, hi)).select(
        "user_id", "end_rule", "qidx", F.col("home_fallback").alias("_h0"), F.col("home_position_only").alias("_h1"),
        F.when(F.col("qidx").isin(edges), row).alias("_row"))
    person = seen.repartition(tasks_for(panel.count()), "user_id").groupBy("user_id", "end_rule").agg(*aggs)

    def view(name, i, spec):
        a, b = windows[name]
        s, e = F.col(f"at_{a}"), F.col(f"at_{b}")
        inn, out = F.col(f"in_{name}_{i}"), F.col(f"out_{name}_{i}")
        pick = lambda side, f: side[f"{f}{i}"]
        return F.struct(
            F.lit(name).alias("window_name"), F.lit(spec).alias("location_spec"), F.col(f"rows_{name}").alias("_rows"),
            pick(s, "h").alias("start_home"), pick(e, "h").alias("end_home"),
            pick(s, "c").alias("start_country"), pick(e, "c").alias("end_country"),
            pick(s, "s").alias("start_source"), pick(e, "s").alias("end_source"),
            pick(s, "t").alias("start_fallback_timing"), pick(e, "t").alias("end_fallback_timing"),
            s["parent"].alias("start_parent_rcid"), e["parent"].alias("end_parent_rcid"),
            s["employer"].alias("start_rcid"), e["employer"].alias("end_rcid"),
            inn.alias("home_quarters"), out.alias("non_home_quarters"),
            (F.lit(b - a + 1) - inn - out).alias("unknown_quarters"))

    views = F.array(*[view(n, i, spec) for n in windows for i, spec in enumerate(status)])
    rows = person.select("user_id", "end_rule", F.inline(views)).where(F.col("_rows") > 0).drop("_rows")
    return rows.select("*", *_classes())


def _classes() -> list[Column]:
    s, e = F.col("start_home"), F.col("end_home")
    out, inn, unknown = F.col("non_home_quarters"), F.col("home_quarters"), F.col("unknown_quarters")
    stayed = F.when(out > 0, "round_trip_out").when(unknown > 0, "home_with_unknown_quarters").otherwise("continuous_home")
    away = F.when(inn > 0, "round_trip_in").otherwise("no_home_quarter")
    profile = lambda c: F.coalesce(F.col(c).isin(*V.PROFILE_SOURCES), F.lit(False))
    return [
        F.when(s.isNull() | e.isNull(), "unclassified").when(s & e, "stayed").when(e, "entered")
         .when(s, "departed").otherwise("outside_home_at_both").alias("endpoint_class"),
        F.when(s & e, stayed).when(~s & ~e, away)
         .when(s.isNull() & e.isNull(), "unknown_both_endpoints")
         .when(s.isNull(), "unknown_start").when(e.isNull(), "unknown_end").alias("endpoint_path"),
        same_different_unknown("start_parent_rcid", "end_parent_rcid").alias("same_company"),
        same_different_unknown("start_rcid", "end_rcid").alias("same_rcid"),
        (profile("start_source") | profile("end_source")).alias("uses_profile_location")]


def window_transitions(moves: DataFrame, cfg: HistoryConfig) -> DataFrame:
    """Transitions confirmed by the window end and dated inside the window."""
    windows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("a"), F.lit(b).alias("b"))
                        for n, (a, b) in cfg.window_quarters.items()])
    w = F.col("_w")
    return (moves.withColumn("_w", F.explode(windows))
                 .where((F.col("horizon_q") == w["b"]) & (F.col("event_q") > w["a"]) & (F.col("event_q") <= w["b"]))
                 .withColumn("window_name", w["name"]).withColumnRenamed("spec", "location_spec").drop("_w"))


def window_events(ends: DataFrame, moves: DataFrame, summary: DataFrame, cfg: HistoryConfig) -> DataFrame:
    """Endpoint rows with event counts and open ends per persistence, zero-filled.

    ``moves`` and ``summary`` hold every (persistence, window end) variant.  Both collapse to
    one wide row per person first.
    """
    ks = cfg.persistence
    ev = window_transitions(moves, cfg)
    kind, direction, k = F.col("kind"), F.col("direction"), F.col("persistence_quarters")
    conds = {"entries": ("confirmed", "entry"), "exits": ("confirmed", "exit"),
             "gap_entries": ("gap", "entry"), "gap_exits": ("gap", "exit")}
    counted = ev.groupBy("user_id", *VARIANT).agg(*[
        F.count_if((k == n) & (kind == a) & (direction == b)).alias(f"{name}_k{n}")
        for n in ks for name, (a, b) in conds.items()])
    horizons = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(b).alias("b")) for n, (_, b) in cfg.window_quarters.items()])
    open_ends = (summary.withColumn("_w", F.explode(horizons)).where(F.col("horizon_q") == F.col("_w.b"))
                 .groupBy("user_id", F.col("_w.name").alias("window_name"), "end_rule", F.col("spec").alias("location_spec"))
                 .agg(*[F.max(F.when(k == n, F.col("terminal_unconfirmed"))).alias(f"terminal_unconfirmed_k{n}") for n in ks],
                      *[F.max(F.when(k == n, F.col("excursions"))).alias(f"excursions_k{n}") for n in ks]))
    joined = ends.join(counted, ["user_id", *VARIANT], "left").join(open_ends, ["user_id", *VARIANT], "left")
    fills = {}
    for n in ks:
        fills |= {f"{c}_k{n}": F.coalesce(f"{c}_k{n}", F.lit(0)) for c in (*COUNTERS, "excursions")}
        fills[f"terminal_unconfirmed_k{n}"] = F.coalesce(f"terminal_unconfirmed_k{n}", F.lit(False))
    return joined.withColumns(fills)


def _long(df: DataFrame, keys: list[str], conditions: dict[str, Column], net: tuple[str, str, str] | None,
          extra: dict[str, Column] | None = None) -> DataFrame:
    """One wide aggregate, then one row per measure."""
    wide = df.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])
    cells = [F.struct(F.lit(n).alias("measure"), F.col(n).alias("estimate")) for n in conditions]
    if net:
        cells.append(F.struct(F.lit(net[0]).alias("measure"), (F.col(net[1]) - F.col(net[2])).alias("estimate")))
    return wide.select(*keys, *[c.alias(n) for n, c in (extra or {}).items()], F.inline(F.array(*cells)))


def endpoint_conditions() -> dict[str, Column]:
    cls, path = F.col("endpoint_class"), F.col("endpoint_path")
    out = {c: cls == c for c in ("stayed", "entered", "departed", "outside_home_at_both")}
    out["classified_home_linked_total"] = cls.isin("stayed", "entered", "departed")
    out |= {"stayed_continuous_home": path == "continuous_home",
            "stayed_home_with_unknown_quarters": path == "home_with_unknown_quarters",
            "stayed_round_trip_out": path == "round_trip_out", "outside_round_trip_in": path == "round_trip_in",
            "unclassified_home_at_start_unknown_at_end": F.col("start_home") & F.col("end_home").isNull(),
            "unclassified_unknown_at_start_home_at_end": F.col("end_home") & F.col("start_home").isNull(),
            "unclassified_unknown_both_any_home_quarter": (path == "unknown_both_endpoints") & (F.col("home_quarters") > 0)}
    backcast = (F.col("start_fallback_timing").eqNullSafe("backcast") | F.col("end_fallback_timing").eqNullSafe("backcast"))
    for c in ("stayed", "entered", "departed"):
        for s in ("same", "different", "unknown"):
            out[f"{c}_{s}_company"] = (cls == c) & (F.col("same_company") == s)
            out[f"{c}_{s}_rcid"] = (cls == c) & (F.col("same_rcid") == s)
        out[f"{c}_using_profile_location"] = (cls == c) & F.col("uses_profile_location")
        out[f"{c}_profile_backcast_at_endpoint"] = (cls == c) & backcast
    return out


def endpoint_measures(ends: DataFrame) -> DataFrame:
    return _long(ends, VARIANT, endpoint_conditions(), ("net", "entered", "departed"),
                 {"method": F.lit("endpoint"), "persistence_quarters": F.lit(None).cast("int")})


def event_measures(events: DataFrame) -> DataFrame:
    """15 event counts and their net per variant and persistence (``window_transitions`` rows)."""
    dated = F.col("kind") == "confirmed"
    sides = {"entries": F.col("direction") == "entry", "exits": F.col("direction") == "exit"}
    conds = {n: dated & c for n, c in sides.items()}
    conds |= {f"gap_{n}_undated": (F.col("kind") == "gap") & c for n, c in sides.items()}
    for n, c in sides.items():
        conds |= {f"{n}_{s}_company": dated & c & (F.col("same_employer") == s) for s in ("same", "different", "unknown")}
        conds |= {f"{n}_{s}_home_spell": dated & c & (F.col("home_spell_type") == s) for s in ("first", "return")}
    profile = lambda c: F.coalesce(F.col(c).isin(*V.PROFILE_SOURCES), F.lit(False))
    conds["events_using_profile_location"] = dated & (profile("origin_location_source") | profile("destination_location_source"))
    return _long(events, [*VARIANT, "persistence_quarters"], conds, ("net_events", "entries", "exits"),
                 {"method": F.lit("quarterly_events")})


def cross_measures(joined: DataFrame, cfg: HistoryConfig) -> DataFrame:
    """People counts mixing endpoint classes and events, for every persistence in one scan."""
    cls = F.col("endpoint_class")
    cells, aggs = [], []
    for k in cfg.persistence:
        c = lambda n: F.col(f"{n}_k{k}")  # noqa: E731,B023
        conds = {
            "people_with_entry": c("entries") > 0, "people_with_exit": c("exits") > 0,
            "people_censored_unconfirmed_at_window_end": c("terminal_unconfirmed"),
            "people_with_excursion": c("excursions") > 0,
            "stayed_with_confirmed_exit": (cls == "stayed") & (c("exits") > 0),
            "entered_with_confirmed_entry": (cls == "entered") & (c("entries") > 0),
            "entered_via_gap_only": (cls == "entered") & (c("entries") == 0) & (c("gap_entries") > 0),
            "departed_with_confirmed_exit": (cls == "departed") & (c("exits") > 0),
            "departed_via_gap_only": (cls == "departed") & (c("exits") == 0) & (c("gap_exits") > 0),
            "departed_censored_unconfirmed": (cls == "departed") & (c("exits") == 0) & (c("gap_exits") == 0)}
        for name, cond in conds.items():
            aggs.append(F.count_if(cond).alias(f"{name}_k{k}"))
            cells.append(F.struct(F.lit(k).alias("persistence_quarters"), F.lit(name).alias("measure"),
                                  F.col(f"{name}_k{k}").alias("estimate")))
    return joined.groupBy(*VARIANT).agg(*aggs).select(*VARIANT, F.lit("quarterly_events").alias("method"),
                                                     F.inline(F.array(*cells)))


def attach_benchmarks(measures: DataFrame, benchmarks: DataFrame, cfg: HistoryConfig,
                      consistency: DataFrame | None = None, unavailable: DataFrame | None = None) -> DataFrame:
    """Measures next to external numbers.

    ``benchmarks(measure, benchmark, benchmark_source)``; ``consistency(measure, estimate, note)``
    are totals of published cells to hold against their own benchmark; ``unavailable(measure, note)``
    are measures nobody can compute.  All four are small report frames.
    """
    rows = measures.withColumn("note", F.lit(None).cast("string"))
    if consistency is not None:
        rows = rows.unionByName(consistency.select("measure", F.col("estimate").cast("bigint"), "note",
                                                   F.lit("published").alias("window_name"),
                                                   F.lit("benchmark_consistency").alias("method")), allowMissingColumns=True)
    if unavailable is not None:
        rows = rows.unionByName(unavailable.select("measure", "note", F.lit("all").alias("window_name"),
                                                   F.lit("unavailable").alias("method")), allowMissingColumns=True)
    known = benchmarks.select("measure", "benchmark", "benchmark_source")
    comparable = F.col("method").isin("endpoint", "benchmark_consistency")
    label = F.coalesce(*[F.when(F.col("window_name") == n, cfg.window_label(n)) for n in cfg.windows])
    first = next(iter(cfg.windows))
    primary = ((F.col("window_name") == first) & (F.col("end_rule") == cfg.primary_rule)
               & (F.col("location_spec") == cfg.primary_spec) & (F.col("method") == "endpoint"))
    show = lambda c: F.when(comparable, c)
    b = F.col("benchmark")
    return (rows.join(known, "measure", "left")
            .select("window_name", label.alias("window_quarters"), "end_rule", "location_spec", "method",
                    "persistence_quarters", "measure", "estimate", show(b).alias("benchmark"),
                    show(F.col("benchmark_source")).alias("benchmark_source"),
                    show(F.col("estimate") - b).alias("difference"),
                    F.when(comparable & (b != 0), F.round(F.col("estimate") / b, 4)).alias("ratio_to_benchmark"),
                    F.coalesce(primary, F.lit(False)).alias("primary_specification"), "note")
            .orderBy(F.col("method") == "unavailable", F.col("method") == "benchmark_consistency", "window_name",
                     F.col("end_rule").asc_nulls_last(), F.col("location_spec").asc_nulls_last(), "method",
                     F.col("persistence_quarters").asc_nulls_first(), "measure"))


def headline(report: DataFrame) -> DataFrame:
    return report.where(F.col("primary_specification") & F.col("measure").isin("stayed", "entered", "departed", "net")
                        ).select("measure", "estimate")


__all__ = ["endpoints", "window_transitions", "window_events", "endpoint_measures", "event_measures",
           "cross_measures", "attach_benchmarks", "headline", "observations"]
