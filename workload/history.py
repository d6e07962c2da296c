"""Registered queries on employment histories (measurement pipeline)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spellframe.operators import endpoints as E
from spellframe.operators import panel as P
from spellframe.operators import spells as S
from spellframe.plans import clean as K
from spellframe.session import fine_tasks, stage
from workload import orders_as_spells as W
from workload.oracle import history, history_by_window, qlabel

CFG = W.CFG
VARIANTS = [(k, CFG.last_q) for k in CFG.persistence]
#: A window to the last quarter and one that ends a year before; runs are cut at the end of each.
BOTH_ENDS = replace(CFG, windows={"primary": CFG.windows["primary"], "early": ("1997Q4", "1999Q3")})
HORIZONS = [(k, b) for _, b in BOTH_ENDS.window_quarters.values() for k in CFG.persistence]
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f
    return register


_written: dict[tuple, object] = {}


def input_state(spark: SparkSession, sf: str) -> tuple:
    """Application, place and state of the input files: their number, bytes and a sum over path, size and time, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(
        [f"{sf}/{t}.parquet" for t in ("orders", "lineitem", "part", "customer", "supplier")])
    one = files.select("path", "length", "modificationTime").agg(
        F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    return spark.sparkContext.applicationId, sf, *one


def written_once(name: str, spark: SparkSession, sf: str, make):
    """What ``make`` has written for this state of the input; made by the first report that needs it, read by the others."""
    key = (name, *input_state(spark, sf))
    if key not in _written:
        with fine_tasks(spark, key[4]):
            _written[key] = make()
    return _written[key]


def cleaned(spark: SparkSession, sf: str) -> K.Cleaned:
    """Clean once, read many: key tables, spells and people are written by the first report of a session."""
    return written_once("cleaned", spark, sf, lambda: K.clean(
        W.positions(spark, sf), W.people(spark, sf), W.cohort(spark, sf), CFG, W.positions_raw(spark, sf), keep=stage))


def panel(spark, sf, keep: bool = False) -> DataFrame:
    """The panel of the cleaned spells, written like them; ``keep`` is not needed any more."""
    def make():
        c = cleaned(spark, sf)
        return stage(P.person_quarter_panel(c.valid, c.users, CFG), "panel")
    return written_once("panel", spark, sf, make)


def runs(spark, sf) -> DataFrame:
    return S.status_runs(S.observations(panel(spark, sf)))


def classified(spark, sf) -> DataFrame:
    return S.classify_runs(runs(spark, sf), VARIANTS)


@query("""
WITH s AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey, o_orderpriority AS category,
         year(o_orderdate) * 12 + month(o_orderdate) - 1 AS m0,
         CASE WHEN o_orderstatus = 'O' AND o_orderkey % 5 = 0 THEN 24011
              ELSE least(24011, year(e) * 12 + month(e) - 1) END AS m1
  FROM (SELECT *, CAST(o_orderdate AS DATE) + CAST(90 + o_orderkey % 400 AS INTEGER) AS e FROM orders))
SELECT qidx, CAST(qidx // 4 AS VARCHAR) || 'Q' || CAST(qidx % 4 + 1 AS VARCHAR) AS quarter, category,
       count(*) AS active_spells, count(DISTINCT o_custkey) AS people
FROM s JOIN (SELECT unnest(generate_series(7980, 8002)) AS qidx) q ON m0 <= qidx * 3 + 2 AND m1 >= qidx * 3 + 2
GROUP BY qidx, category""")
def active_by_quarter(spark, sf) -> DataFrame:
    """People and active spells per quarter and category, straight from the orders."""
    from spellframe.functions import month_index, quarter_label
    end = F.date_add(F.to_date("o_orderdate"), (90 + F.col("o_orderkey") % 400).cast("int"))
    open_end = (F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 5 == 0)
    spells = W.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("category"),
        month_index("o_orderdate").alias("start_midx"),
        F.when(~open_end, month_index(end)).alias("end_midx"), F.lit(None).cast("int").alias("refresh_midx"))
    active = P.active_quarters(spells, P.effective_end("carry_to_cutoff", CFG.cutoff_midx), CFG.panel_start_q, CFG.last_q)
    person = active.groupBy("qidx", "category", "user_id").agg(F.count(F.lit(1)).alias("_n"))
    return person.groupBy("qidx", "category").agg(
        F.sum("_n").alias("active_spells"), F.count(F.lit(1)).alias("people")).select(
        "qidx", quarter_label("qidx").alias("quarter"), "category", "active_spells", "people")


@query(history("""
SELECT 'positions_by_quarantine_reason' AS section, coalesce(reason, 'valid') AS label, count(*) AS rows FROM positions GROUP BY ALL
UNION ALL SELECT 'title_status', title_status, count(*) FROM positions GROUP BY ALL
UNION ALL SELECT 'role_rule_category_valid', coalesce(cat, 'none'), count(*) FROM valid GROUP BY ALL
UNION ALL SELECT 'users', unnest(['users', 'in_cohort', 'with_profile', 'profile_only', 'with_valid_positions']),
  unnest([count(*), count(*), count(*), count(*) FILTER (WHERE n_valid_positions = 0), count(*) FILTER (WHERE n_valid_positions > 0)]) FROM users"""))
def clean_summary(spark, sf):
    return K.clean_summary(cleaned(spark, sf))


@query(history("""SELECT coalesce(reason, 'valid') AS reason, CASE WHEN country IS NULL THEN 'Missing' WHEN country = 'NATION_1' THEN 'Home'
ELSE 'Other' END AS country_group, count(*) AS positions, count(DISTINCT user_id) AS people FROM positions GROUP BY ALL"""))
def quarantine_reasons(spark, sf):
    from spellframe.functions import group3
    c = cleaned(spark, sf)
    person = (c.positions.groupBy(F.coalesce("quarantine_reason", F.lit("valid")).alias("reason"),
                                  group3("country", CFG.home).alias("country_group"), "user_id")
              .agg(F.count(F.lit(1)).alias("_n")))
    return person.groupBy("reason", "country_group").agg(F.sum("_n").alias("positions"), F.count("user_id").alias("people"))


@query(history("""SELECT position_id, title_status, title_raw, cat AS role_rule_category, array_to_string(role_rule_ids, '|') AS role_rule_ids, down AS role_downranked
FROM positions"""))
def titled_positions(spark, sf):
    c = cleaned(spark, sf)
    return c.positions.select("position_id", "title_status", "title_raw", "role_rule_category",
                              F.array_join("role_rule_ids", "|").alias("role_rule_ids"), "role_downranked")


@query(history("""SELECT user_id, true AS in_cohort, 'ok' AS profile_status, user_country, CAST(updated_dt AS VARCHAR) AS updated_dt, refresh_midx, refresh_qidx,
n_positions, n_valid_positions, n_valid_home_positions, n_valid_positions = 0 AS profile_only FROM users"""))
def user_universe(spark, sf):
    return cleaned(spark, sf).users.withColumn("updated_dt", F.col("updated_dt").cast("string"))


@query(history(f"""SELECT user_id, end_rule, qidx, {qlabel('qidx')} AS quarter, obs_type, n_active, n_active_downranked, n_active_home, n_active_missing_country,
n_active_countries, country_conflict, alt AS alt_countries, any_active_home, downrank_changed_primary, downrank_changed_country,
primary_position_id, position_country, position_metro_area, primary_rcid, primary_parent_rcid, primary_title_raw, primary_role_rule,
primary_downranked, primary_end_missing, primary_seniority, profile_country, CAST(updated_dt AS VARCHAR) AS profile_updated_dt,
refresh_qidx AS profile_refresh_qidx, loc_fb AS loc_country_fallback, src_fb AS loc_source_fallback, timing AS fallback_timing,
loc_po AS loc_country_position_only, loc_fb = 'NATION_1' AS home_fallback, loc_po = 'NATION_1' AS home_position_only
FROM panel"""))
def primary_panel(spark, sf):
    return panel(spark, sf).select(
        "user_id", "end_rule", "qidx", "quarter", "obs_type", "n_active", "n_active_downranked", "n_active_home",
        "n_active_missing_country", "n_active_countries", "country_conflict",
        F.array_join("alt_countries", "|").alias("alt_countries"), "any_active_home", "downrank_changed_primary",
        "downrank_changed_country", "primary_position_id", "position_country", "position_metro_area", "primary_rcid",
        "primary_parent_rcid", "primary_title_raw", "primary_role_rule", "primary_downranked", "primary_end_missing",
        "primary_seniority", "profile_country", F.col("profile_updated_dt").cast("string").alias("profile_updated_dt"),
        "profile_refresh_qidx", "loc_country_fallback", "loc_source_fallback", "fallback_timing",
        "loc_country_position_only", "home_fallback", "home_position_only")


@query(history("""SELECT end_rule, count(*) AS rows, count(*) FILTER (WHERE obs_type = 'position') AS position_rows,
count(*) FILTER (WHERE obs_type = 'profile_snapshot') AS snapshot_rows, count(DISTINCT user_id) AS people FROM panel GROUP BY end_rule"""))
def panel_totals(spark, sf):
    return P.panel_totals(panel(spark, sf))


@query(history("SELECT user_id, end_rule, spec, block_no, run_no, home, start_q, end_q FROM runs"))
def status_runs(spark, sf):
    return runs(spark, sf).select("user_id", "end_rule", "spec", "block_no", "run_no", "home", "start_q", "end_q")


@query(history("""SELECT user_id, end_rule, spec, k AS persistence_quarters, block_no, run_no, home, start_q, end_q, len, confirmed_before,
block_final, last_block, run_class FROM cls"""))
def run_classes(spark, sf):
    return classified(spark, sf).select("user_id", "end_rule", "spec", "persistence_quarters", "block_no", "run_no", "home",
                                        "start_q", "end_q", "len", "confirmed_before", "block_final", "last_block", "run_class")


MOVE_COLUMNS = ["user_id", "end_rule", "spec", "persistence_quarters", "event_q", "origin_q", "kind", "direction",
                "destination_run_quarters", "gap_quarters", "block_no", "prior_moves_in_block", "home_spell_type",
                "origin_country", "destination_country", "origin_location_source", "destination_location_source",
                "origin_fallback_timing", "destination_fallback_timing", "same_employer", "same_rcid"]


@query(history(f"SELECT {', '.join(MOVE_COLUMNS)} FROM moves"))
def transitions(spark, sf):
    return S.transitions(classified(spark, sf)).select(*MOVE_COLUMNS)


@query(history(f"""SELECT end_rule, spec, persistence_quarters, event_q AS qidx, {qlabel('event_q')} AS quarter, kind, direction,
count(*) AS transitions, count(DISTINCT user_id) AS people, count(*) FILTER (WHERE same_employer = 'same') AS same_employer,
count(*) FILTER (WHERE same_employer = 'different') AS different_employer, count(*) FILTER (WHERE same_employer = 'unknown') AS unknown_employer,
count(*) FILTER (WHERE home_spell_type = 'first') AS first_home_spell, count(*) FILTER (WHERE home_spell_type = 'return') AS return_home_spell,
count(*) FILTER (WHERE coalesce(origin_location_source LIKE 'profile%', false) OR coalesce(destination_location_source LIKE 'profile%', false)) AS uses_profile_location
FROM moves GROUP BY ALL"""))
def transitions_by_quarter(spark, sf):
    return S.transitions_by_quarter(S.transitions(classified(spark, sf)))


@query(history("""
, bounds AS (SELECT user_id, end_rule, spec, min(start_q) AS p0, max(end_q) AS p1 FROM runs GROUP BY ALL),
edge AS (SELECT user_id, end_rule, spec, block_no, min(run_no) AS r0, max(run_no) AS r1 FROM runs GROUP BY ALL)
SELECT user_id, end_rule, spec, row_number() OVER (PARTITION BY user_id, end_rule, spec ORDER BY start_q) AS spell_no, start_q, end_q,
 end_q - start_q + 1 AS quarters,
 CASE WHEN start_q = p0 THEN 'record_start' WHEN run_no = r0 THEN 'unknown_gap' ELSE 'non_home' END AS preceded_by,
 CASE WHEN end_q = p1 THEN 'record_end' WHEN run_no = r1 THEN 'unknown_gap' ELSE 'non_home' END AS followed_by,
 start_q = p0 AS left_censored, end_q = p1 AS right_censored, end_q = %d AS ongoing_at_horizon
FROM runs JOIN bounds USING (user_id, end_rule, spec) JOIN edge USING (user_id, end_rule, spec, block_no) WHERE home""" % CFG.last_q))
def home_spells(spark, sf):
    return S.home_spells(runs(spark, sf), CFG.last_q)


SUMMARY_COLUMNS = ["user_id", "end_rule", "spec", "persistence_quarters", "first_q", "last_q", "n_blocks", "initial_home",
                   "final_confirmed_home", "entries", "exits", "excursions", "unconfirmed_before_gap", "terminal_unconfirmed",
                   "terminal_pending_direction", "home_quarters", "non_home_quarters", "gap_entries", "gap_exits"]


@query(history("""
SELECT c.user_id, c.end_rule, c.spec, c.k AS persistence_quarters, min(start_q) AS first_q, max(end_q) AS last_q, max(block_no) AS n_blocks,
 arg_min(home, run_no) AS initial_home, arg_max(block_final, run_no) AS final_confirmed_home,
 count(*) FILTER (WHERE run_class = 'confirmed_move' AND home) AS entries, count(*) FILTER (WHERE run_class = 'confirmed_move' AND NOT home) AS exits,
 count(*) FILTER (WHERE run_class = 'excursion') AS excursions, count(*) FILTER (WHERE run_class = 'unconfirmed_before_gap') AS unconfirmed_before_gap,
 bool_or(run_class = 'unconfirmed_terminal') AS terminal_unconfirmed,
 max(CASE WHEN home THEN 'entry' ELSE 'exit' END) FILTER (WHERE run_class = 'unconfirmed_terminal') AS terminal_pending_direction,
 CAST(sum(len) FILTER (WHERE home) AS BIGINT) AS home_quarters, CAST(sum(len) FILTER (WHERE NOT home) AS BIGINT) AS non_home_quarters,
 any_value(coalesce(ge, 0)) AS gap_entries, any_value(coalesce(gx, 0)) AS gap_exits
FROM cls c LEFT JOIN (SELECT user_id, end_rule, spec, k, count(*) FILTER (WHERE home) AS ge, count(*) FILTER (WHERE NOT home) AS gx
  FROM ev0 WHERE kind = 'gap' GROUP BY ALL) g USING (user_id, end_rule, spec, k) GROUP BY c.user_id, c.end_rule, c.spec, c.k"""))
def person_summary(spark, sf):
    return S.person_summary(classified(spark, sf)).select(*SUMMARY_COLUMNS)


END_COLUMNS = ["window_name", "end_rule", "location_spec", "user_id", "start_home", "end_home", "start_country", "end_country",
               "start_source", "end_source", "start_fallback_timing", "end_fallback_timing", "home_quarters",
               "non_home_quarters", "unknown_quarters", "endpoint_class", "endpoint_path", "same_company", "same_rcid",
               "uses_profile_location"]


@query(history(f"SELECT {', '.join(END_COLUMNS)} FROM ends"))
def endpoint_classes(spark, sf):
    return E.endpoints(panel(spark, sf), CFG).select(*END_COLUMNS)


def _endpoint_sql() -> str:
    cells = {c: f"endpoint_class = '{c}'" for c in ("stayed", "entered", "departed", "outside_home_at_both")}
    cells |= {"classified_home_linked_total": "endpoint_class IN ('stayed', 'entered', 'departed')",
              "stayed_continuous_home": "endpoint_path = 'continuous_home'",
              "stayed_home_with_unknown_quarters": "endpoint_path = 'home_with_unknown_quarters'",
              "stayed_round_trip_out": "endpoint_path = 'round_trip_out'", "outside_round_trip_in": "endpoint_path = 'round_trip_in'",
              "unclassified_home_at_start_unknown_at_end": "start_home AND endpoint_path = 'unknown_end'",
              "unclassified_unknown_at_start_home_at_end": "end_home AND endpoint_path = 'unknown_start'",
              "unclassified_unknown_both_any_home_quarter": "endpoint_path = 'unknown_both_endpoints' AND home_quarters > 0"}
    for c in ("stayed", "entered", "departed"):
        for s in ("same", "different", "unknown"):
            cells[f"{c}_{s}_company"] = f"endpoint_class = '{c}' AND same_company = '{s}'"
            cells[f"{c}_{s}_rcid"] = f"endpoint_class = '{c}' AND same_rcid = '{s}'"
        cells[f"{c}_using_profile_location"] = f"endpoint_class = '{c}' AND uses_profile_location"
        cells[f"{c}_profile_backcast_at_endpoint"] = (f"endpoint_class = '{c}' AND (coalesce(start_fallback_timing, '') = 'backcast' "
                                                      "OR coalesce(end_fallback_timing, '') = 'backcast')")
    parts = [f"SELECT window_name, end_rule, location_spec, '{n}' AS measure, count(*) FILTER (WHERE {c}) AS estimate FROM ends GROUP BY ALL"
             for n, c in cells.items()]
    parts.append("SELECT window_name, end_rule, location_spec, 'net', count(*) FILTER (WHERE endpoint_class = 'entered') - "
                 "count(*) FILTER (WHERE endpoint_class = 'departed') FROM ends GROUP BY ALL")
    return " UNION ALL ".join(parts)


@query(history(_endpoint_sql()))
def endpoint_measures(spark, sf):
    return E.endpoint_measures(E.endpoints(panel(spark, sf), CFG)).drop("method", "persistence_quarters")


WINDOWED = """, wm AS (SELECT window_name, end_rule, spec AS location_spec, m.* EXCLUDE (end_rule, spec) FROM moves m
JOIN win ON event_q > a AND event_q <= b)"""


def _event_sql() -> str:
    cells = {}
    for n, d in (("entries", "entry"), ("exits", "exit")):
        cells[n] = f"kind = 'confirmed' AND direction = '{d}'"
        cells[f"gap_{n}_undated"] = f"kind = 'gap' AND direction = '{d}'"
        for s in ("same", "different", "unknown"):
            cells[f"{n}_{s}_company"] = f"kind = 'confirmed' AND direction = '{d}' AND same_employer = '{s}'"
        for s in ("first", "return"):
            cells[f"{n}_{s}_home_spell"] = f"kind = 'confirmed' AND direction = '{d}' AND home_spell_type = '{s}'"
    cells["events_using_profile_location"] = ("kind = 'confirmed' AND (coalesce(origin_location_source, '') LIKE 'profile%' "
                                              "OR coalesce(destination_location_source, '') LIKE 'profile%')")
    key = "window_name, end_rule, location_spec, persistence_quarters"
    parts = [f"SELECT {key}, '{n}' AS measure, count(*) FILTER (WHERE {c}) AS estimate FROM wm GROUP BY ALL" for n, c in cells.items()]
    parts.append(f"SELECT {key}, 'net_events', count(*) FILTER (WHERE kind = 'confirmed' AND direction = 'entry') - "
                 "count(*) FILTER (WHERE kind = 'confirmed' AND direction = 'exit') FROM wm GROUP BY ALL")
    return WINDOWED + " UNION ALL ".join(parts)


@query(history(_event_sql()))
def event_measures(spark, sf):
    return E.event_measures(E.window_transitions(S.transitions(classified(spark, sf)), CFG)).drop("method")


def _cross_sql() -> str:
    per_k = []
    for k in CFG.persistence:
        per_k.append(f"""SELECT e.*, {k} AS kk, coalesce(x.en, 0) AS en, coalesce(x.ex, 0) AS ex, coalesce(x.ge, 0) AS ge, coalesce(x.gx, 0) AS gx,
coalesce(s.tu, false) AS tu, coalesce(s.xc, 0) AS xc FROM ends e
LEFT JOIN (SELECT window_name, end_rule, location_spec, user_id, count(*) FILTER (WHERE kind = 'confirmed' AND direction = 'entry') AS en,
 count(*) FILTER (WHERE kind = 'confirmed' AND direction = 'exit') AS ex, count(*) FILTER (WHERE kind = 'gap' AND direction = 'entry') AS ge,
 count(*) FILTER (WHERE kind = 'gap' AND direction = 'exit') AS gx FROM wm WHERE persistence_quarters = {k} GROUP BY ALL) x
 USING (window_name, end_rule, location_spec, user_id)
LEFT JOIN (SELECT user_id, end_rule, spec AS location_spec, bool_or(run_class = 'unconfirmed_terminal') AS tu,
 count(*) FILTER (WHERE run_class = 'excursion') AS xc FROM cls WHERE k = {k} GROUP BY ALL) s USING (user_id, end_rule, location_spec)""")
    cells = {"people_with_entry": "en > 0", "people_with_exit": "ex > 0", "people_censored_unconfirmed_at_window_end": "tu",
             "people_with_excursion": "xc > 0", "stayed_with_confirmed_exit": "endpoint_class = 'stayed' AND ex > 0",
             "entered_with_confirmed_entry": "endpoint_class = 'entered' AND en > 0",
             "entered_via_gap_only": "endpoint_class = 'entered' AND en = 0 AND ge > 0",
             "departed_with_confirmed_exit": "endpoint_class = 'departed' AND ex > 0",
             "departed_via_gap_only": "endpoint_class = 'departed' AND ex = 0 AND gx > 0",
             "departed_censored_unconfirmed": "endpoint_class = 'departed' AND ex = 0 AND gx = 0"}
    parts = [f"SELECT window_name, end_rule, location_spec, kk AS persistence_quarters, '{n}' AS measure, count(*) FILTER (WHERE {c}) AS estimate "
             "FROM xj GROUP BY ALL" for n, c in cells.items()]
    return WINDOWED + ", xj AS (" + " UNION ALL ".join(per_k) + ") " + " UNION ALL ".join(parts)


def window_joined(spark, sf):
    p = panel(spark, sf, keep=True)
    cls = S.classify_runs(S.status_runs(S.observations(p)), VARIANTS)
    return E.window_events(E.endpoints(p, CFG), S.transitions(cls), S.person_summary(cls), CFG)


@query(history(_cross_sql()))
def cross_measures(spark, sf):
    return E.cross_measures(window_joined(spark, sf), CFG).drop("method")


BENCH_ROWS = [("stayed", 250), ("entered", 30), ("departed", 25), ("net", 5), ("stayed_same_company", 180)]


@query(history(f""", b(measure, benchmark) AS (VALUES {', '.join(f"('{m}', {v})" for m, v in BENCH_ROWS)}),
m AS ({_endpoint_sql()})
SELECT window_name, CASE window_name WHEN 'primary' THEN '{CFG.window_label('primary')}' ELSE '{CFG.window_label('sensitivity')}' END AS window_quarters,
 end_rule, location_spec, measure, estimate, benchmark, estimate - benchmark AS difference,
 round(estimate / benchmark, 4) AS ratio_to_benchmark,
 window_name = 'primary' AND end_rule = 'carry_to_cutoff' AND location_spec = 'position_with_profile_fallback' AS primary_specification
FROM m LEFT JOIN b USING (measure)"""))
def benchmark_report(spark, sf):
    bench = spark.createDataFrame(BENCH_ROWS, "measure string, benchmark bigint").withColumn("benchmark_source", F.lit("published"))
    report = E.attach_benchmarks(E.endpoint_measures(E.endpoints(panel(spark, sf), CFG)), bench, CFG)
    return report.drop("method", "persistence_quarters", "benchmark_source", "note")


@query(history(f""", sp AS (SELECT user_id, end_rule, min(qidx) AS lo, max(qidx) AS hi FROM panel GROUP BY ALL),
g AS (SELECT user_id, end_rule, q.qidx FROM sp JOIN (SELECT unnest(generate_series({CFG.panel_start_q}, {CFG.last_q})) AS qidx) q ON q.qidx BETWEEN lo AND hi)
SELECT user_id, end_rule, qidx, {qlabel('qidx')} AS quarter, coalesce(obs_type, 'unobserved_gap') AS obs_type, primary_position_id, loc_fb AS loc_country_fallback
FROM g LEFT JOIN panel USING (user_id, end_rule, qidx)"""))
def dense_history(spark, sf):
    p = panel(spark, sf).select("user_id", "end_rule", "qidx", "quarter", "obs_type", "primary_position_id", "loc_country_fallback")
    return P.dense_history(p)


def classified_at_ends(spark, sf) -> DataFrame:
    """Run classes at the end of each window, from one pass over the runs."""
    return S.classify_runs(runs(spark, sf), HORIZONS)


@query(history_by_window("""SELECT user_id, end_rule, spec, k AS persistence_quarters, h AS horizon_q, block_no, run_no, home, start_q, end_q, len, confirmed_before,
block_final, last_block, run_class FROM cls""", BOTH_ENDS.window_quarters))
def run_classes_by_horizon(spark, sf):
    return classified_at_ends(spark, sf).select("user_id", "end_rule", "spec", "persistence_quarters", "horizon_q", "block_no", "run_no", "home",
                                                "start_q", "end_q", "len", "confirmed_before", "block_final", "last_block", "run_class")


@query(history_by_window(_event_sql(), BOTH_ENDS.window_quarters))
def event_measures_by_horizon(spark, sf):
    return E.event_measures(E.window_transitions(S.transitions(classified_at_ends(spark, sf)), BOTH_ENDS)).drop("method")


@query(history_by_window(_cross_sql(), BOTH_ENDS.window_quarters))
def cross_measures_by_horizon(spark, sf):
    """Endpoint classes against events that were confirmed, or still open, at the end of each window."""
    cls = classified_at_ends(spark, sf)
    joined = E.window_events(E.endpoints(panel(spark, sf), BOTH_ENDS), S.transitions(cls), S.person_summary(cls), BOTH_ENDS)
    return E.cross_measures(joined, BOTH_ENDS).drop("method")


def clashing(spark: SparkSession, sf: str) -> K.Cleaned:
    """The spells cleaned with clashes and gaps between their tables, written once a session."""
    return written_once("clashing", spark, sf, lambda: K.clean(
        W.clashing_positions(spark, sf), W.clashing_people(spark, sf), W.strange_cohort(spark, sf), CFG, W.clashing_positions_raw(spark, sf), keep=stage))


# Keys are judged by counting distinct contents; titles are joined by number and then compared.
CLASHES = """, pos2 AS (SELECT * FROM positions UNION ALL SELECT * REPLACE (CASE WHEN k % 2 = 0 THEN 'NATION_9' ELSE country END AS country) FROM positions WHERE k % 61 = 0),
pos_bad AS (SELECT position_id FROM pos2 GROUP BY position_id HAVING count(DISTINCT coalesce(country, '-')) > 1),
raw2 AS (SELECT CASE WHEN k % 59 = 0 THEN 'x' ELSE '' END || position_id AS pid, raw_user, t FROM src, unnest(CASE WHEN k % 67 = 0 THEN [raw_title, 'Other words'] ELSE [raw_title] END) AS u(t)),
raw_key AS (SELECT pid, count(DISTINCT coalesce(t, '-')) AS n, first(raw_user) AS raw_user, first(t) AS t FROM raw2 GROUP BY pid),
ppl2 AS (SELECT user_id, user_country FROM people UNION ALL SELECT user_id, 'NATION_8' FROM people WHERE user_id[2:]::BIGINT % 73 = 0),
profile AS (SELECT user_id, count(DISTINCT coalesce(user_country, '-')) AS n FROM ppl2 GROUP BY user_id),
coh2 AS (SELECT CASE WHEN user_id[2:]::BIGINT % 71 = 0 THEN 'X' ELSE '' END || user_id AS user_id FROM people),
sound AS (SELECT * REPLACE (CASE WHEN user_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM coh2) THEN 'user_not_in_cohort' ELSE reason END AS reason)
  FROM positions WHERE position_id NOT IN (SELECT position_id FROM pos_bad)),
told AS (SELECT sound.*, CASE WHEN r.n > 1 THEN 'conflicting_raw_key' WHEN r.pid IS NULL THEN 'no_raw_row' WHEN r.raw_user IS DISTINCT FROM sound.user_id THEN 'raw_user_mismatch'
  WHEN trim(coalesce(r.t, '')) = '' THEN 'blank_title' ELSE 'ok' END AS told FROM sound LEFT JOIN raw_key r ON r.pid = sound.position_id)
"""


@query(history(CLASHES + """SELECT position_id, told AS title_status, reason AS quarantine_reason, country FROM told"""))
def clashing_titles(spark, sf):
    """Each sound spell with what became of its title and the rule that sets it aside, where tables clash."""
    return clashing(spark, sf).positions.select("position_id", "title_status", "quarantine_reason", "country")


@query(history(CLASHES + """SELECT 'spells' AS section, reason AS label, count(*) AS rows FROM told WHERE reason IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'spells', 'conflicting_duplicate_key', count(*) FROM pos2 WHERE position_id IN (SELECT position_id FROM pos_bad) HAVING count(*) > 0
UNION ALL SELECT 'raw_titles', 'conflicting_duplicate_key', count(*) FROM raw2 WHERE pid IN (SELECT pid FROM raw_key WHERE n > 1) HAVING count(*) > 0
UNION ALL SELECT 'users', 'conflicting_duplicate_key', count(*) FROM ppl2 WHERE user_id IN (SELECT user_id FROM profile WHERE n > 1) HAVING count(*) > 0
UNION ALL SELECT 'profile_status', CASE WHEN p.n > 1 THEN 'conflicting_duplicate_key' WHEN p.n = 1 THEN 'ok' ELSE 'no_profile_row' END AS label, count(*)
FROM (SELECT user_id FROM coh2 UNION SELECT user_id FROM people) LEFT JOIN profile p USING (user_id) GROUP BY label"""))
def clashing_quarantine(spark, sf):
    """Rows set aside by table and reason, and the profile status of people, where tables clash."""
    c = clashing(spark, sf)
    spells = c.quarantine.groupBy(F.lit("spells").alias("section"), F.col("quarantine_reason").alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    other = c.other_quarantine.groupBy(F.col("source_table").alias("section"), F.col("quarantine_reason").alias("label")).agg(F.sum("rows").alias("rows"))
    status = c.users.groupBy(F.lit("profile_status").alias("section"), F.col("profile_status").alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    return spells.unionByName(other).unionByName(status)
