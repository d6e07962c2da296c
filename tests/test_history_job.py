"""The whole measurement job on hand-made histories."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from histories import CFG, HOME, SG, frames
from spellframe.functions import fixed_values as V
from spellframe.functions import label_of
from spellframe.operators import diagnostics as D
from spellframe.operators import endpoints as E
from spellframe.operators import panel as P
from spellframe.plans import coverage_report as R
from spellframe.plans import migration as M
from spellframe.plans.clean import clean, clean_summary, dedupe_report
from spellframe.plans.config import HistoryConfig
from spellframe.session import stage

CARRY, CAP = V.CARRY_TO_CUTOFF, V.CAP_AT_LAST_REFRESH
FALLBACK, POSITION = V.FALLBACK_SPEC, V.POSITION_SPEC


@pytest.fixture(scope="module")
def job(spark):
    f = frames(spark)
    c = clean(f["positions"], f["users"], f["cohort"], CFG, f["positions_raw"],
              {"role_lookup_v3": (f["role_lookup_v3"], "role_k17000_v3", "role_v3_unmatched")}, keep=stage)
    panel = stage(P.person_quarter_panel(c.valid, c.users, CFG), "panel")
    mig = M.migration(panel, CFG)
    rep = M.replication(panel, mig.runs, CFG)
    return {"clean": c, "panel": panel.cache(), "migration": mig, "replication": rep,
            "measures": rep.measures.cache(), "moves": mig.transitions.cache()}


def quarter(job, user, label, rule=CARRY):
    got = job["panel"].where((F.col("user_id") == user) & (F.col("quarter") == label) & (F.col("end_rule") == rule)).collect()
    return got[0] if got else None


def estimate(job, measure, method="endpoint", window="primary", rule=CARRY, spec=FALLBACK, k=None):
    got = job["measures"].where(
        (F.col("measure") == measure) & (F.col("method") == method) & (F.col("window_name") == window) & (F.col("end_rule") == rule)
        & (F.col("location_spec") == spec) & F.col("persistence_quarters").eqNullSafe(k)).collect()
    assert len(got) == 1
    return got[0]["estimate"]


def test_quarter_end_month_decides(job):
    assert quarter(job, "p02", "2019Q4")["position_country"] == HOME
    assert quarter(job, "p02", "2020Q1")["position_country"] == SG
    assert quarter(job, "p03", "2020Q1")["position_country"] == HOME  # March is the last month worked
    assert quarter(job, "p03", "2020Q2")["position_country"] == SG
    assert job["panel"].where("user_id = 'p04'").count() == 0


def test_concurrent_spells(job):
    r = quarter(job, "p05", "2020Q2")
    assert (r["primary_position_id"], r["position_country"], r["alt_countries"], r["n_active"]) == ("501", HOME, [SG], 2)
    assert r["country_conflict"] and r["downrank_changed_primary"] and r["downrank_changed_country"]
    assert not quarter(job, "p05", "2020Q1")["country_conflict"]
    tie = quarter(job, "p06", "2017Q1")
    assert (tie["primary_position_id"], tie["alt_countries"], tie["any_active_home"]) == ("1000", [HOME], True)


def test_quarantine_and_profiles(job):
    reasons = {r["position_id"]: r["quarantine_reason"] for r in job["clean"].quarantine.collect()}
    assert (reasons["701"], reasons["902"], reasons["2301"]) == ("undated", "start_after_cutoff", "conflicting_duplicate_key")
    r = quarter(job, "p10", "2020Q1")
    assert (r["loc_country_fallback"], r["loc_source_fallback"], r["fallback_timing"]) == (HOME, "profile_fallback", "backcast")
    assert r["loc_country_position_only"] is None and r["home_position_only"] is None
    assert quarter(job, "p10", "2026Q2")["fallback_timing"] == "snapshot"
    timing = {r["quarter"]: r["fallback_timing"] for r in job["panel"].where(f"user_id = 'p11' AND end_rule = '{CARRY}'").collect()}
    assert (timing["2016Q4"], timing["2017Q1"], timing["2018Q4"]) == ("backcast", "snapshot", "forwardcast")
    assert "2019Q1" not in timing
    for user in ("p08", "p12", "p23"):
        got = job["panel"].where(f"user_id = '{user}' AND end_rule = '{CARRY}'").select(
            "quarter", "obs_type", "home_fallback", "home_position_only").collect()
        assert [tuple(r) for r in got] == [("2026Q2", "profile_snapshot", True, None)]
    assert job["panel"].where("user_id = 'p13'").count() == 0
    last = lambda rule: job["panel"].where(f"user_id = 'p14' AND end_rule = '{rule}'").agg(F.max("quarter")).first()[0]
    assert (last(CARRY), last(CAP)) == ("2026Q2", "2020Q4")
    assert P.duplicate_panel_keys(job["panel"]).count() == 0


def test_duplicates_titles_and_large_ids(job):
    counts = {r["source_table"]: r for r in dedupe_report(job["clean"]).collect()}
    assert counts["positions"]["exact_duplicate_rows_collapsed"] == 1 and counts["positions"]["conflicting_keys"] == 1
    assert counts["raw_titles"]["exact_duplicate_rows_collapsed"] == 1 and counts["raw_titles"]["conflicting_keys"] == 1
    assert counts["role_lookup_v3"]["conflicting_keys"] == 1
    for r in counts.values():
        assert r["rows_kept"] + r["exact_duplicate_rows_collapsed"] + r["rows_in_conflicting_keys"] + r["null_key_rows"] == r["rows_in"]
    summary = {(r["section"], r["label"]): r["rows"] for r in clean_summary(job["clean"]).collect()}
    assert summary["title_status", "conflicting_raw_key"] == 1
    assert job["clean"].positions.where("role_v3_unmatched").count() == 1
    ids = rows(job["panel"].where("user_id = '2400288101'").select("primary_position_id").distinct())
    assert ids == [("-9223372036854775808",), ("18446744073709551615",), ("9223372036854775807",)]


def events(job, user, k):
    got = job["moves"].where(f"user_id = '{user}' AND persistence_quarters = {k} AND end_rule = '{CARRY}' AND spec = '{FALLBACK}'")
    return [(label_of(r["event_q"]), r["kind"], r["direction"], r["home_spell_type"]) for r in got.orderBy("event_q").collect()]


def test_events(job):
    assert events(job, "p15", 1) == [("2021Q1", "confirmed", "exit", "first"), ("2021Q2", "confirmed", "entry", "return")]
    assert events(job, "p15", 2) == []
    for k in (1, 2, 4):
        assert events(job, "p16", k) == [("2020Q1", "confirmed", "exit", "first"), ("2022Q1", "confirmed", "entry", "return")]
        assert events(job, "p17", k) == [("2021Q1", "gap", "exit", "first")]
    assert events(job, "p18", 4) == [("2023Q2", "confirmed", "entry", "first")]
    assert events(job, "p01", 1) == [] and events(job, "p19", 1) == []
    got = job["migration"].home_spells.where(f"user_id = 'p17' AND end_rule = '{CARRY}' AND spec = '{FALLBACK}'").collect()
    assert [(label_of(r["start_q"]), r["quarters"], r["preceded_by"], r["followed_by"]) for r in got] == [("2015Q1", 22, "record_start", "unknown_gap")]


def test_endpoints_and_events_in_window(job):
    assert [estimate(job, m) for m in ("stayed", "entered", "departed", "net")] == [9, 1, 6, -5]
    assert estimate(job, "stayed", spec=POSITION) == 8 and estimate(job, "stayed", rule=CAP) == 8
    assert estimate(job, "unclassified_home_at_start_unknown_at_end", rule=CAP) == 1
    assert (estimate(job, "stayed_round_trip_out"), estimate(job, "stayed_continuous_home")) == (2, 7)
    assert estimate(job, "outside_home_at_both") == 1 and estimate(job, "unclassified_unknown_at_start_home_at_end") == 1
    assert estimate(job, "departed_same_company") == 1 and estimate(job, "departed_unknown_company") == 1
    assert estimate(job, "stayed_using_profile_location") == 1
    ev = lambda m, k: estimate(job, m, "quarterly_events", k=k)
    assert {k: (ev("entries", k), ev("exits", k)) for k in (1, 2, 4)} == {1: (3, 7), 2: (2, 6), 4: (1, 6)}
    assert ev("gap_exits_undated", 1) == 1 and ev("departed_via_gap_only", 1) == 1 and ev("stayed_with_confirmed_exit", 1) == 2
    assert ev("people_censored_unconfirmed_at_window_end", 4) == 1
    assert (ev("entered_with_confirmed_entry", 4), ev("entered_with_confirmed_entry", 2)) == (0, 1)


def test_benchmarks(job, spark):
    bench = spark.createDataFrame([("stayed", 255911, "text"), ("table_total_departed", 26836, "text")],
                                  "measure string, benchmark bigint, benchmark_source string")
    check = spark.createDataFrame([("table_total_departed", 26896, "sum of cells")], "measure string, estimate bigint, note string")
    none = spark.createDataFrame([("net_by_age", "no birth year")], "measure string, note string")
    report = E.attach_benchmarks(job["measures"], bench, CFG, check, none)
    got = report.collect()
    primary = [r for r in got if r["primary_specification"] and r["measure"] == "stayed"]
    assert len(primary) == 1 and primary[0]["benchmark"] == 255911 and primary[0]["difference"] == 9 - 255911
    assert [(r["estimate"], r["benchmark"]) for r in got if r["method"] == "benchmark_consistency"] == [(26896, 26836)]
    assert got[-1]["method"] == "unavailable" and got[-1]["benchmark"] is None
    assert dict(rows(E.headline(report))) == {"stayed": 9, "entered": 1, "departed": 6, "net": -5}


def test_complete_sample(job):
    sample = M.history_sample(job["panel"], job["moves"], CFG, "salt", 1000).cache()
    people = job["panel"].where(f"end_rule = '{CARRY}'").select("user_id").distinct().count()
    assert sample.select("user_id").distinct().count() == people
    gaps = sample.where(f"user_id = 'p17' AND end_rule = '{CARRY}' AND obs_type = 'unobserved_gap'").select("quarter")
    assert rows(gaps) == [("2020Q3",), ("2020Q4",)]
    flag = sample.where(f"user_id = 'p15' AND end_rule = '{CARRY}' AND quarter = '2021Q1'").first()
    assert (flag["transition_fallback_k1"], flag["transition_fallback_k2"]) == ("exit", None)


def test_reports(job):
    c, panel = job["clean"], job["panel"]
    report = R.coverage_report(c, panel, CFG, "2024-01-01").cache()
    only = {(r["period"], r["value"], r["is_partial_period"]) for r in report.where("measure = 'profile_only_people' AND section = 'profile_refresh'").collect()}
    assert ("2026Q3", 1, True) in only and sum(v for _, v, _ in only) == 4
    marked = report.where("period_type = 'year' AND year = 2026").select("is_partial_period").distinct()
    assert rows(marked) == [(True,)]
    assert report.where("denominator > 0 AND share IS NULL").count() == 0
    miss = D.location_missingness(panel, CFG)
    total = miss.where(f"quarter = 'all' AND end_rule = '{CARRY}' AND location_spec = '{FALLBACK}'").first()
    assert total["person_quarters"] == panel.where(f"end_rule = '{CARRY}'").count()
    assert total["people_in_span"] - total["person_quarters"] == total["unobserved_gap_quarters_within_span"]
    audit = D.title_audit(c.valid).collect()
    assert [(r["rule_id"], r["title"], r["title_rank"]) for r in audit] == [("board/board_member", "board member", 1)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_results_do_not_depend_on_partitions_or_hot_split(job, spark, everything_hot, partitions):
    c = job["clean"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        hot = P.person_quarter_panel(c.valid, c.users, CFG, split_hot=True)   # most people take the hot path
        plain = P.person_quarter_panel(c.valid, c.users, CFG, split_hot=False)
        want = rows(job["panel"].drop("alt_countries"))
        assert rows(hot.select(job["panel"].columns).drop("alt_countries")) == want
        assert rows(plain.select(job["panel"].columns).drop("alt_countries")) == want
        sample = M.history_sample(plain, M.migration(plain, CFG).transitions, CFG, "s", 5)
        assert rows(sample.select("user_id").distinct()) == rows(
            M.history_sample(job["panel"], job["moves"], CFG, "s", 5).select("user_id").distinct())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_cutoff_must_fit():
    with pytest.raises(ValueError, match="partial quarter"):
        HistoryConfig(cutoff="2026-08-31", last_complete_quarter="2026Q1", partial_quarter="2026Q3")
    with pytest.raises(ValueError, match="partial quarter"):
        HistoryConfig(cutoff="2026-05-31", last_complete_quarter="2026Q2", partial_quarter="2026Q3")


def test_staged_job(spark, tmp_path):
    from histories import frames as make
    from spellframe.plans.history_job import HistoryJob
    from spellframe.sources.tables import write_table
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    f = make(spark)
    for name, df in f.items():
        write_table(df, f"{src}/{name}")
    settings = dict(tables={r: r for r in ("positions", "users", "cohort", "positions_raw")},
                    lookups={"v3": ("role_lookup_v3", "role_k17000_v3", "role_v3_unmatched")})
    bench = spark.createDataFrame([("stayed", 255911, "text")], "measure string, benchmark bigint, benchmark_source string")
    job = HistoryJob(spark, src, out, CFG, benchmarks=bench, **settings)
    with pytest.raises(RuntimeError, match="has not been run"):
        job.run(["panel"])
    job.run()
    report = spark.read.option("header", True).option("escape", '"').csv(f"{out}/reports/replication_summary")
    got = report.where("primary_specification = 'true' AND measure IN ('stayed', 'entered', 'departed', 'net')").select("measure", "estimate")
    assert dict(rows(got)) == {"stayed": "9", "entered": "1", "departed": "6", "net": "-5"}
    assert spark.read.parquet(f"{out}/sample").select("user_id").distinct().count() > 20
    (tmp_path / "src" / "users" / "more.parquet").write_bytes(next((tmp_path / "src" / "users").glob("*.parquet")).read_bytes())
    with pytest.raises(RuntimeError, match="input_listing"):
        HistoryJob(spark, src, out, CFG, **settings).run(["migration"])
    manifest = spark.createDataFrame([("positions", "complete", 1, None, 1, 1)], "table string, status string, rows bigint, expected_rows bigint, parts bigint, bytes bigint")
    with pytest.raises(ValueError, match="reconciliation failed"):
        HistoryJob(spark, src, out, CFG, manifest=manifest, **settings).run(["inventory"])
    assert job.record_of("inventory")["status"] == "failed"
