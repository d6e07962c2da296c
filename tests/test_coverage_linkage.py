from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from spellframe.operators import coverage as C
from spellframe.operators import linkage as L
from spellframe.operators import trends as T
from spellframe.plans import education as ED

EIGHT = [("US", "1"), (" US ", "1"), ("US", "2"), ("CA", "1"), (None, "3"), ("  ", ""), ("Unknown", "4"), ("CA", None)]


def test_coverage_counts(table):
    cov = C.coverage(table(EIGHT, "country string, user_id string"), "country", "user_id").cache()
    assert rows(cov.where("is_total = 1").drop("country", "is_total")) == [(8, 4, 2)]
    got = {(r["country"], r["country_missing"]): r["position_records"] for r in C.coverage_summary(cov).collect()}
    assert got == {("US", False): 3, ("CA", False): 2, ("Unknown", True): 2, ("Unknown", False): 1}
    assert C.coverage_totals(cov).first().asDict() == {"position_records": 8, "people": 4, "missing_person_records": 2,
                                                       "named_countries": 3, "unknown_country_position_records": 2}
    assert C.coverage_problems(cov).count() == 0
    broken = cov.withColumn("position_records", F.when(F.col("is_total") == 1, 9).otherwise(F.col("position_records")))
    assert "category records do not add up" in {r[0] for r in C.coverage_problems(broken).collect()}


def test_ranges_add_up(table):
    data = [(c, None if p is None else Decimal(p)) for c, p in [("A", "-1.5"), ("A", "0"), ("B", "0"), ("B", "2"), ("A", "5"), ("B", None), (None, "2")]]
    df = table(data, "country string, user_id decimal(38,1)")
    parts = C.coverage_ranges(df, "country", "user_id", 2).cache()
    assert {(r["range_lo"], r["range_hi"]) for r in parts.collect()} == {(-2, 0), (0, 2), (2, 4), (4, 6), (None, None)}
    assert rows(C.merge_partials(parts)) == rows(C.coverage(df, "country", "user_id", numeric_person=True))


def test_hot_person_and_country_are_collapsed_before_the_shuffle(table):
    df = table(EIGHT, "country string, user_id string")
    plan = C.coverage(df, "country", "user_id")._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Expand" not in plan


def test_counts_pivot_split(table):
    df = table([("a", 2015, "x"), ("a", 2015, "x"), ("a", 2017, "y"), ("b", None, "z"), ("b", 2030, None)], "s string, y int, user_id string")
    counts = C.group_counts(df, ["s", "y"])
    assert [tuple(r) for r in counts.collect()][0] == ("a", 2015, 2, 1)
    got = C.dense_pivot(counts, "y", "s", "records", 2015, 2017, ["a", "c"]).orderBy("y").collect()
    assert [tuple(r) for r in got] == [(2015, 2, 0), (2016, 0, 0), (2017, 1, 0)]
    split = C.window_split(df, "s", "y", 2015, 2025).orderBy("s").collect()
    assert [tuple(r) for r in split] == [("a", 3, 0, 0, 3, 0), ("b", 2, 1, 0, 0, 1)]
    for r in split:
        assert r["records"] == r["missing_year"] + r["before_window"] + r["in_window"] + r["after_window"]


def test_education(table):
    edu = table([("u1", "1", 1, "Old  Name", "X", "law", " BA ", "2016-05-01"), ("u2", "1", 1, None, None, None, None, None),
                 ("u3", "9", 1, "Elsewhere", "Y", "art", "MA", "2018-01-01")],
                "user_id string, rsid string, education_number int, university_name string, university_country string, field string, degree string, enddate string").withColumn("enddate", F.to_date("enddate"))
    schools = table([("1", "Uni  One", "X"), ("9", None, "Y")], "rsid string, school_name string, country string")
    raw = table([("u1", 1, "uni", "ba", "Polytechnic law", "text")], "user_id string, education_number int, university_raw string, degree_raw string, field_raw string, description string")
    d = ED.education_diagnostic(edu, schools, raw, "X", ["Uni One", "None"], "Uni One", {"poly": r"\bpolytechnic\b"}, 2015, 2017)
    assert rows(d.school_year) == [("Uni One", 2016, 1, 1)]
    assert rows(d.school_coverage) == [("Uni One", 2, 2, 1, 0, 1, 0)]
    assert [tuple(r) for r in d.target_records.orderBy("education_end_year").collect()] == [(2015, 0, 0), (2016, 1, 0), (2017, 0, 0)]
    assert rows(d.clues) == [("poly", "law", "BA", 2016, 1, 1)]
    s = d.summary.first()
    assert (s["home_records"], s["home_people"], s["generic_missing_field"], s["generic_unmatched_raw"], s["country_disagreements"]) == (2, 2, 1, 1, 1)


def test_trend(table):
    data = [(f"2023-{m:02d}-10", m % 2 == 1) for m in range(1, 13) for _ in range(m)] + [("2024-02-10", True)]
    trend = T.monthly_trend(table(data, "d string, f boolean"), "d", "f")
    assert T.trend_problems(trend, len(data)).count() == 0 and T.trend_problems(trend, 1).count() == 1
    series = T.rolling_mean(T.monthly_series(trend)).orderBy("month").collect()
    assert len(series) == 14 and series[12]["all_ads"] == 0 and series[13]["partial_last_month"]
    assert series[10]["rolling_mean"] is None and series[11]["rolling_mean"] == pytest.approx(36 / 12)
    assert series[13]["rolling_mean"] is None
    assert str(T.peak_period(T.monthly_series(trend)).first()["peak_month"]) == "2023-11-01"


def products(table):
    t = table
    return {
        "individual_user": t([(1, "H"), (2, "O"), (3, "O")], "user_id bigint, user_country string"),
        "individual_positions": t([(1, 11, "O", 100, 900), (2, 21, "H", 101, None), (2, 21, "H", 101, None), (2, 22, "O", 102, None), (3, 31, "O", 103, None),
                                   (None, 41, "H", 104, None)], "user_id bigint, position_id bigint, country string, rcid bigint, ultimate_parent_rcid bigint"),
        "individual_positions_raw": t([(1, 11, "a"), (1, 11, "a"), (2, 99, "b"), (3, 31, "c"), (None, 41, "d"), (9, 41, "e")], "user_id bigint, position_id bigint, description string"),
        "individual_user_education": t([(1, 1, 203.0), (3, 1, 204.0)], "user_id bigint, education_number int, rsid double"),
        "individual_user_education_raw": t([(1, 1, "x"), (1, 2, "y"), (3, 1, "z")], "user_id bigint, education_number int, description string"),
        "postings_cosmos": t([(91, "H", 105, 901), (91, "H", 105, 901), (92, "O", 106, None), (9223372036854775807, "H", None, None)],
                             "job_id bigint, country string, rcid bigint, ultimate_parent_rcid bigint"),
        "postings_cosmos_raw": t([(91, "p"), (91, "q"), (92, "r")], "job_id bigint, description string"),
        "company_mapping": t([(c, "H" if c == 500 else "O") for c in (100, 101, 102, 103, 104, 105, 106, 500, 900, 901, 107, 108)], "rcid bigint, hq_country string"),
        "school_mapping": t([(203, "O"), (204, "O"), (300, "H")], "rsid bigint, country string"),
        "sentiment_individual_reviews": t([(107, None, "H")], "rcid bigint, ultimate_parent_rcid bigint, country string"),
        "workforce_dynamics_geo": t([(108, "H")], "rcid bigint, country string"),
        "sentiment_scores": t([(103, 1), (107, 2)], "rcid bigint, score int"), "months": t([("m",)], "month string"),
    }


def test_linked_extract(table):
    p = products(table)
    got = L.linked_extract(p, "H")
    pick = lambda n, *c: rows(got[n].select(*c))
    assert pick("people_cohort", "user_id") == [(1,), (2,)]
    assert pick("individual_positions", "position_id") == [(11,), (21,), (21,), (22,), (41,)]
    assert pick("individual_positions_raw", "description") == [("a",), ("a",), ("d",)]
    assert pick("individual_user_education_raw", "description") == [("x",)]
    assert pick("postings_cosmos_raw", "description") == [("p",), ("q",)]
    assert pick("company_mapping", "rcid") == [(c,) for c in (100, 101, 102, 104, 105, 107, 108, 500, 900, 901)]
    assert pick("school_mapping", "rsid") == [(203,), (300,)]  # 203.0 in education is 203 in the mapping
    assert pick("sentiment_scores", "rcid") == [(107,)] and pick("months", "month") == [("m",)]
    assert dict(rows(L.unmatched_raw(got, p).select("raw_table", "unmatched_rows"))) == {
        "individual_positions_raw": 3, "individual_user_education_raw": 0, "postings_cosmos_raw": 1}
    with pytest.raises(ValueError, match="missing"):
        L.linked_extract({"regions": p["months"]}, "H")


def test_disjoint_batches(table):
    df = table([(i % 97 if i % 10 else None, i) for i in range(500)], "k int, i int")
    out = L.split_disjoint(df, "k", 10).cache()
    assert out.count() == 500 and out.where("batch = -1").count() == 50
    per = out.where("batch >= 0").groupBy("batch").agg(F.count_distinct("k").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("batch").collect()
    assert all(r["n"] == 10 for r in per[:-1]) and all(a["hi"] < b["lo"] for a, b in zip(per, per[1:]))
    with pytest.raises(ValueError):
        L.split_disjoint(df, "k", 0)


def test_numeric_ids(table):
    df = table([("203",), ("203.0",), ("1.50",), ("100",), ("18446744073709551615",), ("x1",), (None,)], "id string")
    assert rows(L.numeric_ids(df, "id")) == [("1.5",), ("100",), ("18446744073709551615",), ("203",), ("x1",)]


def test_hot_paths_select_the_same(table, everything_hot):
    test_linked_extract(table)
    test_disjoint_batches(table)
