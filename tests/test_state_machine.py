"""Runs and moves on state strings (H home, N away, . unknown) and against a plain walk."""

import random

import pytest

from spellframe.operators import spells as S

SCHEMA = "user_id string, end_rule string, spec string, qidx int, home boolean, obs struct<country:string,source:string,timing:string,parent:string,employer:string>"


def observe(user, start, states):
    return [(user, "r", "s", start + i, c == "H", ("Home" if c == "H" else "Away", "position", None, "firm", "firm"))
            for i, c in enumerate(states) if c != "."]


def derive(spark, data, k, horizon=S.NO_HORIZON):
    runs = S.status_runs(spark.createDataFrame(data, SCHEMA))
    cls = S.classify_runs(runs, [(k, horizon)])
    moves = [(r["user_id"], r["event_q"], r["kind"], r["direction"]) for r in S.transitions(cls).collect()]
    return sorted(moves), {r["user_id"]: r for r in S.person_summary(cls).collect()}


def test_excursion_and_move(spark):
    data = observe("a", 100, "HHHNHHH")
    moves, summary = derive(spark, data, 2)
    assert moves == [] and summary["a"]["excursions"] == 1
    assert derive(spark, data, 1)[0] == [("a", 103, "confirmed", "exit"), ("a", 104, "confirmed", "entry")]
    for k in (1, 2, 4):
        assert derive(spark, observe("a", 100, "HHHNNNN"), k)[0] == [("a", 103, "confirmed", "exit")]


def test_return_and_attributes(spark):
    runs = S.status_runs(spark.createDataFrame(observe("a", 100, "NNHHHNNNHHHH"), SCHEMA))
    got = S.transitions(S.classify_runs(runs, [(2, S.NO_HORIZON)])).orderBy("event_q").collect()
    assert [(r["event_q"], r["direction"], r["home_spell_type"], r["origin_country"], r["destination_country"], r["same_employer"]) for r in got] == [
        (102, "entry", "first", "Away", "Home", "same"), (105, "exit", "first", "Home", "Away", "same"), (108, "entry", "return", "Away", "Home", "same")]
    assert [r["prior_moves_in_block"] for r in got] == [0, 1, 2]


def test_gaps_break_inference(spark):
    assert derive(spark, observe("a", 100, "HHH..NNNN"), 1)[0] == [("a", 105, "gap", "exit")]
    moves, summary = derive(spark, observe("a", 100, "HHN.NNNN"), 2)
    assert moves == [("a", 104, "gap", "exit")] and summary["a"]["unconfirmed_before_gap"] == 1


def test_censoring_and_horizon(spark):
    moves, summary = derive(spark, observe("a", 100, "HHHHN") + observe("b", 100, "NHHHH"), 2)
    assert moves == [("b", 101, "confirmed", "entry")]
    assert summary["a"]["terminal_unconfirmed"] and summary["a"]["terminal_pending_direction"] == "exit"
    assert derive(spark, observe("c", 100, "NHH"), 2)[0] == [("c", 101, "confirmed", "entry")]
    moves, summary = derive(spark, observe("a", 100, "HHHHNNNN"), 4, 105)
    assert moves == [] and summary["a"]["terminal_unconfirmed"]
    assert derive(spark, observe("a", 100, "HHHHNNNN"), 4, 107)[0] == [("a", 104, "confirmed", "exit")]


def walk(states, start, k, horizon):
    """Independent single pass over the state string."""
    out = {"confirmed": [], "gap": [], "excursions": 0, "before_gap": 0, "pending": None}
    seen = [(start + i, c) for i, c in enumerate(states) if c != "." and start + i <= horizon]
    confirmed = None
    i = 0
    while i < len(seen):
        q, c = seen[i]
        j = i
        while j + 1 < len(seen) and seen[j + 1] == (seen[j][0] + 1, c):
            j += 1
        fresh = i == 0 or seen[i - 1][0] != q - 1
        if fresh:
            if confirmed is not None and confirmed != c:
                out["gap"].append((q, c))
            confirmed = c
        elif c != confirmed:
            if j - i + 1 >= k:
                out["confirmed"].append((q, c))
                confirmed = c
            elif j + 1 == len(seen):
                out["pending"] = c
            elif seen[j + 1][0] == seen[j][0] + 1:
                out["excursions"] += 1
            else:
                out["before_gap"] += 1
        i = j + 1
    return out


@pytest.mark.parametrize("horizon", [210, S.NO_HORIZON])
def test_random_histories(spark, horizon):
    rng = random.Random(97)
    people = {f"u{i:03d}": "".join(rng.choices("HHHNN.", k=rng.randint(1, 30))) for i in range(600)}
    data = [r for u, s in people.items() for r in observe(u, 200, s)]
    name = {"H": "entry", "N": "exit"}
    runs = S.status_runs(spark.createDataFrame(data, SCHEMA)).cache()
    cls = S.classify_runs(runs, [(k, horizon) for k in (1, 2, 4)]).cache()
    moves, summary = {}, {}
    for r in S.transitions(cls).collect():
        moves.setdefault((r["user_id"], r["persistence_quarters"], r["kind"]), []).append((r["event_q"], r["direction"]))
    for r in S.person_summary(cls).collect():
        summary[r["user_id"], r["persistence_quarters"]] = r
    for k in (1, 2, 4):
        for u, s in people.items():
            want = walk(s, 200, k, horizon)
            for kind in ("confirmed", "gap"):
                assert sorted(moves.get((u, k, kind), [])) == [(q, name[c]) for q, c in want[kind]], (u, s, k, kind)
            got = summary.get((u, k))
            if got is None:
                assert not [1 for i, c in enumerate(s) if c != "." and 200 + i <= horizon]
                continue
            assert (got["excursions"], got["unconfirmed_before_gap"]) == (want["excursions"], want["before_gap"]), (u, s, k)
            assert got["terminal_pending_direction"] == (name[want["pending"]] if want["pending"] else None)


def test_runs_and_dense_histories_travel_once(table):
    import contextlib
    import io

    from spellframe.operators import panel as P

    def plan(df):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain()
        return out.getvalue()

    p = table([("a", "r", q, t, "x") for q, t in ((200, "position"), (203, "position"), (203, "copy"), (204, "position"))] + [("b", "r", 210, "position", "y")],
              "user_id string, end_rule string, qidx int, obs_type string, place string").selectExpr("*", "'' AS quarter")
    dense = P.dense_history(p)
    assert dense.columns == ["user_id", "end_rule", "qidx", "obs_type", "place", "quarter"]
    got = {(r.user_id, r.qidx, r.obs_type, r.place) for r in dense.collect()}
    assert got == {("a", 200, "position", "x"), ("a", 201, "unobserved_gap", None), ("a", 202, "unobserved_gap", None), ("a", 203, "position", "x"),
                   ("a", 203, "copy", "x"), ("a", 204, "position", "x"), ("b", 210, "position", "y")} and dense.count() == 7
    text = plan(P.dense_history(p))
    assert text.count("Exchange") == 1 and "Join" not in text
    from spellframe.operators import spells as S
    wide = p.selectExpr("user_id", "end_rule", "qidx", "place = 'x' AS home_fallback", "place = 'x' AS home_position_only", "place AS loc_country_fallback", "place AS loc_country_position_only",
                        "obs_type AS loc_source_fallback", "obs_type AS fallback_timing", "place AS primary_parent_rcid", "place AS primary_rcid")
    summary = plan(S.person_summary(S.classify_runs(S.status_runs(S.observations(wide)), [(1, 300)])))
    assert summary.count("Exchange") == 1 and summary.index("Generate") < summary.index("Exchange")  # seen under each specification behind the exchange
