"""Tasks of keyed steps grow in number with the table, not in size."""

import pytest

from spellframe import session
from spellframe.operators import endpoints as E
from spellframe.operators import spells as S
from tests.histories import CFG

PANEL = ("user_id string, end_rule string, qidx int, home_fallback boolean, home_position_only boolean, loc_country_fallback string, "
         "loc_country_position_only string, loc_source_fallback string, fallback_timing string, primary_parent_rcid string, primary_rcid string")


@pytest.fixture
def panel(spark):
    lo, hi = CFG.window_quarters["primary"]
    data = [(f"p{n}", "r", q, q < hi, None, "x" if q < hi else "y", None, "position", None, f"g{n}", f"e{q}") for n in range(60) for q in range(lo, hi + 1)]
    return spark.createDataFrame(data, PANEL)


def test_runs_are_dealt_by_rows(panel, monkeypatch):
    """A session's few partitions, or those that adaptive execution joins, do not set how much a task sorts."""
    monkeypatch.setattr(session, "TASK_ROWS", 40)
    moves = S.transitions(S.classify_runs(S.status_runs(S.observations(panel)), [(1, 10**6)]))
    assert moves.rdd.getNumPartitions() == -(-panel.count() // 40) > 8
    assert moves.count() == 60 and moves.where("direction <> 'exit'").isEmpty()


def test_endpoints_are_dealt_by_rows(panel, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 40)
    ends = E.endpoints(panel, CFG)
    assert ends.rdd.getNumPartitions() == -(-panel.count() // 40) > 8
    got = {tuple(r) for r in ends.where("window_name = 'primary' AND location_spec = 'position_with_profile_fallback'").select(
        "endpoint_class", "start_country", "end_country", "home_quarters", "non_home_quarters", "same_company", "same_rcid").collect()}
    lo, hi = CFG.window_quarters["primary"]
    assert got == {("departed", "x", "y", hi - lo, 1, "same", "different")}


def test_fine_tasks(spark):
    """A job that writes tables is cut by the bytes it reads; the session's own settings come back, also after a failure."""
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"]
    before = [spark.conf.get(n, None) for n in names]
    with pytest.raises(RuntimeError), session.fine_tasks(spark, 100 * session.TASK_BYTES + 1):
        assert spark.conf.get(names[0]) == spark.conf.get(names[1]) == "101"
        raise RuntimeError
    with session.fine_tasks(spark, 0):
        assert spark.conf.get(names[0]) == before[0]
    assert [spark.conf.get(n, None) for n in names] == before
