"""Migration job: runs, spells, transitions, summaries and endpoint comparison for every variant."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import quarter_label
from ..operators import endpoints as E
from ..operators import spells as S
from ..operators.panel import dense_history
from ..operators.sampling import hash_sample
from .config import HistoryConfig


class Migration(NamedTuple):
    runs: DataFrame
    home_spells: DataFrame
    transitions: DataFrame
    person_summary: DataFrame
    by_quarter: DataFrame


def migration(panel: DataFrame, cfg: HistoryConfig, runs: DataFrame | None = None) -> Migration:
    """Every end rule x specification x persistence over the whole record."""
    runs = S.status_runs(S.observations(panel)) if runs is None else runs
    cls = S.classify_runs(runs, [(k, cfg.last_q) for k in cfg.persistence])
    moves = S.transitions(cls)
    return Migration(runs, S.home_spells(runs, cfg.last_q), moves, S.person_summary(cls), S.transitions_by_quarter(moves))


class Replication(NamedTuple):
    endpoints: DataFrame
    window_transitions: DataFrame
    measures: DataFrame


def replication(panel: DataFrame, runs: DataFrame, cfg: HistoryConfig) -> Replication:
    """Endpoint classes with window events; windows that end together share one classification."""
    horizons = sorted({b for _, b in cfg.window_quarters.values()})
    cls = S.classify_runs(runs, [(k, h) for k in cfg.persistence for h in horizons])
    moves, summary = S.transitions(cls), S.person_summary(cls)
    ends = E.window_events(E.endpoints(panel, cfg), moves, summary, cfg)
    inside = E.window_transitions(moves, cfg)
    measures = (E.endpoint_measures(ends).unionByName(E.event_measures(inside))
                .unionByName(E.cross_measures(ends, cfg)))
    return Replication(ends, inside, measures)


def history_sample(panel: DataFrame, moves: DataFrame, cfg: HistoryConfig, salt: str, people: int) -> DataFrame:
    """Complete dense histories of a hash sample of panel participants with their events.

    The sample has at most ``people`` rows, so it is broadcast to cut both frames.
    """
    chosen = hash_sample(panel.where(F.col("end_rule") == cfg.primary_rule), "user_id", salt, people)
    few = F.broadcast(chosen)
    history = dense_history(panel.join(few.select("user_id"), "user_id", "left_semi"))
    label = F.when(F.col("kind") == "gap", F.concat(F.lit("gap_"), "direction")).otherwise(F.col("direction"))
    short = {V.FALLBACK_SPEC: "fallback", V.POSITION_SPEC: "position_only"}
    flags = (moves.join(few.select("user_id"), "user_id", "left_semi")
             .groupBy("user_id", "end_rule", F.col("event_q").alias("qidx")).agg(*[
                 F.max(F.when((F.col("spec") == s) & (F.col("persistence_quarters") == k), label)).alias(f"transition_{n}_k{k}")
                 for s, n in short.items() for k in cfg.persistence]))
    return (history.join(flags, ["user_id", "end_rule", "qidx"], "left").join(few, "user_id")
            .withColumn("quarter", quarter_label("qidx")).orderBy("sample_rank", "end_rule", "qidx"))
