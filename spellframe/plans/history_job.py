"""The measurement job end to end: inventory, clean, panel, reports, migration, replication.

Every stage reads what earlier stages wrote and writes its own tables below ``out``, so
a stage can be run again on its own and no frame is computed twice.  Each stage leaves a
record; a later stage refuses records made from other settings or other inputs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnostics as D
from ..operators import endpoints as E
from ..operators.panel import duplicate_panel_keys, person_quarter_panel
from ..operators.quality import require_empty
from ..sources.manifests import measure_tables, reconcile, schema_signatures
from ..sources.tables import read_table, write_csv, write_table
from . import coverage_report as R
from . import migration as M
from .clean import clean, dedupe_report
from .config import HistoryConfig
from .inventory import inventory
from .provenance import require_upstream, run_fingerprint

STAGES = ("inventory", "clean", "panel", "reports", "migration", "replication")
NEEDS = {"inventory": (), "clean": ("inventory",), "panel": ("clean",), "reports": ("inventory", "clean", "panel"),
         "migration": ("panel",), "replication": ("panel", "migration")}


@dataclass
class HistoryJob:
    """``tables``: role -> table name below ``source``; roles positions, users, cohort and
    optionally positions_raw; ``lookups``: name -> (table, key, flag column).

    For the inventory: ``keys`` (table -> declared key) and ``joins`` (as ``plans.inventory`` takes them) default to the keys and joins
    of the cleaning; ``wanted_fields`` and ``mapping`` are checked against the catalogue when given.
    """

    spark: SparkSession
    source: str
    out: str
    cfg: HistoryConfig
    tables: dict[str, str]
    lookups: dict[str, tuple[str, str, str]] | None = None
    manifest: DataFrame | None = None
    benchmarks: DataFrame | None = None
    sample_people: int = 1000
    sample_salt: str = "spellframe-sample"
    refresh_months_since: str = "2024-01-01"
    keys: dict[str, list[str] | None] | None = None
    joins: list[dict] | None = None
    wanted_fields: dict[str, list[str]] | None = None
    mapping: list[dict] | None = None

    def __post_init__(self):
        self.fingerprint = run_fingerprint(self.spark, self.cfg, self.source)

    # -- plumbing -------------------------------------------------------------------------
    def _src(self, role: str) -> DataFrame:
        return read_table(self.spark, self.source, self.tables[role])

    def _save(self, df: DataFrame, name: str) -> DataFrame:
        write_table(df, f"{self.out}/{name}", mode="overwrite")
        return self._load(name)

    def _load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/{name}")

    def _report(self, df: DataFrame, name: str) -> None:
        write_csv(df, f"{self.out}/reports/{name}", mode="overwrite")

    def _record(self, stage: str, status: str) -> None:
        rows = [(stage, status, *[self.fingerprint[k] for k in sorted(self.fingerprint)])]
        names = ["stage", "status", *sorted(self.fingerprint)]
        self.spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).coalesce(1).write.mode("overwrite").json(f"{self.out}/run/{stage}")

    def record_of(self, stage: str) -> dict | None:
        try:
            row = self.spark.read.json(f"{self.out}/run/{stage}").first()
        except Exception:  # noqa: BLE001  no record written yet
            return None
        d = row.asDict()
        return {"stage": d.pop("stage"), "status": d.pop("status"), "fingerprint": d}

    def run(self, stages=STAGES) -> None:
        for stage in stages:
            for upstream in NEEDS[stage]:
                require_upstream(self.record_of(upstream), upstream, self.fingerprint)
            try:
                getattr(self, stage)()
                now = run_fingerprint(self.spark, self.cfg, self.source)
                if now["input_listing_sha256"] != self.fingerprint["input_listing_sha256"]:
                    raise RuntimeError(f"inputs changed during {stage}")
            except Exception:
                self._record(stage, "failed")
                raise
            self._record(stage, "complete")

    # -- stages ---------------------------------------------------------------------------
    def _declared(self) -> tuple[dict, list[dict]]:
        """Keys and joins that the cleaning relies on."""
        ids = {"positions": "position_id", "users": "user_id", "cohort": "user_id", "positions_raw": "position_id"}
        keys = {self.tables[role]: [ids[role]] for role in self.tables if role in ids}
        keys |= {table: [key] for table, key, _ in (self.lookups or {}).values()}
        spells = self.tables["positions"]
        joins = [{"name": f"positions_to_{role}", "left": spells, "right": self.tables[role], "left_on": [ids[role]], "right_on": [ids[role]]}
                 for role in ("users", "cohort", "positions_raw") if role in self.tables]
        joins += [{"name": f"positions_to_{name}", "left": spells, "right": table, "left_on": [key], "right_on": [key]}
                  for name, (table, key, _) in (self.lookups or {}).items()]
        return self.keys or keys, self.joins or joins

    def inventory(self) -> None:
        names = sorted(set(self.tables.values()) | {t for t, _, _ in (self.lookups or {}).values()})
        measured = measure_tables(self.spark, self.source, names)
        signatures = reduce(DataFrame.unionByName, [schema_signatures(self.spark, self.source, n).withColumn("table", F.lit(n)) for n in names])
        signatures = self._save(signatures, "inventory/part_schemas")
        self._report(signatures, "part_schemas")
        tables = {n: read_table(self.spark, self.source, n) for n in names}
        keys, joins = self._declared()
        found = inventory(tables, keys, joins, sorted({c for k in keys.values() for c in k or []}), absent_fields=self.wanted_fields, mapping=self.mapping)
        self._report(found.columns, "columns")
        self._report(found.keys, "keys")
        self._report(self._save(found.joins, "inventory/joins"), "joins")
        if found.absent is not None:
            self._report(found.absent, "absent_fields")
        if found.mapping is not None:
            self._report(found.mapping, "field_mapping")
        if self.manifest is None:
            self._report(measured, "tables")
            return
        schemas = signatures.groupBy("table").agg(F.count(F.lit(1)).alias("distinct_file_schemas"))
        checked = reconcile(self.manifest.where(F.col("table").isin(*names)), measured, schemas)
        self._report(checked, "tables")
        require_empty(checked.where(F.size("problems") > 0).select("table", "problems"), "inventory reconciliation failed")

    def _cleaned(self, keep):
        raw = self._src("positions_raw") if "positions_raw" in self.tables else None
        looks = {n: (read_table(self.spark, self.source, t), k, f) for n, (t, k, f) in (self.lookups or {}).items()}
        return clean(self._src("positions"), self._src("users"), self._src("cohort"), self.cfg, raw, looks, keep=keep)

    def clean(self) -> None:
        c = self._cleaned(lambda df, name: self._save(df, f"clean/{name}"))
        self._save(c.quarantine, "clean/quarantine")
        self._save(c.other_quarantine, "clean/other_quarantine")
        self._report(dedupe_report(c), "dedupe")

    def panel(self) -> None:
        valid = self._load("clean/positions").where(F.col("quarantine_reason").isNull())
        p = self._save(person_quarter_panel(valid, self._load("clean/users"), self.cfg), "panel")
        require_empty(duplicate_panel_keys(p), "panel keys are not unique")

    def reports(self) -> None:
        c = self._cleaned(lambda df, name: self._load(f"clean/{name}"))
        p = self._load("panel")
        self._report(R.coverage_report(c, p, self.cfg, self.refresh_months_since, self._load("inventory/joins")), "coverage")
        self._report(D.location_missingness(p, self.cfg), "location_missingness")
        if "title_raw" in c.positions.columns:
            self._report(D.title_audit(c.valid), "title_audit")

    def migration(self) -> None:
        p = self._load("panel")
        runs = self._save(M.S.status_runs(M.S.observations(p)), "migration/runs")
        m = M.migration(p, self.cfg, runs)
        self._save(m.home_spells, "migration/home_spells")
        moves = self._save(m.transitions, "migration/transitions")
        self._save(m.person_summary, "migration/person_summary")
        self._report(M.S.transitions_by_quarter(moves), "transitions_by_quarter")

    def replication(self) -> None:
        p = self._load("panel")
        r = M.replication(p, self._load("migration/runs"), self.cfg)
        ends = self._save(r.endpoints, "replication/endpoints")
        inside = self._save(r.window_transitions, "replication/window_transitions")
        measures = (E.endpoint_measures(ends).unionByName(E.event_measures(inside)).unionByName(E.cross_measures(ends, self.cfg)))
        bench = self.benchmarks
        if bench is None:
            bench = self.spark.createDataFrame([], "measure string, benchmark bigint, benchmark_source string")
        self._report(E.attach_benchmarks(measures, bench, self.cfg), "replication_summary")
        self._save(M.history_sample(p, self._load("migration/transitions"), self.cfg, self.sample_salt, self.sample_people), "sample")
