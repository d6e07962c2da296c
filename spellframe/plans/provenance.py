"""Run records: what a stage was run with, and whether a later stage may use it."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import SparkSession

from ..sources.manifests import digest, file_manifest
from .config import HistoryConfig

COMPARED = ("config_sha256", "taxonomy_sha256", "input_listing_sha256")


def _sha(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def run_fingerprint(spark: SparkSession, cfg: HistoryConfig, source_root: str) -> dict[str, str]:
    """Hashes of settings, taxonomy and the input listing (path, size, modification time)."""
    settings = asdict(cfg)
    taxonomy = settings.pop("taxonomy")
    listing = digest(file_manifest(spark, source_root), ["path", "size", "modified"]).first()["sha256"]
    return {"config_sha256": _sha(settings), "taxonomy_sha256": _sha(taxonomy), "input_listing_sha256": listing}


def run_record(stage: str, fingerprint: dict, status: str, **summary) -> dict:
    return {"stage": stage, "status": status, "fingerprint": fingerprint, "summary": summary}


def require_upstream(record: dict | None, stage: str, fingerprint: dict) -> None:
    """Refuse an upstream stage that is absent, unfinished or was run on something else."""
    if record is None:
        raise RuntimeError(f"{stage} has not been run")
    if record["status"] != "complete":
        raise RuntimeError(f"{stage} is {record['status']}")
    for key in COMPARED:
        if record["fingerprint"].get(key) != fingerprint[key]:
            raise RuntimeError(f"{stage} was run with a different {key}; run it again")
