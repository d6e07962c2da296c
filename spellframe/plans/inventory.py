"""Inventory job: profiles, keys, joins, schema checks and field mapping of an extract."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_audit
from ..operators.quality import key_checks, profile_columns
from ..sources.catalog import columns_of, field_mapping_check, search_columns


class Inventory(NamedTuple):
    columns: DataFrame
    keys: DataFrame
    joins: DataFrame
    absent: DataFrame | None
    mapping: DataFrame | None


def inventory(tables: dict[str, DataFrame], keys: dict[str, list[str] | None], joins: list[dict],
              distinct: list[str] = (), free_text: list[str] = (), absent_fields: dict[str, list[str]] | None = None,
              mapping: list[dict] | None = None) -> Inventory:
    """``joins``: dicts with name, left, right, left_on, right_on."""
    union = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    tag = lambda df, **c: df.select(*[F.lit(v).alias(n) for n, v in c.items()], "*")
    profile = union([tag(profile_columns(df, list(distinct), list(free_text)), table=n) for n, df in tables.items()])
    key_rows = union([tag(key_checks(df, keys.get(n)), table=n, declared_key=",".join(keys.get(n) or []) or None)
                      for n, df in tables.items()])
    audits = []
    for j in joins:
        if j["left"] in tables and j["right"] in tables:
            audit = join_audit(tables[j["left"]], tables[j["right"]], j["left_on"], j["right_on"], keys.get(j["right"]))
            audits.append(tag(audit, name=j["name"], left_table=j["left"], right_table=j["right"], status="ok"))
        else:
            spark = next(iter(tables.values())).sparkSession
            audits.append(spark.createDataFrame([(j["name"], j["left"], j["right"], "table_missing")],
                                                "name string, left_table string, right_table string, status string"))
    cols = columns_of(tables)
    return Inventory(profile, key_rows, union(audits),
                     search_columns(cols, absent_fields) if absent_fields else None,
                     field_mapping_check(mapping, cols, profile) if mapping else None)
