"""What tables and columns exist, and typed projections of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V


def catalog(spark: SparkSession, wanted: dict[str, list[str]]) -> tuple[dict[str, str], DataFrame, list[str]]:
    """(table -> first source that exists, its columns, tables without a source).

    ``wanted`` lists candidate names per table, preferred first.
    """
    found, missing, frames = {}, [], []
    for name, candidates in wanted.items():
        source = next((c for c in candidates if spark.catalog.tableExists(c)), None)
        if source is None:
            missing.append(name)
            continue
        found[name] = source
        rows = [(name, source, f.name, f.dataType.simpleString(), i + 1) for i, f in enumerate(spark.table(source).schema)]
        frames.append(spark.createDataFrame(rows, "table string, source string, column string, type string, position int"))
    empty = spark.createDataFrame([], "table string, source string, column string, type string, position int")
    return found, reduce(DataFrame.unionByName, frames, empty), missing


def columns_of(tables: dict[str, DataFrame]) -> DataFrame:
    """Catalogue (table, column, type, position) of given frames; no data is read."""
    rows = [(t, f.name, f.dataType.simpleString(), i + 1) for t, df in tables.items() for i, f in enumerate(df.schema)]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table string, column string, type string, position int")


def is_identifier(name: str) -> bool:
    return name.endswith(V.ID_SUFFIX) or name in V.ID_NAMES


def target_type(name: str, source_type: str, precision: int | None = None, scale: int | None = None) -> str:
    """Spark type for a source column; ids are text, free-precision numerics are refused."""
    if is_identifier(name):
        return "string"
    if source_type == "numeric":
        if precision is None or scale is None:
            raise ValueError(f"{name}: a numeric column needs precision and scale")
        return f"decimal({int(precision)},{int(scale)})"
    if source_type not in V.SOURCE_TYPES:
        raise ValueError(f"{name}: unsupported source type {source_type!r}")
    return V.SOURCE_TYPES[source_type]


def coerce_schema(df: DataFrame, declared: dict[str, tuple] | None = None) -> DataFrame:
    """Cast columns to their declared source types; undeclared ids still become text."""
    def cast(name) -> Column:
        if declared and name in declared:
            return F.col(name).cast(target_type(name, *declared[name]))
        return F.col(name).cast("string") if is_identifier(name) else F.col(name)
    return df.select(*[cast(c).alias(c) for c in df.columns])


def search_columns(columns: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Fields whose terms occur as whole, neighbouring name parts in some column.

    ``age`` finds ``age_group`` but not ``average``.
    """
    tokens = F.split(F.lower("column"), "_")
    def has(term: str) -> Column:
        parts = F.array(*[F.lit(p) for p in term.lower().split("_")])
        n = len(term.split("_"))
        starts = F.sequence(F.lit(1), F.size(tokens) - n + 1)
        return F.coalesce(F.when(F.size(tokens) >= n, F.exists(starts, lambda i: F.slice(tokens, i, n) == parts)), F.lit(False))
    hits = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [has(t) for t in terms]), F.lit(field))
                                     for field, terms in wanted.items()]))
    found = (columns.select(F.explode(hits).alias("field"), F.concat_ws(".", "table", "column").alias("column"))
             .groupBy("field").agg(F.array_sort(F.collect_set("column")).alias("matching_columns")))
    fields = columns.sparkSession.createDataFrame([(f, t) for f, t in wanted.items()], "field string, search_terms array<string>")
    return fields.join(found, "field", "left").select(
        "field", "search_terms", F.coalesce("matching_columns", F.array().cast("array<string>")).alias("matching_columns"),
        F.when(F.col("matching_columns").isNull(), "absent").otherwise("review: candidate columns found").alias("status"))


def field_mapping_check(mapping: list[dict], columns: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Declared analytical fields against the catalogue: (field, table, column, present, null_share, missing_lookups)."""
    spark = columns.sparkSession
    rows = [(m["field"], m["table"], c, m.get("lookups") or []) for m in mapping for c in m["columns"]]
    declared = spark.createDataFrame(rows, "field string, table string, column string, lookups array<string>")
    known = columns.select("table", "column", F.lit(True).alias("_present"))
    have = columns.agg(F.collect_set("table").alias("t")).scalar()
    out = declared.join(known, ["table", "column"], "left")
    if profile is not None:
        out = out.join(profile.select("table", "column", "null_share"), ["table", "column"], "left")
    else:
        out = out.withColumn("null_share", F.lit(None).cast("double"))
    return out.select("field", "table", "column", F.coalesce("_present", F.lit(False)).alias("present"), "null_share",
                      F.array_except("lookups", have).alias("missing_lookups"))
