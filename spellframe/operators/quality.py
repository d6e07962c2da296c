"""Key checks, de-duplication with quarantine, column profiles."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import any_null, blank_to_null, first_reason
from .skew import find_sized, salted_join


class Deduplicated:
    """Outcome of ``dedupe_quarantine``: everything but the quarantined rows comes from one table of keys."""

    def __init__(self, rows: DataFrame, keys: DataFrame, key: list[str], columns: list[str]):
        self._rows, self._key, self._columns = rows, key, columns
        self._all, self._keys = keys, keys.where(~any_null(key))
        self._clash = F.col("_versions") > 1

    @property
    def kept(self) -> DataFrame:
        """One row per sound key."""
        return self._keys.where(~self._clash).select(
            *self._key, *[F.col("_row")[c].alias(c) for c in self._columns])

    @property
    def keyed(self) -> DataFrame:
        """One row per non-NULL key: ``conflicting`` and the columns (NULL if so)."""
        return self._keys.select(
            *self._key, self._clash.alias("conflicting"),
            *[F.when(~self._clash, F.col("_row")[c]).alias(c) for c in self._columns])

    @cached_property
    def quarantine(self) -> DataFrame:
        """Every row with a NULL or conflicting key, copies included, with its reason."""
        clashing = self._keys.where(self._clash).select(*self._key)
        null = any_null(self._key)
        keyed = self._rows.where(~null)
        conflicts = salted_join(keyed, clashing, self._key, "left_semi", hot=find_sized(keyed, self._key))
        return (conflicts.withColumn("quarantine_reason", F.lit("conflicting_duplicate_key"))
                .unionByName(self._rows.where(null).withColumn("quarantine_reason", F.lit("missing_key"))))

    @property
    def counts(self) -> DataFrame:
        """One row; kept + collapsed + conflicting + null = rows_in."""
        n, zero = F.col("_copies"), F.lit(0).cast("bigint")
        total = lambda cond, v: F.coalesce(F.sum(F.when(cond, v)), zero)
        null = any_null(self._key)
        got = self._all.agg(
            F.coalesce(F.sum(n), zero).alias("rows_in"), F.count_if(~null).alias("distinct_keys"),
            total(~null & ~self._clash, n - 1).alias("exact_duplicate_rows_collapsed"), F.count_if(~null & self._clash).alias("conflicting_keys"),
            total(~null & self._clash, n).alias("rows_in_conflicting_keys"), F.count_if(~null & ~self._clash).alias("rows_kept"),
            total(null, n).alias("null_key_rows"))
        return got


def content_digest(columns: list[str]) -> list[Column]:
    """Two 64-bit hashes of a content; a NULL is told from every value."""
    parts = [p for c in columns for p in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(seed), *parts).alias(f"_d{seed}") for seed in (1, 2)]


def _copies(df: DataFrame, key: list[str], *aggs: Column) -> DataFrame:
    """One row per key and content digest with its number of copies; copies collapse map-side, so no key is hot by its copies."""
    return df.groupBy(*key, *content_digest([c for c in df.columns if c not in key])).agg(F.count(F.lit(1)).alias("_n"), *aggs)


def _per_key(df: DataFrame, key: list[str]) -> DataFrame:
    """Per key, NULL keys too: number of contents, of rows, and the content of a key that has one."""
    payload = [c for c in df.columns if c not in key]
    row = F.struct(*payload) if payload else F.struct(F.lit(None).alias("_none"))
    return _copies(df, key, F.first(row).alias("_row")).groupBy(*key).agg(
        F.count(F.lit(1)).alias("_versions"), F.sum("_n").alias("_copies"), F.first("_row").alias("_row"))


def dedupe_quarantine(df: DataFrame, key: list[str], columns: list[str], keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Deduplicated:
    """Collapse exact copies; set aside rows with a NULL key or a key with several contents.

    Two levels: by (key, content digest), then by key.  ``keep`` is applied to the table of keys; pass one that writes it when
    kept rows, counts and quarantine are all read.
    """
    rows = df.select(*key, *columns)
    return Deduplicated(rows, keep(_per_key(rows, key)), key, columns)


def key_checks(df: DataFrame, key: list[str] | None) -> DataFrame:
    """One row of duplicate and conflict counts for a declared key, or for whole rows."""
    zero = F.lit(0).cast("bigint")
    if not key:
        return _copies(df, []).agg(
            F.coalesce(F.sum(F.col("_n") - 1), zero).alias("exact_duplicate_rows"),
            F.count(F.lit(1)).alias("distinct_rows"))
    missing = [k for k in key if k not in df.columns]
    if missing:
        raise ValueError(f"missing key columns {missing}")
    null, n, v = any_null(key), F.col("_copies"), F.col("_versions")
    repeated = ~null & (n > 1)
    total = lambda cond, value: F.coalesce(F.sum(F.when(cond, value)), zero)
    return _copies(df, key).groupBy(*key).agg(
        F.count(F.lit(1)).alias("_versions"), F.sum("_n").alias("_copies")).agg(
        total(null, n).alias("null_key_rows"), F.count_if(repeated).alias("duplicate_key_groups"),
        total(repeated, n).alias("rows_in_duplicate_keys"),
        F.count_if(repeated & (v > 1)).alias("conflicting_keys"),
        total(repeated & (v > 1), n).alias("rows_in_conflicting_keys"),
        total(repeated, n - v).alias("exact_duplicate_rows"))


def profile_columns(df: DataFrame, distinct: list[str] = (), free_text: list[str] = ()) -> DataFrame:
    """Counts, blanks, extremes and (for listed columns) distinct values, one row per column.

    One aggregate for everything but the distinct counts; those of all listed columns come from one pass that counts
    (column, value) pairs, collapsed map-side.
    """
    ordered = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
    text = T.StringType
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(df.schema):
        aggs.append(F.count(f.name).alias(f"_c{i}"))
        if isinstance(f.dataType, text) and f.name not in free_text:
            aggs.append(F.count_if(F.trim(f.name) == "").alias(f"_b{i}"))
        if isinstance(f.dataType, ordered):
            aggs += [F.min(f.name).cast("string").alias(f"_lo{i}"), F.max(f.name).cast("string").alias(f"_hi{i}")]
    made = {a for a in df.agg(*aggs).columns}
    pick = lambda name, kind: (F.col(name) if name in made else F.lit(None)).cast(kind)
    entries = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                        F.lit(i + 1).alias("position"), F.col("_rows").alias("rows"),
                        F.col(f"_c{i}").alias("non_null"), pick(f"_b{i}", "bigint").alias("blank_strings"),
                        pick(f"_lo{i}", "string").alias("min_value"), pick(f"_hi{i}", "string").alias("max_value"))
               for i, f in enumerate(df.schema)]
    base = df.agg(*aggs).select(F.inline(F.array(*entries)))
    listed = [c for c in distinct if c in df.columns]
    if listed:
        # Adding 0 makes one value of 0.0 and -0.0.
        value = lambda c: F.col(c) + F.lit(0.0).cast(df.schema[c].dataType) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else F.col(c)
        text_of = lambda c: F.hex(c) if isinstance(df.schema[c].dataType, T.BinaryType) else value(c).cast("string")
        cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), text_of(c).alias("_v")) for c in listed])))
        counted = (cells.where(F.col("_v").isNotNull()).groupBy("column", "_v").agg(F.lit(1).alias("_one"))
                        .groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values")))
        none = df.sparkSession.createDataFrame([(c,) for c in listed], "column string")
        counted = none.join(counted, "column", "left").select("column", F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"))
        base = base.join(F.broadcast(counted), "column", "left")  # a row per listed column
    else:
        base = base.withColumn("distinct_values", F.lit(None).cast("bigint"))
    nulls = F.col("rows") - F.col("non_null")
    return base.select("column", "type", "position", "rows", "non_null", nulls.alias("nulls"),
                       F.when(F.col("rows") > 0, F.round(nulls / F.col("rows"), 6)).alias("null_share"),
                       "blank_strings", "distinct_values", "min_value", "max_value")


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values per column, long form."""
    aggs = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    return df.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in df.columns])))


def split_by_reason(df: DataFrame, rules, reason: str = "quarantine_reason") -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows set aside with the first matching reason)."""
    marked = df.withColumn(reason, first_reason(rules))
    return marked.where(F.col(reason).isNull()).drop(reason), marked.where(F.col(reason).isNotNull())


def extract_checks(df: DataFrame, id_col: str, date_col: str, flag_col: str, category_col: str, home) -> DataFrame:
    """One row: size, distinct ids, missing fields, foreign rows, date range."""
    per_id = df.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(date_col).isNull()).alias("_d"),
        F.count_if(~F.col(category_col).eqNullSafe(F.lit(home))).alias("_x"),
        F.count_if(F.col(flag_col).isNull()).alias("_f"), F.min(date_col).alias("_lo"), F.max(date_col).alias("_hi"))
    return per_id.agg(
        F.sum("_n").alias("rows"), F.count(id_col).alias("distinct_ids"),
        F.coalesce(F.sum(F.when(F.col(id_col).isNull(), F.col("_n"))), F.lit(0).cast("bigint")).alias("missing_id"),
        F.sum("_d").alias("missing_date"), F.sum("_x").alias("foreign_rows"), F.sum("_f").alias("missing_flag"),
        F.min("_lo").alias("first_date"), F.max("_hi").alias("last_date"))


def failed_extract_checks(checks: DataFrame, expected_rows: int | None = None) -> DataFrame:
    """Problems found by ``extract_checks``; empty means the extract may be used."""
    rules = [(F.col("rows") != F.col("distinct_ids"), "ids are not unique")]
    if expected_rows is not None:
        rules.append((F.col("rows") != F.lit(expected_rows), "row count differs from the manifest"))
    rules += [(F.col(c) > 0, c) for c in ("missing_id", "missing_date", "foreign_rows", "missing_flag")]
    return checks.select(F.explode(F.array_compact(F.array(
        *[F.when(cond, F.lit(label)) for cond, label in rules]))).alias("problem"))


def checked_records(df: DataFrame, id_col: str, text_col: str, title_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records with a ``title``, violations): ids trimmed, non-empty, unique; text not blank."""
    ident, text = F.col(id_col), F.col(text_col)
    titled = df.withColumn("title", F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in title_cols], F.lit("")))
    bad_id = ident.isNull() | blank_to_null(ident).isNull() | (ident != F.trim(ident))
    row_level = (df.select(ident.alias("id"), F.explode(F.array_compact(F.array(
        F.when(bad_id, F.lit("invalid_id")),
        F.when(text.isNull() | ~text.rlike(r"\S"), F.lit("empty_text"))))).alias("violation")))
    repeated = (df.where(ident.isNotNull()).groupBy(ident.alias("id")).count().where("count > 1")
                  .select("id", F.lit("duplicate_id").alias("violation")))
    return titled, row_level.unionByName(repeated)


def require_empty(violations: DataFrame, message: str) -> None:
    """Raise when a violation frame has a row (reads a handful of rows, never all)."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError(f"{message}: {[r.asDict() for r in found]}")
