"""Audited, validated and semi joins.

Sides are aggregated per key before they meet wherever only counts are asked for, so
neither a repeated key nor a hot key multiplies or concentrates rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import any_null
from .skew import find_sized, salted_join, semi_join


def _counted(df: DataFrame, on: list[str], label: str) -> DataFrame:
    """One row per key with its number of rows; a filter fails the job at a key that has several."""
    rest = [c for c in df.columns if c not in on]
    payload = F.struct(*rest) if rest else F.struct(F.lit(True).alias("_present"))
    grouped = (df.where(~any_null(on)).groupBy(*on)
                 .agg(F.count(F.lit(1)).alias("_n"), F.first(payload).alias("_row")))
    single = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{label}: key is not unique")).cast("boolean")).otherwise(True)
    return grouped.where(single).select(*on, *[F.col("_row")[c].alias(c) for c in rest], "_n")


def unique_or_fail(df: DataFrame, on: list[str], label: str = "join") -> DataFrame:
    """Same rows; a repeated key fails the job that reads it (no separate pass), whichever columns the job asks for.

    The check is a filter, so neither a count nor a selection of other columns drops it.
    """
    return _counted(df, on, label).drop("_n")


def _once(joined: DataFrame) -> DataFrame:
    """Rows of a join with a counted right side.

    The filter reads the right side's count and passes every row: without it a left join whose right columns are not
    asked for would be dropped from the plan, and its check with it.
    """
    return joined.where(F.coalesce(F.col("_n") >= 1, F.lit(True))).drop("_n")


def key_violations(df: DataFrame, on: list[str]) -> DataFrame:
    """Keys that would fail the checked joins, with their number of rows; rows without a key don't count."""
    return df.select(*on).where(~any_null(on)).groupBy(*on).agg(F.count(F.lit(1)).alias("key_rows")).where("key_rows > 1")


def checked_left_join(left: DataFrame, right: DataFrame, on: list[str], label: str = "join") -> DataFrame:
    """Left join that cannot change the number of left rows; a repeated right key fails every job on it, also a count."""
    return _once(salted_join(left, _counted(right, on, label), on, "left", hot=find_sized(left, on)))


def validated_merge(left: DataFrame, right: DataFrame, on: list[str], how: str = "left",
                    validate: str = "many_to_one", indicator: str | None = None) -> DataFrame:
    if validate not in ("many_to_one", "one_to_one"):
        raise ValueError(f"unknown validation {validate!r}")
    if how not in ("left", "inner"):
        raise ValueError(f"unsupported join {how!r}")
    right = _counted(right, on, "right side").withColumn("_r", F.lit(True))
    if validate == "one_to_one":
        nulls = left.where(any_null(on))
        left = unique_or_fail(left, on, "left side").unionByName(nulls)
    # keys of a one-to-one join are unique on both sides
    out = _once(salted_join(left, right, on, how, hot=None if validate == "one_to_one" else find_sized(left, on)))
    if indicator:
        out = out.withColumn(indicator, F.when(F.col("_r"), "both").otherwise("left_only"))
    return out.drop("_r")


def join_audit(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str] | None = None,
               right_key: list[str] | None = None) -> DataFrame:
    """One row describing what a join would do, without doing it."""
    right_on = right_on or left_on
    keys = [f"_k{i}" for i in range(len(left_on))]
    lcount = (left.select(*[F.col(c).alias(k) for c, k in zip(left_on, keys)])
                  .groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    rcount = (right.select(*[F.col(c).alias(k) for c, k in zip(right_on, keys)]).where(~any_null(keys))
                   .groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")))
    both = lcount.join(rcount, keys, "full_outer")
    n, m, null = F.col("_n"), F.col("_m"), any_null(keys)
    zero = F.lit(0).cast("bigint")
    total = lambda cond, v: F.coalesce(F.sum(F.when(cond, v)), zero)
    hit, miss = n.isNotNull() & m.isNotNull(), ~null & m.isNull()
    relation = "many-to-one" if right_key and sorted(right_key) == sorted(right_on) else "one-to-many"
    single = len(keys) == 1
    return both.agg(
        F.coalesce(F.sum(n), zero).alias("left_rows"), total(null, n).alias("left_null_key_rows"),
        total(hit, n).alias("matched_rows"), total(miss, n).alias("unmatched_rows"),
        (F.count_if(miss) if single else F.lit(None).cast("bigint")).alias("unmatched_distinct_keys"),
        total(hit, n * m).alias("naive_inner_join_rows"),
        F.coalesce(F.max(F.when(hit, m)), zero).alias("max_right_matches_per_key"),
        F.count_if(m > 1).alias("right_keys_with_duplicates"),
    ).select("*",
             F.when(F.col("left_rows") > F.col("left_null_key_rows"),
                    F.round(F.col("matched_rows") / (F.col("left_rows") - F.col("left_null_key_rows")), 6))
              .alias("match_share_of_keyed_rows"),
             (F.col("naive_inner_join_rows") - F.col("matched_rows")).alias("row_multiplication_if_naive"),
             F.lit(relation).alias("relationship"))


def semi_match(raw: DataFrame, structured: DataFrame, keys: list[str], nullable: list[str] = ()) -> DataFrame:
    """Raw rows that have a structured counterpart; copies of raw rows stay, none multiplies.

    Keys listed in ``nullable`` also pair NULL with NULL (rows without a person match on the
    remaining keys only when the other side has no person either).  A key with very many rows is
    dealt over salts by its size; the distinct keys of the other side are repeated for such keys only.
    """
    wanted = structured.select(*keys).distinct()
    found = salted_join(raw, wanted, keys, "left_semi", hot=find_sized(raw, keys, nullable=nullable), nullable=nullable)
    return found.select(*raw.columns)


def _without(df: DataFrame, known: DataFrame, keys: list[str], nullable: list[str], hot: DataFrame | None) -> DataFrame:
    return salted_join(df, known.select(*keys).distinct(), keys, "left_anti", hot=hot, nullable=nullable).select(*df.columns)


def unmatched(structured: DataFrame, raw: DataFrame, keys: list[str], nullable: list[str] = ()) -> DataFrame:
    """Structured rows without a raw counterpart; hot keys are dealt as in ``semi_match``, rows without a key over all tasks."""
    return _without(structured, raw, keys, list(nullable), find_sized(structured, keys, nullable=nullable))


def unmatched_count(structured: DataFrame, raw: DataFrame, keys: list[str], nullable: list[str] = ()) -> DataFrame:
    """Number of such rows, from per-key counts."""
    per_key = structured.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return _without(per_key, raw, keys, list(nullable), None).agg(
        F.coalesce(F.sum("_n"), F.lit(0).cast("bigint")).alias("unmatched_rows"))


def lookup_validated(ids: DataFrame, table: DataFrame, key: str, category: str, home) -> tuple[DataFrame, DataFrame]:
    """(rows of ``table`` for the ids, violations: duplicate, foreign or missing ids)."""
    wanted = ids.select(key).distinct()
    rows = semi_join(table, wanted, [key])
    seen = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"),
                                 F.count_if(~F.col(category).eqNullSafe(F.lit(home))).alias("_x"))
    problems = wanted.join(seen, key, "left").select(key, F.explode(F.array_compact(F.array(
        F.when(F.col("_n").isNull(), F.lit("missing")), F.when(F.col("_n") > 1, F.lit("duplicate")),
        F.when(F.col("_x") > 0, F.lit("foreign"))))).alias("violation"))
    return rows, problems


def guarded_key_join(raw: DataFrame, structured: DataFrame, key: str) -> DataFrame:
    """Left join of wide ids to BIGINT ids; ids outside 64 bit stay, unmatched."""
    side = structured.select(F.col(key).cast("bigint").alias("_key"),
                             *[c for c in structured.columns if c != key])
    narrow = raw.withColumn("_key", F.col(key).try_cast("bigint"))
    return salted_join(narrow, side, ["_key"], hot=find_sized(narrow, ["_key"])).drop("_key")  # rows without a 64-bit id are spread


def top_matches(left: DataFrame, right: DataFrame, on: list[str], order: list, n: int) -> DataFrame:
    """Up to ``n`` right rows per left row.

    The right side is cut per key first (partial top-n before the shuffle), so a key with
    very many right rows never reaches one task whole.
    """
    w = Window.partitionBy(*on).orderBy(*order)
    best = (right.where(~any_null(on)).withColumn("match_rank", F.row_number().over(w))
                 .where(F.col("match_rank") <= n))
    return salted_join(left, best, on, "inner", hot=find_sized(left, on))


def membership_flag(df: DataFrame, ids: DataFrame, key: str, flag: str, measure: DataFrame | None = None) -> DataFrame:
    """True where ``key`` is among ``ids``; ``measure`` is a cheaper frame with the same keys to look for hot ones."""
    hot = find_sized(df if measure is None else measure, [key])
    known = ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
    return salted_join(df, known, [key], "left", hot=hot).withColumn(flag, F.coalesce(flag, F.lit(False)))


def spread(df: DataFrame, **dimensions) -> DataFrame:
    """Repeat each row for every combination of small literal dimensions (a narrow explode)."""
    for name, values in dimensions.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def attach_at(events: DataFrame, panel: DataFrame, by: list[str], at: str, time: str, columns: list[str],
              prefix: str) -> DataFrame:
    """Panel columns of the same entity at the event's ``at`` time, prefixed; NULL when absent."""
    side = panel.select(*by, F.col(time).alias(at), *[F.col(c).alias(prefix + c) for c in columns])
    return events.join(side, [*by, at], "left")


def same_bag(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose number of copies differs between the frames; empty = equal as bags."""
    cols = a.columns
    signed = (a.select(*cols, F.lit(1).alias("_d")).unionAll(b.select(*cols, F.lit(-1).alias("_d")))
               .groupBy(*cols).agg(F.sum("_d").alias("surplus")))
    return signed.where("surplus <> 0")
