"""Reproducible samples and allocations.

Order comes from salted SHA-256 of the id, so a sample does not depend on partitions or
reruns.  Bounded picks use ``orderBy().limit()`` (top-n per partition, then merged).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V


def salted_hash(salt: str, ident) -> Column:
    return F.sha2(F.concat(F.lit(f"{salt}:"), F.col(ident).cast("string") if isinstance(ident, str) else ident), 256)


def hash_sample(df: DataFrame, ident: str, salt: str, n: int) -> DataFrame:
    """First ``n`` distinct ids by salted hash, ties by id, with hash and rank.

    The rank is added to the ``n`` selected rows only.
    """
    chosen = (df.where(F.col(ident).isNotNull()).select(ident).distinct()
                .withColumn("sample_hash", salted_hash(salt, ident)).orderBy("sample_hash", ident).limit(n))
    return chosen.withColumn("sample_rank", F.row_number().over(Window.orderBy("sample_hash", ident)))


def sample_record(df: DataFrame, ident: str, sample: DataFrame) -> DataFrame:
    """Population size, selected ids and a digest of the selected ids."""
    population = df.agg(F.count_distinct(ident).alias("population"))
    digest = sample.agg(F.count(F.lit(1)).alias("selected"), F.sha2(F.array_join(F.array_sort(F.collect_list(
        F.col(ident).cast("string"))), "\n"), 256).alias("selected_ids_sha256"))
    return digest.select("*", population.scalar().alias("population"))


def pilot_sample(df: DataFrame, k: int, seed: int, ident: Column | None = None) -> DataFrame:
    """``k`` rows with the smallest random priority; samples of parts can be merged.

    ``ident`` (a column that tells rows apart) makes the pick repeatable; without one the
    priority is a seeded random number, so that copies of a row are drawn like any rows.
    """
    name = "pilot_priority"
    while name in df.columns:
        name += "_"
    priority = F.rand(seed) if ident is None else F.conv(F.substring(salted_hash(str(seed), ident), 1, 13), 16, 10).cast("double")
    return df.withColumn(name, priority).orderBy(name).limit(k)


def merge_pilots(a: DataFrame, b: DataFrame, k: int, priority: str = "pilot_priority") -> DataFrame:
    return a.unionByName(b).orderBy(priority).limit(k)


def storage_projection(blocks: DataFrame, rows: int) -> DataFrame:
    """Expected and planning bytes from pilot blocks (``bytes, block_rows``)."""
    filled = F.when(F.col("block_rows") > 0, F.col("bytes") / F.col("block_rows"))
    got = blocks.agg(F.sum("bytes").alias("_b"), F.sum("block_rows").alias("_r"), F.max(filled).alias("_worst"))
    mean = F.coalesce(F.when(F.col("_r") > 0, F.col("_b") / F.col("_r")), F.lit(0.0))
    exact = F.col("_r") == rows
    expected = F.when(exact, F.col("_b")).otherwise(F.lit(rows) * mean)
    upper = F.when(exact, F.col("_b") * V.STORAGE_MARGIN).otherwise(
        F.greatest(F.lit(rows) * mean, F.lit(rows) * F.coalesce("_worst", F.lit(0.0))) * V.STORAGE_MARGIN)
    return got.select(F.ceil(F.round(expected, 6)).alias("expected_bytes"), F.ceil(F.round(upper, 6)).alias("planning_bytes"),
                      F.coalesce("_b", F.lit(0)).alias("retained_pilot_bytes"))


def size_gate(status: str, unavailable: list[str], planning_bytes: float, reserve: float, budget: float) -> None:
    """Refuse an extract that is not estimated, not available or too large."""
    if status != "complete":
        raise ValueError("a completed estimate is required")
    if unavailable:
        raise ValueError(f"missing products {sorted(unavailable)}")
    if math.ceil(planning_bytes) + reserve > budget:
        raise ValueError("the estimate or its uncertainty exceeds the budget")


def uniform_order(df: DataFrame, ident, seed) -> DataFrame:
    """Adds ``order_key``; sorting by it is a random permutation, and every prefix a uniform sample."""
    return df.withColumn("order_key", salted_hash(str(seed), ident))


def accept_first_n(df: DataFrame, accepted: Column, reason: Column, n: int, ident: str, seed) -> tuple[DataFrame, DataFrame]:
    """(first ``n`` accepted rows in seeded order, audit of everything walked until then).

    The cut is the n-th accepted order key, found as a bounded top-n; rejections are counted
    by one filter up to the cut.  Without ``n`` acceptable rows everything has been walked
    and the audit says ``complete = false``.
    """
    walk = uniform_order(df, F.col(ident).cast("string"), seed).withColumn("accepted", accepted).withColumn("reason", reason)
    chosen = walk.where("accepted").orderBy("order_key", ident).limit(n)
    last = chosen.agg(F.max("order_key").alias("cut"), F.count(F.lit(1)).alias("got"))
    cut = last.select(F.when(F.col("got") == n, F.col("cut")).otherwise(F.lit("~")).alias("c")).scalar()
    audit = (walk.where(F.col("order_key") <= cut)
             .groupBy(F.when(F.col("accepted"), "accepted").otherwise(F.col("reason")).alias("outcome"))
             .agg(F.count(F.lit(1)).alias("candidates"))
             .withColumn("complete", last.select(F.col("got") == n).scalar()))
    return chosen.drop("accepted", "reason"), audit


def first_of_content(df: DataFrame, ident: str, content: str) -> DataFrame:
    """The smallest id of every repeated content, with all columns but the content; contents are told apart by SHA-256, so no text is moved."""
    rest = [c for c in df.columns if c != content]
    return df.groupBy(F.sha2(content, 256).alias("_digest")).agg(F.min_by(F.struct(*rest), ident).alias("_r")).select("_digest", "_r.*")


def with_content(picked: DataFrame, df: DataFrame, ident: str, content: str) -> DataFrame:
    """The content of some rows of ``first_of_content``, looked up by id and digest."""
    names = picked.select(F.col(ident).alias("_id"), F.col("_digest").alias("_of"))
    met = F.col(ident).eqNullSafe(F.col("_id")) & F.sha2(content, 256).eqNullSafe(F.col("_of"))
    found = df.select(ident, content).join(names, met).dropDuplicates(["_id", "_of"]).select("_id", "_of", content)
    same = F.col(ident).eqNullSafe(F.col("_id")) & F.col("_digest").eqNullSafe(F.col("_of"))
    return picked.join(found, same).select(content, *[c for c in picked.columns if c != "_digest"])


def distinct_content(df: DataFrame, ident: str, content: str) -> DataFrame:
    """Keep the smallest id of every repeated content."""
    return with_content(first_of_content(df, ident, content), df, ident, content)


def stratified_pick(df: DataFrame, ident: str, content: str, stratum: str, quota: dict[str, int], seed) -> tuple[DataFrame, DataFrame]:
    """(n rows per stratum in seeded order, report per stratum: pool size, picked, missing).

    ``quota`` names every wanted stratum and its size; repeated content counts once.  A
    stratum that cannot fill its quota is reported missing and picks nothing.
    """
    pool = first_of_content(df, ident, content).where(F.col(stratum).isin(*quota))
    sizes = pool.groupBy(stratum).agg(F.count(F.lit(1)).alias("pool"))
    wanted = df.sparkSession.createDataFrame(sorted(quota.items()), f"{stratum} string, wanted int")
    report = wanted.join(sizes, stratum, "left").select(
        stratum, "wanted", F.coalesce("pool", F.lit(0)).alias("pool"), (F.coalesce("pool", F.lit(0)) < F.col("wanted")).alias("missing"))
    w = Window.partitionBy(stratum).orderBy("order_key", ident)
    top = max(quota.values())
    best = (uniform_order(pool, F.col(ident).cast("string"), seed).withColumn("pick", F.row_number().over(w))
            .where(F.col("pick") <= top))  # partial top-n before the shuffle
    full = F.broadcast(report.where(~F.col("missing")).select(stratum, "wanted"))
    picked = best.join(full, stratum).where(F.col("pick") <= F.col("wanted")).drop("wanted")
    return with_content(picked, df, ident, content), report  # texts are looked up for the picks only


def overlap_groups(ids: DataFrame, ident: str, seed, shared: int, each: int, groups: int = 2) -> DataFrame:
    """Seeded split: a shared block in every group plus ``each`` exclusive ids per group.

    ``ids`` must hold exactly ``shared + groups*each`` distinct ids; anything else fails the job.  Places
    come from range partitions, so the order never passes through one task.
    """
    from .linkage import ordered_rank
    need = shared + groups * each
    found = ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(ident).alias("d")).select(
        (F.col("n") == need) & (F.col("d") == need)).scalar()
    keyed = ids.where(F.col(ident).isNotNull()).select(F.struct(salted_hash(str(seed), ident).alias("h"), F.col(ident).alias("id")).alias("_order"))
    ranked = ordered_rank(keyed, "_order").select(F.col("_order.id").alias(ident), (F.col("rank0") + 1).alias("sample_rank"))
    pos = F.col("sample_rank") - 1
    everywhere = F.array(*[F.lit(g) for g in range(groups)])
    group = F.when(pos < shared, everywhere).otherwise(F.array(F.floor((pos - shared) / each).cast("int")))
    checked = F.when(found, group).otherwise(F.raise_error(F.lit(f"expected exactly {need} distinct ids")))
    out = ranked.select(ident, "sample_rank", F.explode(checked).alias("group_no"), (pos < shared).alias("shared"))
    return out.withColumn("position", F.when(F.col("shared"), F.col("sample_rank"))
                          .otherwise(shared + (pos - shared) % each + 1))


def overlap_problems(groups: DataFrame, ident: str, shared: int, each: int, number: int = 2) -> DataFrame:
    """Violated sizes, overlap or union of an allocation."""
    per_id = groups.groupBy(ident).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("position").alias("p"),
                                       F.collect_set("group_no").alias("g"))
    got = per_id.agg(F.count(F.lit(1)).alias("union"), F.count_if(F.size("g") == number).alias("both"),
                     F.count_if(F.size("g") != F.col("n")).alias("repeat"),
                     F.count_if((F.size("g") == number) & (F.col("p") != 1)).alias("order"))
    rules = [(F.col("union") != shared + number * each, "union"), (F.col("both") != shared, "overlap"),
             (F.col("repeat") > 0, "repeated id"), (F.col("order") > 0, "shared ordering")]
    return got.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))).alias("problem"))


def bounded_preview(raw: DataFrame, side: DataFrame, keep: Column, key: str, n: int, order: list) -> DataFrame:
    """At most ``n`` rows: cut before the join so only those rows are looked up, and after it."""
    from .joins import guarded_key_join
    return guarded_key_join(raw.where(keep).orderBy(*order).limit(n), side, key).limit(n)


def windowed_candidates(df: DataFrame, date: str, category: str, groups: dict[str, list[str]], per_window: int, total: int,
                        ident: str) -> DataFrame:
    """Newest rows per (7-day window back from the latest date, category group), capped per window and in total.

    Windows walk 0, 7, 30 and 90 days back; the total cap follows that walking order.
    """
    day = F.to_date(date)
    latest = df.agg(F.max(day)).scalar()
    age = F.datediff(latest, day)
    slots = F.array_compact(F.array(*[
        F.when(age.between(off, off + V.WINDOW_DAYS - 1) & F.col(category).isin(*members),
               F.struct(F.lit(i * len(groups) + j).alias("slot"), F.lit(off).alias("days_back"), F.lit(name).alias("hint")))
        for i, off in enumerate(V.WINDOW_OFFSETS) for j, (name, members) in enumerate(groups.items())]))
    w = Window.partitionBy("slot").orderBy(F.col(date).desc(), ident)
    rows = (df.select("*", F.inline(slots)).withColumn("window_rank", F.row_number().over(w))
              .where(F.col("window_rank") <= per_window))
    return rows.orderBy("slot", "window_rank").limit(total)


def candidate_pool(candidates: DataFrame, ident: str, columns: list[str]):
    """Identical repeats collapse, an id with different contents is rejected."""
    from .quality import dedupe_quarantine
    return dedupe_quarantine(candidates, [ident], columns)
