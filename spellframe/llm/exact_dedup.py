"""Exact deduplication by a tree merge of digest runs.

Every document belongs to one leaf run, chosen by a hash of its id.  A run holds one entry
per distinct content: the row that stays so far and the number of rows behind it.  In each
round the ``FAN`` runs that share a parent exchange their entries by (parent, digest), are merged
there by digest, and keep the best entry; so a content that fills a third of the corpus never has
more than ``FAN`` entries at one merge.  The outcome goes back down the same tree, again with
at most ``FAN`` children for an entry, until each document knows the row that stays for it.

An entry is keyed by SHA-256, byte length and a second 64-bit hash of the normalised text:
contents that differ in any of them are never taken for equal.

Cases: null text is empty text; empty texts are equal to each other; among equal texts of equal
length the smallest id stays, a null id last; whole rows that repeat all get a result and the first of them is
``kept``; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

FAN = 16
LEAF_ROWS = 4_096
CONTENT = ["digest", "n_bytes", "check"]


def normalised(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def rounds_for(rows: int) -> int:
    """Merging rounds, so that a leaf run has about LEAF_ROWS rows at any size."""
    return max(1, math.ceil(math.log(max(1, rows / LEAF_ROWS), FAN)))


def merge(entries: DataFrame) -> DataFrame:
    """One round: children of a parent meet by content; the longest original text, then smallest id stays."""
    return (entries.withColumn("run", F.floor(F.col("run") / FAN)).groupBy("run", *CONTENT)
                   .agg(F.min("best").alias("best"), F.sum("rows").alias("rows")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, text_hash (of the text as it is)."""
    if rounds is None:
        rounds = rounds_for(docs.count())
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.length(text).alias("n_chars"), normalised(F.col(text_col)).alias("plain"))
    leaves = stage(plain.select(
        "id", "h", "n_chars", F.unhex(F.sha2("plain", 256)).alias("digest"), F.octet_length("plain").cast("long").alias("n_bytes"),
        F.xxhash64("plain").alias("check"), F.pmod(F.xxhash64("id", F.lit(7)), F.lit(FAN ** rounds)).alias("run")), "leaves")
    rank = F.struct((-F.col("n_chars")).alias("shorter"), F.col("id").isNull().alias("unnamed"), F.col("id").alias("id"))
    levels = [leaves.groupBy("run", *CONTENT).agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("rows"))]
    for _ in range(rounds):
        levels.append(merge(levels[-1]))
    known = levels[-1]
    for below in reversed(levels[:-1]):
        parent = known.withColumnRenamed("run", "parent")
        known = (below.drop("best", "rows").withColumn("parent", F.floor(F.col("run") / FAN))
                      .join(parent, ["parent", *CONTENT]).drop("parent"))
    again = Window.partitionBy("run", *CONTENT, "id", "n_chars").orderBy("h")
    same = leaves.withColumn("nth", F.row_number().over(again))
    return same.join(known, ["run", *CONTENT]).select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("rows").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("n_chars") == -F.col("best.shorter")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), F.col("h").alias("text_hash"))


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without all but one of equal texts; columns as given."""
    # Rows of one id and one text are told apart by nothing: all go, or one of them stays.
    found = stage(exact_duplicates(docs, id_col, text_col).groupBy(F.col(id_col).alias("_gone"), F.col("text_hash").alias("_h"))
                  .agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")), "copies")
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    same = F.col(id_col).eqNullSafe(F.col("_gone")) & (text_hash == F.col("_h"))
    left = docs.join(found.where("NOT stays").select("_gone", "_h"), same, "left_anti")
    repeated = found.where("stays AND n > 1").select("_gone", "_h")
    if repeated.isEmpty():
        return left
    once, twice = left.join(repeated, same, "left_anti"), left.join(repeated, same, "left_semi")
    return once.unionByName(twice.withColumn("_h", text_hash).dropDuplicates([id_col, "_h"]).drop("_h"))
