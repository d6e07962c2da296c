"""Helpers shared by the text operators: words as columns, row keys, staging."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage  # noqa: F401  (re-exported for the operators)

#: Fixed value: everything between words, after A-Z are lower-cased.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lowered(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """The words of a text in order."""
    return F.array_remove(F.split(lowered(text), BETWEEN_WORDS), "")


def following(array: Column, length: int) -> Column:
    """Array of structs w0, w1, ...: each element with the ones after it, null beyond the end."""
    shifted = [array] + [F.slice(array, i + 1, F.greatest(F.size(array), F.lit(1))) for i in range(1, length)]
    zipped = F.arrays_zip(*[s.alias(f"w{i}") for i, s in enumerate(shifted)])
    return zipped.cast("array<struct<" + ",".join(f"w{i}:string" for i in range(length)) + ">>")


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart that share an id but not a text; repeated rows share a key."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))


def repeated(df: DataFrame, copies: str) -> DataFrame:
    """Each row as often as ``copies`` says, without the column; in two steps, so that no list grows with more than a part of the number."""
    step = 100_000
    parts = df.withColumn("_first", F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies), F.lit(step).cast("long"))))
    nth = F.sequence(F.col("_first"), F.least(F.col(copies), F.col("_first") + step - 1))
    return parts.withColumn("_nth", F.explode(nth)).drop(copies, "_first", "_nth")


def row_counts(df: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Rows and bytes of text, to size partitions by."""
    got = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_col))).first()
    return got[0], got[1] or 0
