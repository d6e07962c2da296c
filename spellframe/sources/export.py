"""Guarded export to tools with double-precision integers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXACT = 2 ** 53


def export_problems(df: DataFrame, max_rows: int, status: str = "complete") -> DataFrame:
    """Why the frame must not be exported: unfinished, too many rows, integers beyond 2^53."""
    if max_rows < 1:
        raise ValueError("max_rows must be positive")
    whole = [f.name for f in df.schema if isinstance(f.dataType, (T.LongType, T.DecimalType)) and getattr(f.dataType, "scale", 0) == 0]
    got = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.max(F.abs(F.col(c).cast("decimal(38,0)"))).alias(c) for c in whole])
    rules = [(F.col("_rows") > max_rows, F.lit("more rows than max_rows"))]
    if status != "complete":
        rules.append((F.lit(True), F.lit("extract is not complete")))
    rules += [(F.col(c) > F.lit(EXACT), F.lit(f"{c}: integers beyond exact precision, keep as text")) for c in whole]
    return got.select(F.explode(F.array_compact(F.array(*[F.when(c, t) for c, t in rules]))).alias("problem"))


def stata_safe(df: DataFrame, max_rows: int, status: str = "complete") -> DataFrame:
    """Types a double-based tool reads exactly; refuses what it cannot hold.

    Booleans and integers with missing values widen to double, text NULLs become empty.
    """
    from ..operators.quality import require_empty
    require_empty(export_problems(df, max_rows, status), "cannot export")
    nullable = [f.name for f in df.schema if isinstance(f.dataType, (T.IntegralType, T.BooleanType))]
    missing = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in nullable]).first().asDict() if nullable else {}
    def fit(f):
        c = F.col(f.name)
        if isinstance(f.dataType, T.BooleanType):
            return c.cast("int").cast("double" if missing[f.name] else "tinyint")
        if isinstance(f.dataType, T.IntegralType):
            return c.cast("double" if missing[f.name] else "bigint")
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("double")
        if isinstance(f.dataType, T.StringType):
            return F.coalesce(c, F.lit(""))
        return c
    return df.select(*[fit(f).alias(f.name) for f in df.schema])
