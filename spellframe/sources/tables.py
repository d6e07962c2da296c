"""Reading and writing tables and small reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import validate_identifier


def read_table(spark: SparkSession, root: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """All Parquet parts below ``root/name``, nested folders included; none at all is an error."""
    validate_identifier(name)
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    try:
        df = reader.parquet(f"{root}/{name}")
    except AnalysisException as exc:
        raise FileNotFoundError(f"no Parquet parts for table {name} under {root}") from exc
    return df.select(*columns) if columns else df


def read_partition(spark: SparkSession, path: str, column: str, value) -> DataFrame:
    """One partition of a partitioned table by directory pruning; empty with schema when absent."""
    return spark.read.parquet(path).where(F.col(column) == F.lit(value))


def write_table(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "errorifexists") -> int:
    """zstd Parquet; returns the rows written, counted from the file footers."""
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path).count()


def _flat(df: DataFrame) -> DataFrame:
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", single: bool = True) -> None:
    """CSV with header; nested values as JSON.  ``single`` is for reports, which are small."""
    flat = _flat(df)
    (flat.coalesce(1) if single else flat).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def nest_record(df: DataFrame, columns: list[str], name: str = "posting") -> DataFrame:
    """Fold columns into one struct next to the untouched rest."""
    if name in df.columns:
        raise ValueError(f"the table already has a column {name!r}")
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.struct(*columns).alias(name))


def write_json_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, NULLs kept, ISO dates, nested values nested."""
    (df.write.mode(mode).option("ignoreNullFields", False).option("dateFormat", "yyyy-MM-dd")
       .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").json(path))


def extract_query(spark: SparkSession, sql: str, params: dict | None, out: str) -> DataFrame:
    """Run SQL with bound parameters, write Parquet, return a one-row manifest.

    The manifest is written only after the data, so an unfinished extract has none.
    """
    spark.sql(sql, args=params or {}).write.option("compression", "zstd").parquet(f"{out}/data")
    files = spark.read.parquet(f"{out}/data").groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n"))
    manifest = files.agg(F.lit("complete").alias("status"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                         F.count(F.lit(1)).alias("parts")).withColumn("sql", F.lit(sql))
    manifest.coalesce(1).write.json(f"{out}/manifest")
    return spark.read.schema(manifest.schema).json(f"{out}/manifest")


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, parts: int, **options) -> DataFrame:
    """Range-partitioned read of a remote table; the database filters each range."""
    return (spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=lower,
                                              upperBound=upper, numPartitions=parts, **options).load())
