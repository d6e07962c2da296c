"""File listings, content hashes, reconciliation with a manifest, row addresses."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_manifest(spark: SparkSession, root: str, content_hash: bool = False) -> DataFrame:
    """path, size and modification time of every file below ``root``; optionally SHA-256.

    Without the hash only the listing is read, never file contents.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    columns = ["path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    return files.select(*columns, *([F.sha2("content", 256).alias("sha256")] if content_hash else []))


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files added, removed or changed in any recorded attribute."""
    attrs = [c for c in before.columns if c != "path"]
    a = before.select("path", F.struct(*attrs).alias("_a"), F.lit(True).alias("_in_a"))
    b = after.select("path", F.struct(*attrs).alias("_b"), F.lit(True).alias("_in_b"))
    j = a.join(b, "path", "full_outer")
    status = (F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed")
               .when(~F.col("_a").eqNullSafe(F.col("_b")), "changed"))
    return j.select("path", status.alias("status")).where(F.col("status").isNotNull())


def digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One order-independent digest of a listing: the SHA-256 values of its lines, summed in four parts of 64 bits."""
    line = F.sha2(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]), 256)
    parts = [F.conv(F.substring(line, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = [F.coalesce(F.sum(p), F.lit(0).cast("decimal(30,0)")).cast("string") for p in parts]
    return df.agg(F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *sums), 256).alias("sha256"))


def measure_tables(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """(table, rows, parts, bytes) on disk; row counts come from the Parquet footers."""
    from .tables import read_table
    files = file_manifest(spark, root).where(F.col("path").endswith(".parquet"))
    # Paths are listed with another number of slashes behind the scheme than they are given with: the folder's own name decides.
    table = F.regexp_extract(F.col("path"), f"/{re.escape(root.rstrip('/').rsplit('/', 1)[-1])}/([^/]+)/", 1)
    sizes = files.groupBy(table.alias("table")).agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("bytes"))
    counts = [read_table(spark, root, n).agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(n)) for n in names]
    return reduce(DataFrame.unionByName, counts).join(sizes, "table", "left").select("table", "rows", "parts", "bytes")


def reconcile(manifest: DataFrame, measured: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """Manifest (table, status, rows, expected_rows, parts, bytes) against measured counts, with problems."""
    m = manifest.select("table", F.col("status"), F.col("rows").alias("manifest_rows"), "expected_rows",
                        F.col("parts").alias("manifest_parts"), F.col("bytes").alias("manifest_bytes"), F.lit(True).alias("_m"))
    d = measured.select("table", "rows", "parts", "bytes", F.lit(True).alias("_d"))
    j = m.join(d, "table", "full_outer")
    if schemas is not None:
        j = j.join(schemas.select("table", "distinct_file_schemas"), "table", "left")
    else:
        j = j.withColumn("distinct_file_schemas", F.lit(None).cast("bigint"))
    rows_ok = (F.col("manifest_rows").eqNullSafe(F.col("rows"))
               & F.coalesce("expected_rows", "rows").eqNullSafe(F.col("rows")))
    both = F.col("_m").isNotNull() & F.col("_d").isNotNull()
    rules = [(F.col("_d").isNull() & (F.col("manifest_rows") > 0), "manifest rows but no parts"),
             (both & ~rows_ok, "row count differs"), (F.col("_m").isNotNull() & ~F.col("status").eqNullSafe("complete") & F.col("_d").isNotNull(),
                                                      "table is not complete"),
             (F.col("_m").isNull(), "on disk but not in the manifest"), (F.col("distinct_file_schemas") != 1, "parts differ in schema")]
    return j.select("table", "status", "manifest_rows", "expected_rows", "rows", "manifest_parts", "parts", "manifest_bytes", "bytes",
                    F.when(both, rows_ok).alias("rows_reconcile"), F.when(both, F.col("manifest_parts").eqNullSafe(F.col("parts"))).alias("parts_reconcile"),
                    F.when(both, F.col("manifest_bytes").eqNullSafe(F.col("bytes"))).alias("bytes_reconcile"),
                    F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules])).alias("problems"))


def schema_signatures(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(signature, files) of a table's parts: one signature means one common schema.

    Footers are read by the tasks, a batch of paths at a time.
    """
    paths = file_manifest(spark, f"{root}/{name}").select("path").where(F.col("path").endswith(".parquet"))

    def read(batches):
        import pandas as pd
        from pyarrow import fs
        import pyarrow.parquet as pq
        for batch in batches:
            out = []
            for uri in batch["path"]:
                where, path = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1))
                schema = pq.read_schema(path, filesystem=where)
                out.append(",".join(sorted(f"{f.name}:{f.type}" for f in schema)))
            yield pd.DataFrame({"signature": out})

    return paths.mapInPandas(read, "signature string").groupBy("signature").agg(F.count(F.lit(1)).alias("files"))


def parquet_row_positions(df: DataFrame) -> DataFrame:
    """Adds (part, row, ordinal): place of every row in its file and in the whole table.

    Parts are ordered by path; their offsets are running totals over ranges of paths, so neither rows nor a long
    list of files meet in one task.  ``df`` must be a Parquet scan.
    """
    from ..operators.ranges import total_before
    tagged = df.select("*", F.col("_metadata.file_path").alias("part"), F.col("_metadata.row_index").alias("row"))
    sizes = df.select(F.col("_metadata.file_path").alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = total_before(sizes, "part", "_n", "_offset").select("part", "_offset")
    return tagged.join(offsets, "part").withColumn("ordinal", F.col("_offset") + F.col("row")).drop("_offset")


def rows_at(df: DataFrame, ordinals: DataFrame) -> DataFrame:
    """Rows of a Parquet scan at the given ordinals, in an ``ordinal`` column."""
    return parquet_row_positions(df).join(ordinals.select("ordinal").distinct(), "ordinal", "left_semi")
