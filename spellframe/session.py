"""Session settings the jobs are written for, and staged tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A frame already partitioned by person also serves joins on (person, quarter, ...).
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.parquet.compression.codec": "zstd",
    # A job compiles several hundred expression classes; the default of 100 evicts them between stages.
    "spark.sql.codegen.cache.maxEntries": "2000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int = 8, app: str = "spellframe") -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(cores))
               .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false"))
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows that one task of a keyed step sorts, and bytes of input for each task of a job that writes tables.
TASK_ROWS = 100_000
TASK_BYTES = 4 << 20


def tasks_for(rows: int) -> int:
    """Number of tasks that a keyed step over so many rows is dealt over: memory of a task does not grow with the table."""
    return max(1, -(-rows // TASK_ROWS))


@contextmanager
def fine_tasks(spark: SparkSession, input_bytes: int) -> Iterator[None]:
    """Jobs run inside are cut finely enough for the size of their input, so that no sort or aggregate spills; settings are put back."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = str(max(least, -(-input_bytes // TASK_BYTES)))
    part = f"{2 * TASK_BYTES}b"
    settings = {"spark.sql.shuffle.partitions": wanted, "spark.sql.adaptive.coalescePartitions.initialPartitionNum": wanted,
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": part, "spark.sql.files.maxPartitionBytes": part}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def small_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs run inside hand Arrow batches of about so many bytes to Python, whatever the length of a row; the setting is put back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


_scratch: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for staged tables: the one the cluster names, a scratch one only in local tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _scratch.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spellframe-"))


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a frame that several later steps read, and read it back.

    Cuts the lineage reliably (a lost executor re-reads files instead of recomputing the
    job) and gives later steps column pruning and file statistics.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
