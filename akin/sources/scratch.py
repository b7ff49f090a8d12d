"""Intermediate tables that cut lineage and survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting: shuffle files go when the query that made them has ended, not when the driver collects garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows go to Python in batches of so many bytes at most, or one row: long texts in one batch would add up.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20

_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="akin-")
    return _local_roots[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder of this application, which may go when the application has ended."""
    folder = f"{scratch_root(spark)}/akin/{spark.sparkContext.applicationId}"
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write the frame to a new scratch table and read it back.

    The shuffle files of the write are removed with its end: later steps read the table. Tables of long
    texts can ask for a `compression` that takes less disk than Spark's default.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = {name: spark.conf.get(name) for name in (CLEAN_UP, BATCH)}
    spark.conf.set(CLEAN_UP, "true")
    spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        df.write.parquet(path, compression=compression)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


#: Compression of tables of whole texts or words.
DENSE = "zstd"


def discard(*tables: DataFrame) -> None:
    """Remove scratch tables that nothing will read again, so that only live ones take up disk.

    Takes what `written` has returned; frames made from it must have been run by now.
    """
    for table in tables:
        path = table._scratch_path
        jvm, context = table.sparkSession._jvm, table.sparkSession._jsc
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context.hadoopConfiguration()).delete(at, True)
