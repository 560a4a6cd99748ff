"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Send fewer rows to Python at a time than the default of 10,000, unless the session says otherwise: texts are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder URI below spark.checkpoint.dir, the folder that driver and executors share.

    Where the setting is absent (tests, local mode) a folder of this machine becomes the setting.
    """
    small_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tessella-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: lineage ends, lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written = (path, None)
    return out


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Write `df` bucketed by a key: aggregates and joins on the key then read it without a shuffle.

    Every task writes the one bucket that the shuffle before gave it, so there are as many files as buckets.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(buckets, key).write.format("parquet").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    out = spark.table(table)
    out._written = (path, table)
    return out


def discard(*frames: DataFrame | None) -> None:
    """Remove what written() or bucketed() wrote; only for results that nothing reads any more."""
    for df in frames:
        path, table = getattr(df, "_written", (None, None)) if df is not None else (None, None)
        if path is None:
            continue
        spark = df.sparkSession
        if table is not None:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def task_count(spark: SparkSession, factor: float = 1.0) -> int:
    return max(1, int(int(spark.conf.get("spark.sql.shuffle.partitions")) * factor))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or with underscores after it until no column has it."""
    while name in df.columns:
        name += "_"
    return name


def release() -> None:
    """Give memory that Arrow and the C library keep for later back to the system: workers go on to other operators."""
    import ctypes
    import ctypes.util

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(ctypes.util.find_library("c") or None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_schema(spark: SparkSession, ddl: str):
    """The Arrow schema of a DDL string; made on the driver, as executors' Python has no session."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def arrow_batch(rows: list[tuple], kinds):
    """A record batch from tuples in the order of the schema."""
    import pyarrow as pa

    cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(cols, kinds, strict=True)], schema=kinds)
