"""User functions, parallel maps, background calls, caching and guards."""

from __future__ import annotations

import functools
import hashlib
import inspect
import threading
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import Future
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parallel_map(spark: SparkSession, function: Callable[[Any], Any], items: Iterable, result: str = "string", chunks: int | None = None) -> DataFrame:
    """(place, result) of a function over a driver-side list, dealt over tasks; order by `place` restores it. An error ends the job."""
    import pickle

    items = list(items)
    rows = spark.createDataFrame([(i, bytearray(pickle.dumps(x))) for i, x in enumerate(items)], "place bigint, item binary").repartition(chunks or max(1, spark.sparkContext.defaultParallelism), "place")
    schema = T.StructType([T.StructField("place", T.LongType()), T.StructField("result", T._parse_datatype_string(result))])
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(schema["result"].dataType)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("place"), pa.array([function(pickle.loads(x)) for x in b.column("item").to_pylist()], kind)], names=["place", "result"])

    return rows.mapInArrow(run, schema)


def split_rows(df: DataFrame, count: int, key: str) -> DataFrame:
    """Add `part`: rows dealt in turn to `count` parts, in the order of the key."""
    from tessella.operators.frame import numbered

    return numbered(df, [key], "_place").withColumn("part", (F.col("_place") % count).cast("int")).drop("_place")


def map_column(df: DataFrame, column: str, function: Callable[[Any], Any], name: str, result: str = "string") -> DataFrame:
    """Add a column computed by any Python function of another one, in Arrow batches."""
    kind = T._parse_datatype_string(result)
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def run(batches):
        for b in batches:
            yield b.append_column(name, pa.array([function(x) for x in b.column(column).to_pylist()], arrow))

    return df.mapInArrow(run, schema)


def sort_by(df: DataFrame, column: str, key: Callable[[Any], Any], result: str = "double") -> DataFrame:
    """Rows in the order of a Python key function of a column."""
    return map_column(df, column, key, "_key", result).orderBy("_key").drop("_key")


def register(spark: SparkSession, name: str, function: Callable, result: str) -> None:
    """A Python function for SQL texts."""
    spark.udf.register(name, function, result)


def register_unstack(spark: SparkSession, name: str = "unstack_list") -> None:
    """A table function for SQL that turns a list into rows (place, value)."""
    from pyspark.sql.functions import udtf

    class Rows:
        def eval(self, values: list):
            for i, v in enumerate(values or []):
                yield i, None if v is None else str(v)

    spark.udtf.register(name, udtf(Rows, returnType="place int, value string"))


def background(function: Callable) -> Callable[..., Future]:
    """Run calls in a thread of their own (its jobs in a group of their own); the future's result() waits."""
    @functools.wraps(function)
    def call(*args, **kw):
        out: Future = Future()

        def run():
            try:
                out.set_result(function(*args, **kw))
            except BaseException as e:  # noqa: BLE001
                out.set_exception(e)

        threading.Thread(target=run, daemon=True).start()
        return out

    return call


def cancel(spark: SparkSession, group: str) -> None:
    spark.sparkContext.cancelJobGroup(group)


def with_timeout(spark: SparkSession, seconds: float, action: Callable[[], Any], default: Any = None) -> Any:
    """The action's result, or the default once its jobs have been cancelled for taking too long."""
    group = f"timeout-{threading.get_ident()}"
    spark.sparkContext.setJobGroup(group, "timeout", True)
    timer = threading.Timer(seconds, lambda: cancel(spark, group))
    timer.start()
    try:
        return action()
    except Exception:
        if timer.is_alive():
            raise
        return default
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def cached(spark: SparkSession, folder: str, query: Callable[..., DataFrame], *args, **kw) -> DataFrame:
    """The query's result from a Parquet folder named by the function and its arguments; made on the first call."""
    key = hashlib.sha256(repr((query.__module__, query.__qualname__, args, sorted(kw.items()))).encode()).hexdigest()[:24]
    path = f"{folder.rstrip('/')}/{key}"
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    query(*args, **kw).write.parquet(path)
    return spark.read.parquet(path)


def result_hash(df: DataFrame) -> str:
    """A digest of a result that does not depend on row order: for comparing runs with a stored one."""
    one = df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("s"), F.bit_xor(F.col("h").cast("bigint")).alias("x")).first()
    return hashlib.sha256(repr((df.columns, one.n, str(one.s), one.x)).encode()).hexdigest()


def checked(*kinds: type | Sequence[type]) -> Callable:
    """Refuse calls whose arguments are not of the given kinds."""
    def wrap(function):
        @functools.wraps(function)
        def call(*args, **kw):
            bound = inspect.signature(function).bind(*args, **kw)
            for (name, value), kind in zip(bound.arguments.items(), kinds, strict=False):
                if not isinstance(value, kind if isinstance(kind, type) else tuple(kind)):
                    raise TypeError(f"{name} has to be {kind}, not {type(value)}")
            return function(*args, **kw)
        return call
    return wrap
