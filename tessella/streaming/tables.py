"""Counts, histograms and unions over streams of events; an extension of the batch operators.

State is bounded: windowed aggregates drop windows once the watermark has passed them, counts by
value keep one row a value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format("parquet").schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).load(folder)


def windowed_counts(events: DataFrame, time: str, value: str, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, end, value, n) of each window; rows later than the watermark are left out."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return events.withWatermark(time, late).groupBy(w.alias("w"), F.col(value).alias("value")).agg(F.count("*").alias("n")).select("w.start", "w.end", "value", "n")


def running_counts(events: DataFrame, value: str) -> DataFrame:
    """(value, n) so far; for complete or update mode."""
    return events.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))


def running_histogram(events: DataFrame, value: str, low: float, width: float, bins: int) -> DataFrame:
    """(bin, n) so far with fixed bins; values outside go to the border bins."""
    b = F.greatest(F.lit(0), F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1))).cast("int")
    return events.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def first_occurrences(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Rows whose key has not been seen within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def union_streams(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def drain(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there now and return its result as a table."""
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
