"""Streams with state: joins of two streams within a time and sessions closed by timers.

The join keeps rows of both sides only while a partner may still come: watermarks on both sides and a bound on the difference
of their times let Spark free what is older. Sessions are an arbitrary state of the open sessions of a bucket of keys: rows that come within
the gap of a key's session extend it, and an event-time timer closes sessions when the watermark has passed their end and the gap. Rows behind the
watermark are dropped.

Defined cases: rows without a key or a time belong to no session and join nothing; rows at the same time are one after
another; sessions that no later row closes come out when the stream's clock moves on (see drained).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.sources.scratch import shared_folder

OUT = "key string, start long, end long, n long, total double"
STATE = "keys array<string>, starts binary, ends binary, n binary, totals binary"
#: Keys share this many states, as a state for each key costs a call of its own a batch.
BUCKETS = 1024


def joined(left: DataFrame, right: DataFrame, key: tuple[str, str], times: tuple[str, str], within: str, late: str) -> DataFrame:
    """Pairs of equal key where the right row comes no earlier than the left one and no later than `within` after it."""
    a, b = left.withWatermark(times[0], late), right.withWatermark(times[1], late)
    return a.join(b, (F.col(key[0]) == F.col(key[1])) & (F.col(times[1]) >= F.col(times[0])) & (F.col(times[1]) <= F.col(times[0]) + F.expr(f"INTERVAL {within}")))


def sessions(events: DataFrame, key: str, time: str, value: str, gap_seconds: float, late: str) -> DataFrame:
    """(key, start, end, n, total) of runs of rows that follow each other within the gap."""
    rows = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("time"), F.unix_micros(F.col(time).cast("timestamp")).alias("us"), F.col(value).cast("double").alias("value"))

    gap = int(gap_seconds * 1_000_000)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [f[["key", "us", "value"]] for f in frames]
        new = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"key": [], "us": [], "value": []})
        us = new["us"].to_numpy(np.int64)
        held = _held(state.get if state.exists else None)
        value = new["value"].to_numpy(float)
        key, start, end, n, total = (np.concatenate(c) for c in zip(held, (new["key"].to_numpy(object), us, us, np.ones(len(us), np.int64), np.where(np.isnan(value), 0.0, value)), strict=True))
        who = pd.factorize(key)[0]
        turn = np.lexsort((end, start, who))
        who, key, start, end, n, total = (c[turn] for c in (who, key, start, end, n, total))
        # sessions of a key come in the order of their starts; the end of all before a row says whether it goes on
        if len(who):
            first = np.flatnonzero(_begins(who, start, end, gap))
            key, start, end, n, total = key[first], start[first], np.maximum.reduceat(end, first), np.add.reduceat(n, first), np.add.reduceat(total, first)
        mark = state.getCurrentWatermarkMs()
        # rows behind the watermark of the batch before are dropped, so none comes for a session that was closed then
        done = end + gap < mark * 1000
        left = ~done
        if left.any():
            state.update((key[left].tolist(), *(c[left].tobytes() for c in (start, end, n, total))))
            state.setTimeoutTimestamp(max((int(end[left].min()) + gap) // 1000 + 1, mark + 1))
        elif state.exists:
            state.remove()
        if done.any():
            yield pd.DataFrame({"key": key[done], "start": start[done], "end": end[done], "n": n[done], "total": total[done]})

    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")
    dealt = rows.withColumn("bucket", bucket).withWatermark("time", late).groupBy("bucket")
    return dealt.applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout).withColumns({c: F.timestamp_micros(c) for c in ("start", "end")})


def _held(state: tuple | None) -> tuple[np.ndarray, ...]:
    """(key, start, end, n, total) of the open sessions of a bucket."""
    keys, *cols = state or ([], b"", b"", b"", b"")
    names = np.empty(len(keys), object)
    names[:] = keys
    return names, *(np.frombuffer(bytes(c), t) for c, t in zip(cols, (np.int64, np.int64, np.int64, float), strict=True))


def _begins(who: np.ndarray, start: np.ndarray, end: np.ndarray, gap: int) -> np.ndarray:
    """Whether a row, in the order of key and start, comes later than the gap after all rows of its key before it."""
    new = np.ones(len(who), bool)
    new[1:] = who[1:] != who[:-1]
    # ends as whole numbers that no earlier key's exceed: the greatest end so far inside a key
    low = int(end.min())
    span = int(end.max()) - low + 1
    if span * (int(who.max()) + 1) < 1 << 62:
        upto = np.maximum.accumulate((end - low) + who * span) - who * span + low
    else:
        upto = pd.Series(end).groupby(who).cummax().to_numpy()
    out = new.copy()
    out[1:] |= start[1:] - upto[:-1] > gap
    return out


def written_stream(spark: SparkSession, df: DataFrame, order: str, files: int, clock: dict) -> tuple[DataFrame, int]:
    """(stream, files): a table as files in the order of a time, a file a trigger, and at last a row that moves the clock on.

    Files are ranges of the order, written one folder each below a new shared folder; `clock` has the last row's values.
    """
    folder = shared_folder(spark, "stream")
    bounds = df.select(F.percentile_approx(order, [(k + 1) / files for k in range(files - 1)], 10_000).alias("b")).first().b or []
    part = F.lit(0)
    for b in bounds:
        part = part + F.when(F.col(order) > F.lit(b), 1).otherwise(0)
    cut = df.withColumn("_part", F.coalesce(part, F.lit(0)).cast("int"))
    for k in range(len(bounds) + 1):
        cut.where(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(f"{folder}/rows")
    last = df.limit(0).unionByName(spark.createDataFrame([clock], T.StructType([df.schema[c] for c in clock])), allowMissingColumns=True)
    last.coalesce(1).write.mode("append").parquet(f"{folder}/rows")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/rows"), len(bounds) + 2


def drained(stream: DataFrame, progress: list | None = None) -> DataFrame:
    """Run a stream over all that is there and return what it put out; `progress` gets the reports of its batches."""
    spark = stream.sparkSession
    folder = shared_folder(spark, "drained")
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
