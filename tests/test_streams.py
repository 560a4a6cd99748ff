"""Streams with state, sketches and polynomials through chosen rows."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import fekete, sketch
from tessella.streaming import sessions

START = dt.datetime(2024, 1, 1)
KIND = "user long, ts timestamp, value double"


def files(spark, tmp_path, batches):
    """A stream of files, one a trigger."""
    for b in batches:
        spark.createDataFrame([(u, START + dt.timedelta(minutes=m), float(m)) for u, m in b], KIND).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")


def minutes(t):
    return int((t - START).total_seconds() // 60)


def test_sessions_close_and_late_rows_are_dropped(spark, tmp_path):
    batches = [[(1, 0), (1, 20), (2, 5), (None, 7)], [(1, 45), (2, 200)], [(2, 10), (1, 210), (1, 150)], [(3, 10_000)]]
    stream = files(spark, tmp_path, batches)
    reports = []
    got = {(r.key, minutes(r.start), minutes(r.end), r.n, r.total) for r in sessions.drained(sessions.sessions(stream, "user", "ts", "value", 30 * 60, "1 minute"), reports).collect()}
    # rows behind the watermark of the batch before are dropped: user 2's at 10, which came after 20; user 1's at 150 closes at once
    assert got == {("1", 0, 45, 3, 65.0), ("2", 5, 5, 1, 5.0), ("2", 200, 200, 1, 200.0), ("1", 150, 150, 1, 150.0), ("1", 210, 210, 1, 210.0)}
    assert sum(o.numRowsDroppedByWatermark for r in reports for o in r.stateOperators) == 1
    assert reports[-1].stateOperators[0].numRowsTotal == 1  # the session of the last row; all others are freed


def test_out_of_order_rows_join_sessions(spark, tmp_path):
    stream = files(spark, tmp_path, [[(1, 0), (1, 50)], [(1, 25)], [(9, 10_000)]])
    got = {(r.key, minutes(r.start), minutes(r.end), r.n) for r in sessions.drained(sessions.sessions(stream, "user", "ts", "value", 30 * 60, "2 hours")).collect()}
    assert got == {("1", 0, 50, 3)}


def test_sessions_of_many_keys_share_states(spark, tmp_path):
    """A state holds the sessions of a bucket of keys; what comes out is as if each key had its own."""
    rng = np.random.default_rng(7)
    batches = [[(int(u), int(m)) for u, m in zip(rng.integers(0, 3000, 4000), rng.integers(300 * k, 300 * k + 300, 4000), strict=True)] for k in range(3)]
    stream = files(spark, tmp_path, [*batches, [(9_999, 100_000)]])
    reports = []
    got = sorted((int(r.key), minutes(r.start), minutes(r.end), r.n, r.total) for r in sessions.drained(sessions.sessions(stream, "user", "ts", "value", 30 * 60, "10 hours"), reports).collect())
    want, by = [], {}
    for u, m in sum(batches, []):
        by.setdefault(u, []).append(m)
    for u, all_ in by.items():
        runs = []
        for m in sorted(all_):
            if runs and m - runs[-1][-1] <= 30:
                runs[-1].append(m)
            else:
                runs.append([m])
        want += [(u, r[0], r[-1], len(r), float(sum(r))) for r in runs]
    assert got == sorted(want)
    assert 0 < max(r.stateOperators[0].numRowsTotal for r in reports) <= sessions.BUCKETS < len(by)


def test_join_frees_its_state(spark, tmp_path):
    e = files(spark, tmp_path, [[(1, 0), (2, 3), (1, 9)], [(1, 15), (2, 40)], [(1, 9_000)], [(1, 9_001)]])
    a = e.select(F.col("user").alias("a"), F.col("ts").alias("ta"))
    b = e.select(F.col("user").alias("b"), F.col("ts").alias("tb"))
    reports = []
    got = sorted((r.a, minutes(r.ta), minutes(r.tb)) for r in sessions.drained(sessions.joined(a, b, ("a", "b"), ("ta", "tb"), "10 MINUTES", "1 minute"), reports).collect())
    times = {1: [0, 9, 15, 9000, 9001], 2: [3, 40]}
    assert got == sorted((u, s, t) for u, all_ in times.items() for s in all_ for t in all_ if 0 <= t - s <= 10)
    assert reports[-1].stateOperators[0].numRowsTotal <= 4 < max(r.stateOperators[0].numRowsTotal for r in reports)


@pytest.mark.parametrize("parts", [1, 40])
def test_sketch(spark, parts):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.lognormal(size=20_000), np.full(9_000, 1.5)])
    rng.shuffle(v)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (math.nan,), (math.inf,)], "v double").repartition(parts)
    own = sketch.sketch(df, "v", 256)
    v.sort()
    assert own.n == len(v) and sum(len(x) for x in own.levels) <= 257 * len(own.levels) and sum(len(x) << h for h, x in enumerate(own.levels)) == own.n
    assert 0 < own.error < 0.06 * len(v)
    for p, q in zip(range(101), own.quantiles([p / 100 for p in range(101)]), strict=True):
        want = max(1, math.ceil(p / 100 * len(v)))
        assert np.searchsorted(v, q, "left") + 1 - own.error <= want <= np.searchsorted(v, q, "right") + own.error
    small = sketch.sketch(df.limit(100), "v")
    assert small.error == 0 and sketch.sketch(df.limit(0), "v").quantiles([0.5]) == [None]


def test_polynomial_through_chosen_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.random((500, 2)) * [4, 100] - [1, 0]
    y = 1 + x[:, 0] ** 2 - 0.1 * x[:, 0] * x[:, 1]
    df = spark.createDataFrame([(i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))] + [(900, None, 1.0, 1.0)], "id long, a double, b double, y double").repartition(6)
    model = fekete.fit(df, ["a", "b"], "y", 2)
    assert model.points.shape == (6, 3)
    got = {r.id: r.prediction for r in model.predict(df).collect()}
    assert all(abs(got[i] - t) < 1e-8 for i, t in enumerate(y)) and got[900] is None
    noisy = fekete.fit(df.withColumn("y", F.col("y") + F.rand(3)), ["a", "b"], "y", 3)
    back = noisy.predict(spark.createDataFrame([tuple(map(float, r)) for r in noisy.points], "a double, b double, y double")).collect()
    assert len(back) == 10 and all(abs(r.prediction - r.y) < 1e-8 for r in back)
    few = fekete.fit(df.limit(3), ["a", "b"], "y", 2)
    assert len(few.points) == 3 and np.isfinite(few.coefficients).all()
    with pytest.raises(ValueError):
        fekete.fit(df.where("id < 0"), ["a", "b"], "y")
