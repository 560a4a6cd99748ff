"""Cubic curves and gradients against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import cubic, gradients, models


def curve(spark, x, y):
    return cubic.pieces(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, p double").repartition(3))


def test_curve_passes_and_rises(spark):
    rng = np.random.default_rng(2)
    x = np.unique(np.round(rng.random(200) * 50, 2))
    y = np.cumsum(rng.random(len(x)) ** 6 * (rng.random(len(x)) < 0.8))
    y = y / y[-1]
    found = curve(spark, x, y)
    grid = np.sort(np.concatenate([x, rng.random(2000) * 52 - 1]))
    at = spark.createDataFrame([(float(v),) for v in grid], "v double")
    got = {r.v: (r.f, r.g) for r in cubic.evaluate(cubic.evaluate(at, found, "v", "f"), found, "v", "g", slope=True).collect()}
    f = np.array([got[v][0] for v in grid])
    assert all(abs(got[a][0] - b) < 1e-14 for a, b in zip(x, y, strict=True))
    assert (np.diff(f) >= -1e-15).all() and got[grid[0]] == (0.0, 0.0) and got[grid[-1]][0] == 1.0
    assert min(g for _, g in got.values()) >= -1e-12
    inside = np.flatnonzero((grid > x[0] + 0.01) & (grid < x[-1] - 0.01) & (np.abs(grid[:, None] - x).min(1) > 1e-4))
    more = spark.createDataFrame([(float(v),) for i in inside for v in (grid[i] - 1e-5, grid[i] + 1e-5)], "v double")
    h = {r.v: r.f for r in cubic.evaluate(more, found, "v", "f").collect()}
    assert all(abs((h[grid[i] + 1e-5] - h[grid[i] - 1e-5]) / 2e-5 - got[grid[i]][1]) < 1e-6 for i in inside)


def test_inverse(spark):
    x, y = np.array([0.0, 1, 2, 5, 6, 9]), np.array([0.0, 0.1, 0.1, 0.5, 0.9, 1])
    found = curve(spark, x, y)
    u = spark.createDataFrame([(float(v),) for v in np.linspace(0, 1, 201)] + [(None,), (-0.1,), (1.1,)], "u double")
    inv = cubic.invert(u, found, "u", "at")
    got = {r.u: (r.at, r.back) for r in cubic.evaluate(inv, found, "at", "back").collect()}
    assert got[None][0] is None and got[-0.1][0] is None and got[1.1][0] is None and got[0.0][0] == 0 and got[1.0][0] == 9
    assert all(abs(b - v) < 1e-12 for v, (a, b) in got.items() if v is not None and a is not None)
    assert got[0.1][0] == 1.0


def test_few_nodes(spark):
    assert curve(spark, [1], [2]).count() == 0
    two = curve(spark, [1, 3], [2, 6]).collect()
    assert [(r.low, r.high, r.m0, r.m1) for r in two] == [(1, 3, 2, 2)]
    at = spark.createDataFrame([(2.0,), (None,)], "v double")
    assert {(r.v, r.f) for r in cubic.evaluate(at, curve(spark, [1, 3], [2, 6]), "v", "f").collect()} == {(2.0, 4.0), (None, None)}
    # the published example: end slopes of three nodes, harmonic mean inside
    m = {(r.low, r.m0, r.m1) for r in curve(spark, [0, 1, 3], [0, 2, 3]).collect()}
    inner = 9 / (5 / 2 + 4 / 0.5)
    assert {(a, round(b, 12), round(c, 12)) for a, b, c in m} == {(0.0, 2.5, round(inner, 12)), (1.0, round(inner, 12), 0.0)}


@pytest.fixture(scope="module")
def surface(spark):
    rng = np.random.default_rng(4)
    x = rng.random((300, 2)) * [3, 20] + [1, -5]
    y = np.sin(x[:, 0]) * 5 + np.abs(x[:, 1]) + x[:, 0] * x[:, 1]
    return spark.createDataFrame([(i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, y double")


@pytest.mark.parametrize("fit", ["linear", "polynomial", "mars", "network", "plrm", "svr", "svr_poly"])
def test_gradient_equals_differences(spark, surface, fit):
    model = {"linear": lambda d: models.linear_fit(d, ["a", "b"], "y"), "polynomial": lambda d: models.polynomial_fit(d, ["a", "b"], "y", 3), "mars": lambda d: models.mars_fit(d, ["a", "b"], "y", 11, 2),
             "network": lambda d: models.network_fit(d, ["a", "b"], "y", (8, 8), steps=60), "plrm": lambda d: models.plrm_fit(d, ["a", "b"], "y", steps=60), "svr": lambda d: models.svr_fit(d, ["a", "b"], "y"),
             "svr_poly": lambda d: models.svr_fit(d, ["a", "b"], "y", "poly")}[fit](surface)
    h = 1e-5
    # knots are values of rows, so the places asked lie beside the rows
    surface = surface.withColumns({"a": F.col("a") + 1.7e-3, "b": F.col("b") + 2.3e-3})
    moved = surface.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("a") + (h * s if k == 0 else 0)).alias("a"), (F.col("b") + (h * s if k == 1 else 0)).alias("b"), F.lit(s).alias("s")) for k in (0, 1) for s in (-1, 1)])).alias("m")).select("id", "m.*")
    f = {(r.id, r.k, r.s): r.prediction for r in model.predict(moved).collect()}
    kinks = 0
    for r in gradients.gradient(model, surface).collect():
        for k in (0, 1):
            want = (f[r.id, k, 1] - f[r.id, k, -1]) / (2 * h)
            kinks += abs(r.gradient[k] - want) > 1e-6 * max(1, abs(want))
    assert kinks <= 2  # a difference over a kink is no slope


def test_shepard_gradient_at_a_point(spark):
    p = spark.createDataFrame([(0, [0.0, 0.0], 1.0), (1, [1.0, 2.0], 5.0), (2, [3.0, 1.0], -2.0)], "id long, x array<double>, y double")
    got = {r.query_id: r for r in gradients.shepard_gradient(p.withColumn("id", F.col("id") + 10), p, "id", "id", "x", "y").collect()}
    assert all(got[10 + k].gradient == [0.0, 0.0] and got[10 + k].prediction == v for k, v in enumerate((1.0, 5.0, -2.0)))
