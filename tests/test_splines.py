"""Splines, local fits, roots and interval joins against plain versions."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import intervals, splines


@pytest.fixture(scope="module")
def wave():
    rng = np.random.default_rng(6)
    x = np.sort(rng.random(37) * 10)
    return x, np.sin(x) * 3 + rng.random(37)


def nodes(spark, x, y):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double").repartition(3)


@pytest.mark.parametrize("block", [1, 2, 5, 1000])
def test_natural_spline_equals_dense_solve(spark, wave, block):
    x, y = wave
    h, d, n = np.diff(x), np.diff(y) / np.diff(x), len(x)
    a, r = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1: i + 2], r[i] = (h[i - 1], 2 * (h[i - 1] + h[i]), h[i]), 6 * (d[i] - d[i - 1])
    m = np.linalg.solve(a, r)
    got = sorted(splines.cubic(nodes(spark, x, y), block=block).collect())
    assert [p.low for p in got] == x[:-1].tolist() and [p.high for p in got] == x[1:].tolist()
    for i, p in enumerate(got):
        c = np.array(p.c)
        assert abs(c[2] * 2 - m[i]) < 1e-8 and abs(2 * c[2] + 6 * c[3] * h[i] - m[i + 1]) < 1e-8 and abs(np.polyval(c[::-1], h[i]) - y[i + 1]) < 1e-9
        if i + 1 < len(got):
            assert abs(np.polyval(np.polyder(c[::-1]), h[i]) - got[i + 1].c[1]) < 1e-8


def test_few_nodes(spark):
    assert splines.cubic(nodes(spark, [1], [2])).count() == 0
    (two,) = splines.cubic(nodes(spark, [1, 3], [2, 6])).collect()
    assert (two.low, two.high, list(two.c)) == (1, 3, [2, 2])
    assert splines.fit(nodes(spark, [1], [2])).count() == 0


@pytest.mark.parametrize(("local", "continuity"), [("polynomial", 0), ("polynomial", 1), ("polynomial", 3), ("quadratic", 2), ("facet", 1)])
def test_local_splines_join(spark, wave, local, continuity):
    x, y = wave
    got = sorted(splines.fit(nodes(spark, x, y), continuity, local).collect())
    assert len(got) == len(x) - 1
    for i, p in enumerate(got):
        assert abs(p.c[0] - y[i]) < 1e-12 and abs(np.polyval(p.c[::-1], p.high - p.low) - y[i + 1]) < 1e-6
        for d in range(1, continuity + 1):
            if i + 1 < len(got):
                one, two = (np.polyval(np.polyder(np.array(q.c)[::-1], d), t) for q, t in ((p, p.high - p.low), (got[i + 1], 0.0)))
                assert abs(one - two) < 1e-5 * max(1, abs(two))


def test_local_fits_of_a_parabola():
    x = np.array([0.0, 1, 3, 4, 7])
    y = 2 * x * x - x + 1
    assert np.allclose(splines.local_polynomial(x, y, 2, 3)[:3], [16, 11, 4])
    assert np.allclose(splines.local_quadratic(np.array([1.0, 2, 3]), np.array([1.0, 4, 9]), 1), [4, 4, 2])
    line = 3 * x - 2
    assert np.allclose(splines.local_facet(x, line, 3), [10, 3])
    kink = np.where(x < 3, 0, x - 3)
    assert np.isclose(splines.local_facet(x, kink, 4)[1], 1)
    with pytest.raises(ValueError):
        splines.fit(None, 1, "other")


def test_roots_and_crossings(spark, wave):
    assert np.allclose(splines.roots(np.poly([1, 2, 2, 5])[::-1], 0, 6), [1, 2, 5], atol=1e-6)
    assert splines.roots(np.array([1.0, 0, 1]), -5, 5) == [] and splines.roots(np.array([0.0, 1]), 0, 1) == [0.0]
    x, y = wave
    found = splines.kept(splines.cubic(nodes(spark, x, y), block=10), "p")
    asked = spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.linspace(-4, 5, 30))] + [(99, None)], "id long, v double")
    got = splines.crossings(asked, found, "id", "v")
    back = splines.evaluate(got, found, "x").join(asked, "id").collect()
    assert back and all(abs(r.value - r.v) < 1e-9 for r in back)
    pieces = [(p.low, p.high, np.array(p.c)[::-1]) for p in found.collect()]
    fine = {i: sum(np.sum(np.diff(np.sign(np.polyval(c, np.linspace(0, b - a, 4001)) - v)) != 0) for a, b, c in pieces) for i, v in [(r.id, r.v) for r in asked.collect() if r.v is not None]}
    counts = {r.id: r["count"] for r in got.groupBy("id").count().collect()}
    assert all(counts.get(i, 0) == n for i, n in fine.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_range_join(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(intervals, "PART_ROWS", 20)
    ranges = [(i, float(a := rng.randint(-50, 50)), a + rng.choice([0.0, 1.0, 2.5, 40.0, 900.0, -1.0])) for i in range(120)] + [(900, None, 1.0), (901, 1.0, None), (902, -1e9, 1e9)]
    points = [(i, float(rng.randint(-60, 60)) if rng.random() < 0.7 else 7.0) for i in range(200)] + [(999, None)]
    r = spark.createDataFrame(ranges, "i long, low double, high double")
    p = spark.createDataFrame(points, "p long, at double")
    got = intervals.covering(p, r, "at", "low", "high")
    want = sorted((a, b) for a, t in points for b, lo, hi in ranges if None not in (t, lo, hi) and lo <= t <= hi)
    assert sorted((x.p, x.i) for x in got.collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    o = r.toDF("j", "lo", "hi")
    both = sorted((x.i, x.j) for x in intervals.overlapping(r, o, "low", "high", "lo", "hi").collect())
    ok = [(i, a, b) for i, a, b in ranges if None not in (a, b) and a <= b]
    assert both == sorted((i, j) for i, a, b in ok for j, c, d in ok if a <= d and c <= b)
    assert intervals.covering(p, r.limit(0), "at", "low", "high").count() == 0
    with pytest.raises(ValueError):
        intervals.covering(p, p, "at", "at", "at")


def test_totals_of_ranges(spark, monkeypatch):
    """As the pairs give them, and without a join of points and ranges."""
    rng = random.Random(3)
    ranges = [(i % 110, float(a := rng.randint(-50, 50)), a + rng.choice([0.0, 1.0, 2.5, 40.0, 900.0, -1.0])) for i in range(120)] + [(900, None, 1.0), (901, 1.0, None), (902, -1e9, 1e9), (903, 70.0, 80.0)]
    points = [(i, float(rng.randint(-60, 60)) if rng.random() < 0.7 else 7.0) for i in range(200)] + [(999, None), (998, -0.0), (None, 3.0)]
    r, p = spark.createDataFrame(ranges, "i long, low double, high double").repartition(3), spark.createDataFrame(points, "p long, at double").repartition(3)
    got = {x.i: (x.n, x.least, x.total) for x in intervals.totals(p, r, "at", "i", "low", "high", {"total": F.col("p")}).collect()}
    want = {}
    for i, low, high in ranges:
        held = [(a, t) for a, t in points if None not in (t, low, high) and low <= t <= high]
        if held:
            n, least, total = want.get(i, (0, 1e9, 0))
            want[i] = n + len(held), min(least, *[t for _, t in held], 1e9), total + sum(a or 0 for a, _ in held)
    assert got == want and 903 not in got
    assert intervals.totals(p, r.limit(0), "at", "i", "low", "high", {}).count() == 0 == intervals.totals(p.limit(0), r, "at", "i", "low", "high", {}).count()
    # the query makes no row for a pair
    from tessella.plans import tables

    monkeypatch.setattr(intervals, "covering", lambda *a: pytest.fail("pairs"))
    assert tables.balance_ranges(spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("tolerance", [None, 7200.0])
def test_as_of(spark, direction, tolerance):
    rng = random.Random(5)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randint(0, 900))
    left = [(i, rng.choice([1, 2, None]), rng.choice(["a", "b"]), at() if rng.random() < 0.95 else None) for i in range(80)]
    right = [(i, rng.choice([1, 2, 3, None]), rng.choice(["a", "b"]), at() if rng.random() < 0.95 else None) for i in range(60)]
    a = spark.createDataFrame(left, "i long, k long, s string, t timestamp_ntz")
    b = spark.createDataFrame(right, "j long, k2 long, s2 string, t2 timestamp_ntz").repartition(3)
    got = {r.i: r.j for r in intervals.as_of(a, b, "t", "t2", [("k", "k2"), ("s", "s2")], direction, tolerance, ["j"]).collect()}
    assert set(got) == set(range(80))
    for i, k, s, t in left:
        fit = [(u, j) for j, k2, s2, u in right if t and u and k is not None and (k2, s2) == (k, s) and (u <= t if direction == "backward" else u >= t)]
        edge = (max if direction == "backward" else min)((u for u, _ in fit), default=None)
        best = max((j for u, j in fit if u == edge), default=None)
        if best is not None and tolerance is not None and abs((edge - t).total_seconds()) > tolerance:
            best = None
        assert got[i] == best
    with pytest.raises(ValueError):
        intervals.as_of(a, b, "t", "t2", direction="sideways")


def test_as_of_without_keys_on_numbers(spark):
    a = spark.range(10).select(F.col("id").alias("v"))
    b = spark.createDataFrame([(2.5, "x"), (6.0, "y")], "at double, name string")
    got = {r.v: r.name for r in intervals.as_of(a, b, "v", "at").collect()}
    assert got == {0: None, 1: None, 2: None, 3: "x", 4: "x", 5: "x", 6: "y", 7: "y", 8: "y", 9: "y"}


def test_local_fits_of_many_rows_equal_those_of_one():
    """Nodes are fitted together, not one after another."""
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.integers(1, 3, (60, 7)), 1).astype(float)  # equal steps make ties
    y = rng.random((60, 7))
    for i in (0, 3, 6):
        for many, one, order in ((splines.local_polynomials, splines.local_polynomial, (3,)), (splines.local_quadratics, splines.local_quadratic, ()), (splines.local_facets, splines.local_facet, ())):
            assert np.allclose(many(x, y, i, *order), [one(a, b, i, *order) for a, b in zip(x, y, strict=True)], rtol=1e-12)
    for a, b, c in zip(x, y, splines.local_polynomials(x, y, 3, 3), strict=True):
        near = sorted(range(7), key=lambda j: (abs(j - 3), abs(a[j] - a[3]) * abs(b[j] - b[3])))
        use = near[: 4 if abs(a[near[3]] - a[3]) == abs(a[near[2]] - a[3]) else 3]
        p = np.polyfit(a[use] - a[3], b[use], len(use) - 1)[::-1]
        assert np.allclose(c[: len(use)], p * np.array([1, 1, 2, 6])[: len(use)])


def test_local_spline_is_dealt_to_all_tasks(spark, wave):
    x, y = wave
    assert splines.fit(nodes(spark, x, y), 2).rdd.getNumPartitions() == 4
