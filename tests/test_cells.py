"""Searches in cells and certified meshes against comparisons with all points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import cells, joins, meshes, models


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), None if v is None else [float(t) for t in v]) for i, v in zip(ids, x, strict=True)], "id long, x array<double>")


@pytest.fixture(scope="module")
def clustered():
    """Groups of points of unequal density, equal points, and points far away."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, s, (200, 3)) for c, s in ((0, 1), (20, 0.1), (-30, 5))] + [np.zeros((150, 3)), [[1e6, 0, 0]]])
    return rng.permutation(len(x)), x


def test_nearest_equals_all_pairs(spark, clustered, monkeypatch):
    ids, x = clustered
    p = table(spark, ids, x)
    q = table(spark, range(40), np.concatenate([x[::20][:35], np.full((5, 3), 3.0)])).select(F.col("id").alias("query_id"), F.col("x").alias("qx"))
    monkeypatch.setattr(cells, "BLOCK", 40)  # blocks and chunks as in large tables
    monkeypatch.setattr(cells, "CHUNK", 7)
    tally = {}
    got = cells.nearest(q, p, 6, "query_id", "id", "qx", "x", tally=tally)
    want = joins.nearest(q, p, 6, "query_id", "id", "qx", "x")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    print(f"compared {tally['compared']} of {tally['pairs']} pairs")
    assert tally["compared"] < 0.4 * tally["pairs"]
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


def test_nearest_of_oneself(spark, clustered):
    ids, x = clustered
    p = table(spark, ids[:300], x[:300])
    got = cells.nearest(p, p, 3, "id", "id", "x", "x", exclude_self=True)
    want = joins.nearest(p, p, 3, "id", "id", "x", "x", exclude_self=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_many_pairs_take_cells(spark, clustered, monkeypatch):
    ids, x = clustered
    p = table(spark, ids, x)
    want = sorted(map(tuple, joins.nearest(p, p, 2, "id", "id", "x", "x").collect()))
    monkeypatch.setattr(joins, "DIRECT_PAIRS", 1000)
    assert sorted(map(tuple, joins.nearest(p, p, 2, "id", "id", "x", "x").collect())) == want


def test_modified_shepard_in_cells(spark, clustered, monkeypatch):
    ids, x = clustered
    p = table(spark, ids, x)
    q = table(spark, range(30), np.concatenate([x[::25][:24], [[0.4, 0.2, 0.1], [20.1, 20, 20], [-31, -29, -28], [500, 0, 0], [0, 0, 0], [9, 9, 9]]]))
    want = {(r.query_id, r.id): r.weight for r in models.modified_shepard_weights(q, p, "id", "id", "x", 5, 1.2).collect()}
    monkeypatch.setattr(joins, "DIRECT_PAIRS", 1000)
    got = {(r.query_id, r.id): r.weight for r in models.modified_shepard_weights(q, p, "id", "id", "x", 5, 1.2).collect()}
    assert set(got) == set(want) and all(abs(got[k] - w) < 1e-9 for k, w in want.items())


def test_odd_rows(spark):
    p = table(spark, range(6), [None, [np.nan, 1], [1, np.inf], [1, 1], [1, 1], [4, 5]])
    got = cells.nearest(p.withColumnRenamed("id", "q"), p, 9, "q", "id", "x", "x").collect()
    assert sorted((r.q, r.id, r.rank) for r in got) == [(3, 3, 1), (3, 4, 2), (3, 5, 3), (4, 3, 1), (4, 4, 2), (4, 5, 3), (5, 3, 2), (5, 4, 3), (5, 5, 1)]
    assert cells.nearest(p, p.where("id < 0"), 2, "id", "id", "x", "x").count() == 0


def test_farthest_in_a_direction(spark, clustered):
    ids, x = clustered
    c = cells.build(table(spark, ids, x), "id", "x")
    asks = spark.createDataFrame([(0, [1.0, 2.0, -1.0], True, None), (1, [0.0, 0.0, 1.0], True, -5.0)], "ask long, c array<double>, far boolean, most double")
    got = cells.closest(c, asks, 4).collect()
    for ask, way, most in ((0, [1, 2, -1], np.inf), (1, [0, 0, 1], -5.0)):
        value = np.sort(-(x @ np.array(way, float)))[:4]
        assert np.allclose(sorted(r.value for r in got if r.ask == ask), value[value <= most])


def dense(got, ids, queries):
    out = {q: np.zeros(len(ids)) for q in queries}
    at = {i: k for k, i in enumerate(ids)}
    for r in got.collect():
        out[r.query_id][at[r.id]] += r.weight
    return out


@pytest.mark.parametrize("pivots", [None, 260])
def test_boxes_where_points_share_coordinates_and_cells_hold_one(spark, pivots):
    """Points in columns, many at a query's own coordinate; a cell of one point is not ruled out by that point. Equal queries are one question."""
    rng = np.random.default_rng(9)
    x = np.unique(np.stack([rng.integers(0, 12, 260) / 12, np.round(rng.random(260), 2)], 1), axis=0)
    asked = np.concatenate([np.stack([rng.integers(0, 12, 12) / 12, np.round(rng.random(12), 2) + 0.005], 1), rng.random((6, 2)) * 1.2 - 0.1, x[:1]])
    asked = np.concatenate([asked, asked[:5]])
    p, q = table(spark, range(len(x)), x), table(spark, range(len(asked)), asked)
    weights = meshes.box_mesh_weights(q, p, "id", "id", "x", cells.build(p, "id", "x", pivots)).collect()
    wide = models.box_widths(x)
    for i, v in enumerate(asked):
        got = np.zeros(len(x))
        for r in weights:
            if r.query_id == i:
                got[r.id] += r.weight
        way = v - x
        reach = np.take_along_axis(wide, (way > 0).astype(int)[:, :, None], 2)[:, :, 0]
        w = np.prod(np.where(np.isinf(reach), 1.0, np.maximum(0, 1 - np.abs(way) / reach)), axis=1)
        assert np.allclose(got, w / w.sum() if w.any() else np.eye(len(x))[(way ** 2).sum(1).argmin()], atol=1e-9)


@pytest.mark.parametrize("d", [2, 3])
def test_meshes_equal_the_local_ones(spark, d):
    rng = np.random.default_rng(d)
    x = np.round(rng.random((260, d)), 3)
    asked = np.concatenate([rng.random((22, d)) * 1.2 - 0.1, x[:2]])
    p, q = table(spark, range(len(x)), x), table(spark, range(len(asked)), asked)
    built = cells.build(p, "id", "x")
    got = dense(meshes.voronoi_weights(q, p, "id", "id", "x", built), range(len(x)), range(len(asked)))
    assert all(np.allclose(got[i], models.voronoi_weights_of(x, v), atol=1e-9) for i, v in enumerate(asked))

    wide = models.box_widths(x)
    got = dense(meshes.box_mesh_weights(q, p, "id", "id", "x", built), range(len(x)), range(len(asked)))
    for i, v in enumerate(asked):
        way = v - x
        reach = np.take_along_axis(wide, (way > 0).astype(int)[:, :, None], 2)[:, :, 0]
        w = np.prod(np.where(np.isinf(reach), 1.0, np.maximum(0, 1 - np.abs(way) / reach)), axis=1)
        assert np.allclose(got[i], w / w.sum() if w.any() else np.eye(len(x))[((way) ** 2).sum(1).argmin()], atol=1e-9)

    got = dense(meshes.delaunay_weights(q, p, "id", "id", "x", models.delaunay_weights_of, built), range(len(x)), range(len(asked)))
    inside = 0
    for i, v in enumerate(asked):
        want = models.delaunay_weights_of(x, v)
        if np.allclose(want @ x, v, atol=1e-7):  # inside the hull; simplices of equal spheres may differ
            inside += 1
            assert np.allclose(got[i] @ x, v, atol=1e-7) and abs((got[i] - want) @ (x**2).sum(1)) < 1e-7 and (got[i] > 0).sum() <= d + 1
    assert inside >= 10


def test_simplex_method():
    w, price, ok = meshes.solve(np.array([[1.0, -1, 0, 2], [1, 1, 1, 1]]), np.array([1.0, 1, 3, 0.5]), np.array([0.0, 1.0]))
    assert ok and np.allclose(w, [0, 2 / 3, 0, 1 / 3]) and np.all(np.array([1.0, 1, 3, 0.5]) - price @ np.array([[1.0, -1, 0, 2], [1, 1, 1, 1]]) > -1e-9)
    assert not meshes.solve(np.array([[1.0, 2.0], [1, 1]]), np.array([1.0, 1]), np.array([0.0, 1.0]))[2]


def test_sums_over_pairs_keep_no_pair(spark, monkeypatch):
    """Distance-weighted sums come from tiles: the plans hold no join of queries and points, and blocks of queries give the same."""
    from tessella.operators import gradients

    rng = np.random.default_rng(4)
    x, y = rng.normal(0, 3, (300, 2)), rng.normal(0, 1, 300)
    p = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))] + [(900, None, 1.0), (901, [1.0], 2.0)], "id long, x array<double>, y double")
    at = np.concatenate([rng.normal(0, 3, (50, 2)), x[:2]])
    q = table(spark, range(1000, 1053), [*at, None])
    monkeypatch.setattr(joins, "SUM_QUERIES", 20)
    monkeypatch.setattr(joins, "TILE", 500)
    plain = models.shepard_predict(q.withColumn("y", F.lit(0.0)), p, "id", "id", "x", "y")
    slopes = gradients.shepard_gradient(q, p, "id", "id", "x", "y")
    for df in (plain, slopes):
        plan = df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got, slope = {r.query_id: r.prediction for r in plain.collect()}, {r.query_id: r for r in slopes.collect()}
    assert len(got) == 53 and got[1052] is None and len(slope) == 52
    for i, v in enumerate(at[:50]):
        w = 1 / ((x - v) ** 2).sum(1)
        f = w @ y / w.sum()
        dw = -2 * (v - x) * (w * w)[:, None]
        assert abs(got[1000 + i] - f) < 1e-9 and abs(slope[1000 + i].prediction - f) < 1e-9
        assert np.allclose(slope[1000 + i].gradient, (y @ dw - f * dw.sum(0)) / w.sum(), atol=1e-8)
    assert [got[1050], got[1051]] == y[:2].tolist() and list(slope[1050].gradient) == [0, 0]


def test_linear_shepard_without_a_row_a_pair(spark):
    """Radii are searched for; a query that no radius holds sums over all points. Neither joins queries and points."""
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (400, 2))
    y = np.sin(x[:, 0]) + x[:, 1] ** 2
    p = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y double")
    at = np.concatenate([rng.normal(0, 1, (60, 2)), x[:2], [[40.0, 40.0], [-90.0, 3.0]]])
    q = table(spark, range(1000, 1064), at)
    fitted = models.linear_shepard_fit(p, "id", "x", "y")
    by = {r.id: (r.radius, np.array(r.slope)) for r in fitted.collect()}
    radius, slope = np.array([by[i][0] for i in range(400)]), np.array([by[i][1] for i in range(400)])
    df = models.linear_shepard_predict(q, p, fitted, "id", "id", "x", "y")
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = {r.query_id: r.prediction for r in df.collect()}
    assert len(got) == 64
    for i, v in enumerate(at):
        d = np.sqrt(((x - v) ** 2).sum(1))
        w = np.where(d < 1e-8, 1e30, np.where(d < radius, ((radius - d) / (radius * np.maximum(d, 1e-9))) ** 2, 1e-30 / np.maximum(d, 1e-9) ** 2))
        assert abs(got[1000 + i] - w @ (y + ((v - x) * slope).sum(1)) / w.sum()) < 1e-9 * max(1, abs(got[1000 + i]))


def test_cells_in_groups(spark, monkeypatch):
    """Where nothing is ruled out a question goes once to a group of cells, with the same neighbours."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (500, 24))
    p = table(spark, range(500), x)
    q = table(spark, range(30), x[:30] + 0.1).select(F.col("id").alias("query_id"), F.col("x").alias("qx"))
    built = cells.build(p, "id", "x")
    sizes = []
    real = cells.grouped
    monkeypatch.setattr(cells, "GROUP", 120)
    monkeypatch.setattr(cells, "BOUNDED", 50)
    monkeypatch.setattr(cells, "grouped", lambda *a: sizes.append(real(*a)) or sizes[-1])
    got = cells.nearest(q, p, 4, "query_id", "id", "qx", "x", cells=built)
    want = joins.nearest(q, p, 4, "query_id", "id", "qx", "x")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sizes and len(set(sizes[0].tolist())) < len(built.pivots)
    assert np.bincount(sizes[0], built.count).max() <= 120


def test_far_points_on_lines_are_cut_off(spark):
    """On lines the nearest points all lie on a query's own line; what they leave open is cut off by each other, in the mesh's weights as ever."""
    rng = np.random.default_rng(8)
    rows = [(100 * k + i, [k / 2, float(v)]) for k in range(12) for i, v in enumerate(np.sort(rng.random(90)))]
    points = spark.createDataFrame(rows, "p int, x array<double>")
    at = [[k / 2, float(v)] for k in (3, 6, 8) for v in rng.random(2)] + [[2.7, 0.5]]
    queries = spark.createDataFrame(list(enumerate(at)), "q int, x array<double>")
    x = np.array([r[1] for r in rows])
    built = cells.build(points, "p", "x", pivots=20)
    known = meshes._known(built, meshes._asks(queries, "q", "x"))
    open_ = meshes._openings(built, known, meshes._open_balls, lambda at, radius, o: np.ones(len(at), bool))
    assert max(r.n for r in open_.select(F.size("open").alias("n")).collect()) <= 24
    own, near = meshes.voronoi_weights(queries, points, "q", "p", "x", built), models._local(queries, points, "q", "p", "x", models.voronoi_weights_of)
    key = lambda df: {(r.query_id, r.p): round(r.weight, 9) for r in df.collect() if r.weight > 1e-9}
    assert key(own) == key(near)


def test_pairs_in_tiles(spark, monkeypatch):
    """Odd rows keep their pairs, and one partition of points is dealt to all tasks."""
    monkeypatch.setattr(joins, "PAIR_TILE", 8)
    monkeypatch.setattr(joins, "SUM_QUERIES", 3)
    q = spark.createDataFrame([(1, [1.0, 2.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0]), (None, [4.0, 4.0]), (5, []), (6, [float("nan"), 1.0])], "q long, v array<double>")
    p = spark.createDataFrame([(f"p{i}", [float(i), 2.0]) for i in range(12)] + [("none", None), ("hole", [1.0, None]), ("one", [3.0]), ("empty", []), (None, [4.0, 4.0])], "id string, x array<double>").coalesce(1)
    got = joins.pairwise_distance(q, p, "q", "id", "v", "x")
    both = q.crossJoin(p).select("q", "id", F.sqrt(joins.squared_distance(F.col("v"), F.col("x"))).alias("distance"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, both.collect())) and got.count() == 7 * 17
    assert got.where("id is not null").rdd.getNumPartitions() >= 4


def test_shepard_weights_keep_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(joins, "PAIR_TILE", 8)
    q = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.5, 2.5]), (2, [1.5, 2.0]), (3, None), (None, [0.5, 2.0]), (4, [7.0])], "q long, v array<double>")
    p = spark.createDataFrame([(i, [float(i // 2), 2.0]) for i in range(12)] + [(12, None), (13, [1.0])], "id long, x array<double>")
    w = models.shepard_weights(q, p.withColumnRenamed("x", "v"), "q", "id", "v")
    got = {}
    for r in w.collect():
        got.setdefault(r.query_id, []).append((r.id, r.weight))
    assert sorted(got[1]) == [(2, 0.5), (3, 0.5)]  # both rows of this query count, and one of them hits
    for who, at in ((2, [1.5, 2.0]), (None, [0.5, 2.0])):
        raw = {i: 1 / ((i // 2 - at[0]) ** 2) for i in range(12)}
        assert sorted(got[who]) == [(i, pytest.approx(x / sum(raw.values()))) for i, x in sorted(raw.items())]
    assert got[4] == [(13, 1.0)] and set(got) == {1, 2, 4, None}
    assert "Window" not in w._jdf.queryExecution().executedPlan().toString()


def test_questions_are_dealt_to_all_tasks(spark, clustered):
    """A question costs as much as there are cells, so one partition of questions is not one task."""
    ids, x = clustered
    p = table(spark, ids, x).coalesce(1)
    got = cells.nearest(p, p, 2, "id", "id", "x", "x")
    assert "RoundRobinPartitioning(4)" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, joins.nearest(p, p, 2, "id", "id", "x", "x").collect()))


def test_open_rectangles_of_many_queries():
    """All queries of a block at once leave what each of them leaves by itself; a cell costs few numpy calls for all its queries."""
    r = np.random.default_rng(5)
    for x in (r.normal(size=(300, 2)), r.integers(-4, 5, (200, 3)).astype(float), r.normal(size=(1, 2))):
        c = r.integers(-2, 3, (9, x.shape[1])).astype(float)
        others = [r.integers(-5, 6, (k, x.shape[1])) - v for k, v in enumerate(c)]
        for q, o, got in zip(c, others, meshes._open_rectangles_of(x, c, others), strict=True):
            y = x - q

            def holds(a, b):
                return bool(np.all(a * np.sign(b) >= np.abs(b)) and np.any(a != b))

            want = {i for i in range(len(y)) if not any(holds(y[i], b) for b in [*y, *o])}
            assert want == set(got[meshes._open_rectangles(y[got])].tolist())
