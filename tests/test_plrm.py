"""Piecewise-linear networks with embeddings: gradients, categories, missing values, many rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import models, plrm


@pytest.fixture(scope="module")
def shop(spark):
    """A response that depends on a category in no order of its codes."""
    rng = np.random.default_rng(3)
    price = rng.random(12) * 10
    rows = [(i, float(q := rng.integers(1, 9)), int(c := rng.integers(0, 12)), int(rng.integers(0, 2)), float(q * price[c])) for i in range(1500)]
    return spark.createDataFrame(rows, "id long, q double, item int, flag long, y double")


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    codes = {"a": np.array([1.0, 4, 9]), "b": np.array([0.0, 1])}
    widths = [2 + 2 * 2, 5, 4, 1]
    p = {f"w{i}": rng.standard_normal((a, b)) for i, (a, b) in enumerate(zip(widths, widths[1:], strict=False))} | {f"s{i}": rng.standard_normal(b) for i, b in enumerate(widths[1:])} | {"e0": rng.standard_normal((4, 2)), "e1": rng.standard_normal((3, 2))}
    model = plrm.Plrm(["x", "z"], ["a", "b"], codes, p, {"mean": np.array([0.5, 1]), "scale": np.array([2.0, 3]), "y_mean": 1.0, "y_scale": 2.0})
    m = np.column_stack([rng.standard_normal((40, 2)), rng.choice([1, 4, 9, 7], 40), rng.choice([0, 1, 5], 40)])
    t = rng.standard_normal(40)
    slopes = model.loss(m, t)[1]
    h = 1e-6
    for name, g in slopes.items():
        for at in np.ndindex(g.shape):
            old = p[name][at]
            p[name][at] = old + h
            up = model.loss(m, t)[0]
            p[name][at] = old - h
            down = model.loss(m, t)[0]
            p[name][at] = old
            assert abs((up - down) / (2 * h) - g[at]) < 1e-5 * max(1, abs(g[at])), name
    for k in (0, 1):
        step = np.zeros(4)
        step[k] = h
        assert np.allclose((model.values(m + step) - model.values(m - step)) / (2 * h), model.slopes(m)[:, k], atol=1e-6)


def error(df):
    return df.agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0]


def test_category_beats_its_code(spark, shop):
    own = plrm.fit(shop, ["q"], ["item"], "y", steps=150)
    as_number = plrm.fit(shop, ["q", "item"], [], "y", steps=150)
    a, b = error(own.predict(shop)), error(as_number.predict(shop))
    assert a < 0.3 * b and own.errors[-1] < own.errors[0]
    table = own.embeddings(spark, "item").collect()
    assert sorted(r.value for r in table if r.value is not None) == list(range(12)) and [len(r.embedding) for r in table] == [2] * 13
    assert len(own.states(shop).first().state) == 16 and len(own.gradient(shop).first().gradient) == 1


def test_passes_equal_held_rows(spark, shop, monkeypatch):
    held = plrm.fit(shop, ["q"], ["item", "flag"], "y", steps=4)
    monkeypatch.setattr(models, "MAX_FIT_ROWS", 100)
    passed = plrm.fit(shop.repartition(5), ["q"], ["item", "flag"], "y", steps=4)
    assert np.allclose(held.errors, passed.errors) and all(np.allclose(held.parameters[k], passed.parameters[k], atol=1e-6) for k in held.parameters)


def test_missing_and_unknown(spark, shop):
    some = shop.withColumn("item", F.when(F.col("id") % 7 != 0, F.col("item"))).withColumn("q", F.when(F.col("id") % 11 != 0, F.col("q")))
    model = plrm.fit(some, ["q"], ["item"], "y", steps=5, max_codes=4)
    assert len(model.codes["item"]) == 4 and model.parameters["e0"].shape == (5, 2)
    new = spark.createDataFrame([(None, 3), (2.0, None), (2.0, 77)], "q double, item int")
    got = [r.prediction for r in model.predict(new).collect()]
    assert got[0] is None and got[1] == got[2] is not None
    with pytest.raises(ValueError):
        plrm.fit(shop.where("id < 0"), ["q"], ["item"], "y")


@pytest.mark.parametrize("most", [20_000, 3])
def test_rows_of_equal_inputs_are_one_point(spark, monkeypatch, most):
    """Sums of squared errors over points and what lies within them are those over all rows; a fit sees a row a point."""
    monkeypatch.setattr(models, "MAX_FIT_ROWS", most)
    rng = np.random.default_rng(3)
    x, t = rng.integers(0, 3, (400, 2)).astype(float), rng.normal(size=400) + 1e4
    df = spark.createDataFrame([*[(*map(float, r), float(v)) for r, v in zip(x, t)], (None, 1.0, 5.0)], "a double, b double, y double")
    points = models.Points(df, ["a", "b"], "y")
    f = lambda x: 1e4 + x @ np.array([0.5, -0.25])
    seen, error = points.sums(lambda x, t, n: [np.array(len(x)), n @ (f(x) - t) ** 2])
    assert seen == 9 and points.n == 400
    assert error + points.within == pytest.approx(((f(x) - t) ** 2).sum())
    mean, var, middle, spread = points.moments()
    assert np.allclose(mean, x.mean(0)) and np.allclose(var, x.var(0)) and middle == pytest.approx(t.mean()) and spread == pytest.approx(t.var())


def test_svr_adds_up_rows_of_equal_inputs(spark, monkeypatch):
    """Fits over passes, where rows of equal inputs share their features, are those of rows on the driver."""
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), float(a - b + e)) for a, b, e in zip(rng.integers(0, 4, 300), rng.integers(0, 3, 300), rng.normal(size=300))]
    df, seen = spark.createDataFrame(rows, "a double, b double, y double"), []
    values = models._svr_values
    monkeypatch.setattr(models, "_svr_values", lambda p, x: (seen.append(len(x)), values(p, x))[1])
    held = models.svr_fit(df, ["a", "b"], "y", features=20)
    assert set(seen) == {12}  # features are made once for a point, not for each of its rows
    monkeypatch.undo()
    monkeypatch.setattr(models, "MAX_FIT_ROWS", 50)
    assert np.allclose(models.svr_fit(df, ["a", "b"], "y", features=20).parameters["weights"], held.parameters["weights"], rtol=1e-4, atol=1e-6)
