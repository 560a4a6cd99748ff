"""Piecewise-linear regression with embeddings of integer categories, learned together.

A row's numbers, scaled, and the vectors of its categories enter layers of ramps with a shift for each state; the output
is linear. Vectors of categories are parameters like any other: a step adds the gradient of each row to the rows of
its categories' table, and one aggregate of all tables and matrices makes the step. Steps are Adam's with a factor that grows
while the error falls and shrinks when it rises; the best step is kept, and fitting stops after `patience` steps without a
better one.

The model lies on the driver, so its size has to be bounded: the `max_codes` most frequent values of a category have vectors of
their own (ties: the least value), all others share one with missing values. Up to models.MAX_FIT_ROWS rows are held by the
driver, rows of equal inputs as one; of more, these are written once and each step is a pass over them.

Defined cases: rows with a null number or response do not fit; rows with a null number have null predictions; a null or unknown
category takes the shared vector; categories that hold one value only add a constant; an empty table is an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .models import Points

MAX_CODES = 10_000


@dataclass
class Plrm:
    """Inputs, categories with their known values, and the parameters by name."""

    inputs: list[str]
    categories: list[str]
    codes: dict[str, np.ndarray]
    parameters: dict[str, np.ndarray]
    scaling: dict[str, np.ndarray | float]
    errors: list[float] = field(default_factory=list)

    @property
    def depth(self) -> int:
        return sum(k.startswith("w") for k in self.parameters)

    def places(self, category: str, values: np.ndarray) -> np.ndarray:
        """Rows of a category's table; the last one is that of unknown values."""
        known = self.codes[category]
        at = np.searchsorted(known, values)
        at = np.minimum(at, max(0, len(known) - 1))
        good = (known[at] == values) if len(known) else np.zeros(len(values), bool)
        return np.where(good, at, len(known))

    def split(self, m: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Scaled numbers and table rows of a matrix of numbers and category values."""
        d = len(self.inputs)
        return (m[:, :d] - self.scaling["mean"]) / self.scaling["scale"], [self.places(c, m[:, d + k]) for k, c in enumerate(self.categories)]

    def forward(self, z: np.ndarray, at: list[np.ndarray]) -> list[np.ndarray]:
        """The input with its embeddings, the states after each layer, the output."""
        p = self.parameters
        layers = [np.hstack([z, *[p[f"e{k}"][a] for k, a in enumerate(at)]])]
        for i in range(self.depth):
            h = layers[-1] @ p[f"w{i}"] + p[f"s{i}"]
            layers.append(np.maximum(h, 0) if i + 1 < self.depth else h)
        return layers

    def backward(self, layers: list[np.ndarray], at: list[np.ndarray], g: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(gradients of all parameters, gradient of the scaled numbers) for the output's gradient."""
        p, out = self.parameters, {}
        for i in reversed(range(self.depth)):
            out[f"w{i}"], out[f"s{i}"] = layers[i].T @ g, g.sum(0)
            g = g @ p[f"w{i}"].T
            if i:
                g = g * (layers[i] > 0)
        d = len(self.inputs)
        start = d
        for k, a in enumerate(at):
            size = p[f"e{k}"].shape[1]
            out[f"e{k}"] = np.stack([np.bincount(a, g[:, start + j], len(p[f"e{k}"])) for j in range(size)], 1)
            start += size
        return out, g[:, :d]

    def loss(self, m: np.ndarray, t: np.ndarray, n: np.ndarray | float = 1.0) -> tuple[float, dict[str, np.ndarray]]:
        """(sum of squared scaled errors, its gradients); `n` rows stand behind each one."""
        z, at = self.split(m)
        layers = self.forward(z, at)
        e = layers[-1][:, 0] - (t - self.scaling["y_mean"]) / self.scaling["y_scale"]
        return float(e @ (n * e)), self.backward(layers, at, (2 * n * e)[:, None])[0]

    def values(self, m: np.ndarray) -> np.ndarray:
        return self.forward(*self.split(m))[-1][:, 0] * self.scaling["y_scale"] + self.scaling["y_mean"]

    def slopes(self, m: np.ndarray) -> np.ndarray:
        """Partial derivatives by the numbers."""
        z, at = self.split(m)
        layers = self.forward(z, at)
        return self.backward(layers, at, np.full((len(z), 1), float(self.scaling["y_scale"])))[1] / self.scaling["scale"]

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return _scored(self, df, name, T.DoubleType(), lambda own, m: own.values(m))

    def gradient(self, df: DataFrame, name: str = "gradient") -> DataFrame:
        return _scored(self, df, name, T.ArrayType(T.DoubleType()), lambda own, m: own.slopes(m))

    def states(self, df: DataFrame, name: str = "state") -> DataFrame:
        """Add the last hidden state: the coordinates that the network learned."""
        return _scored(self, df, name, T.ArrayType(T.DoubleType()), lambda own, m: own.forward(*own.split(m))[-2])

    def embeddings(self, spark, category: str) -> DataFrame:
        """(value, embedding): a row for each value with a vector of its own and one (null) for all others."""
        table = self.parameters[f"e{self.categories.index(category)}"]
        rows = [(int(v), r.tolist()) for v, r in zip(self.codes[category], table, strict=False)] + [(None, table[-1].tolist())]
        return spark.createDataFrame(rows, "value long, embedding array<double>")


def _scored(model: Plrm, df: DataFrame, name: str, kind: T.DataType, function) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(model)
    arrow = pa.float64() if isinstance(kind, T.DoubleType) else pa.list_(pa.float64())

    def run(batches):
        own = sent.value
        for b in batches:
            cols = [b.column(c).cast(pa.float64()) for c in [*own.inputs, *own.categories]]
            m = np.stack([c.to_numpy(zero_copy_only=False) for c in cols], 1) if b.num_rows else np.zeros((0, len(cols)))
            missing = np.isnan(m[:, : len(own.inputs)]).any(1)
            got = function(own, np.where(np.isnan(m), 0 if not own.categories else np.where(np.arange(m.shape[1]) < len(own.inputs), 0, np.nan), m))
            rows = [None if gone else v for v, gone in zip(got.tolist(), missing, strict=True)]
            yield b.append_column(name, pa.array(rows, arrow))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def _codes(df: DataFrame, category: str, most: int) -> np.ndarray:
    counts = df.where(F.col(category).isNotNull()).groupBy(F.col(category).cast("bigint").alias("v")).agg(F.count("*").alias("n"))
    return np.array(sorted(r.v for r in counts.orderBy(F.desc("n"), "v").limit(most).collect()), float)  # max_codes rows at most


def fit(df: DataFrame, inputs: list[str], categories: list[str], y: str, size: int = 2, layers: tuple[int, ...] = (16, 16), steps: int = 200,
        rate: float = 0.02, patience: int = 40, max_codes: int = MAX_CODES, seed: int = 0) -> Plrm:
    """Fit on all rows without a null number; `size` is the length of a category's vector."""
    used = df.select(*[F.col(c).cast("double").alias(c) for c in inputs], *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in categories], F.col(y).cast("double").alias(y)).dropna(subset=[*inputs, y])
    codes = {c: _codes(used.where(~F.isnan(c)), c, max_codes) for c in categories}
    # the shared vector's code stands for missing values too, as dropna takes no part for them
    rows = Points(used.select(*inputs, *[F.when(F.isnan(c), F.lit(2.0**62)).otherwise(F.col(c)).alias(c) for c in categories], y), [*inputs, *categories], y)
    mean, var, y_mean, y_var = rows.moments()
    d = len(inputs)
    deviation = lambda v: np.where(v == 0, 1, np.sqrt(v))
    rng = np.random.default_rng(seed)
    p: dict[str, np.ndarray] = {}
    for k, c in enumerate(categories):
        v = rng.standard_normal((len(codes[c]) + 1, size))
        p[f"e{k}"] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    widths = [d + size * len(categories), *layers, 1]
    for i, (a, b) in enumerate(zip(widths, widths[1:], strict=False)):
        p[f"w{i}"] = rng.standard_normal((a, b)) * np.sqrt(2 / a)
        p[f"s{i}"] = np.linspace(-1, 1, b) if i + 1 < len(widths) - 1 else np.zeros(b)
    model = Plrm(list(inputs), list(categories), codes, p, {"mean": mean[:d], "scale": deviation(var[:d]), "y_mean": y_mean, "y_scale": float(deviation(np.array(y_var)))})
    names = sorted(p)
    m, v = {k: np.zeros_like(p[k]) for k in names}, {k: np.zeros_like(p[k]) for k in names}
    factor, before, best, since, first = 1.0, np.inf, (np.inf, None), 0, True
    for step in range(1, steps + 1):
        def part(x, t, n, own=model):
            error, slopes = own.loss(x, t, n)
            return [np.array(error), *[slopes[k] for k in names]]

        error, *slopes = (a / rows.n for a in rows.sums(part))
        error = float(error) + rows.within / model.scaling["y_scale"] ** 2 / rows.n
        model.errors.append(error)
        if error < best[0]:
            best, since = (error, {k: model.parameters[k].copy() for k in names}), 0
        else:
            since += 1
            if since > patience:
                break
        if not first:
            factor = min(4.0, factor * 1.05) if error < before else max(0.05, factor * 0.7)
        before, first = error, False
        for k, g in zip(names, slopes, strict=True):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            model.parameters[k] = model.parameters[k] - rate * factor * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-9)
    model.parameters = best[1]
    return model
