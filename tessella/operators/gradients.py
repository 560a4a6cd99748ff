"""Gradients of predictions with respect to the inputs.

Polynomials differentiate as expressions. Models with arrays run backwards through their layers, hinges or features in
Arrow batches. Distance-weighted predictions use the quotient rule over the same sums that make the prediction.

Defined cases: at a kink (a ramp's zero, a hinge's knot) the slope of the flat side counts; at a point of a
distance-weighted model the gradient is zero, as its surface is level there; null inputs give null components
for polynomials and are an error for models with arrays, as in prediction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import inverse_terms, pair_sums
from .models import TINY, ArrayModel, LinearModel, _network_layers

VECTOR = T.ArrayType(T.DoubleType())


def polynomial_gradient(model: LinearModel, df: DataFrame, name: str = "gradient") -> DataFrame:
    """Add the partial derivatives of a linear or polynomial model, in the order of its inputs."""
    parts = []
    for own in model.inputs:
        total = F.lit(0.0)
        for term, c in zip(model.terms, model.coefficients, strict=True):
            factors = [] if term == "1" else term.split("*")
            power = factors.count(own)
            if not power:
                continue
            rest = list(factors)
            rest.remove(own)
            piece = F.lit(float(c) * power)
            for f in rest:
                piece = piece * F.col(f).cast("double")
            total = total + piece
        parts.append(total)
    return df.withColumn(name, F.array(*parts))


def _mars(p: dict, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for terms, w in zip(p["terms"], np.asarray(p["weights"])[1:], strict=True):
        hinge = [np.maximum(0, s * (x[:, int(j)] - k)) for j, k, s in terms]
        for i, (j, k, s) in enumerate(terms):
            slope = np.where(s * (x[:, int(j)] - k) > 0, s, 0.0)
            for o, h in enumerate(hinge):
                if o != i:
                    slope = slope * h
            out[:, int(j)] += w * slope
    return out


def _network(p: dict, x: np.ndarray) -> np.ndarray:
    layers = _network_layers(p, x)
    g = np.full((len(x), 1), float(p["y_scale"]))
    for i in reversed(range(len(layers) - 1)):
        g = g @ np.asarray(p[f"w{i}"]).T
        if i:
            g = g * (layers[i] > 0)
    return g / p["scale"]


def _svr(p: dict, x: np.ndarray) -> np.ndarray:
    z, w = (x - p["mean"]) / p["scale"], np.asarray(p["weights"])
    if p["basis"] == "rbf":
        freq = np.asarray(p["freq"])
        g = -np.sqrt(2.0 / len(p["shift"])) * (np.sin(z @ freq + p["shift"]) * w) @ freq.T
    else:
        d = z.shape[1]
        g = w[1: 1 + d] + 2 * z * w[1 + d: 1 + 2 * d] + 3 * z**2 * w[1 + 2 * d:]
    return g / p["scale"]


SLOPES = {"mars": _mars, "network": _network, "plrm": _network, "svr": _svr}


def array_gradient(model: ArrayModel, df: DataFrame, name: str = "gradient") -> DataFrame:
    """Add the partial derivatives of a MARS, network, piecewise-linear or support-vector model."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        for b in batches:
            x = np.stack([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in own.inputs], 1) if b.num_rows else np.zeros((0, len(own.inputs)))
            yield b.append_column(name, pa.array(list(SLOPES[own.kind](own.parameters, x)), pa.list_(pa.float64())))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, VECTOR)]))


def gradient(model: LinearModel | ArrayModel, df: DataFrame, name: str = "gradient") -> DataFrame:
    return polynomial_gradient(model, df, name) if isinstance(model, LinearModel) else array_gradient(model, df, name)


def shepard_gradient(queries: DataFrame, points: DataFrame, q_id: str, p_id: str, vec: str, y: str) -> DataFrame:
    """(query_id, prediction, gradient) of inverse squared distance weights.

    With f = sum(y w) / sum(w) and w = d**-2 the slope of w is -2 (q - x) w**2, so a component of the
    gradient is (sum(y w') - f sum(w')) / sum(w); the sums are taken over tiles of pairs.
    """
    q = queries.select(F.col(q_id).alias("query_id"), F.col(vec).alias("qv"))
    dims = q.agg(F.max(F.size("qv"))).first()[0] or 0

    split = inverse_terms(TINY)

    def terms(diff, away, own):
        w, both, hits = split(away, own)
        yield from (*(w @ both).T, *hits)
        w2 = w * w
        for k in range(dims):
            yield from -2 * ((diff(k) * w2) @ both).T

    got = pair_sums(q, points, "query_id", "qv", vec, [F.col(y), F.col(y).isNotNull().cast("double")], 4 + 2 * dims, terms)
    s, at = F.col("sums"), F.col("sums")[2] > 0
    w = F.nullif(s[0], F.lit(0.0))
    slopes = F.array(*[F.when(at, 0.0).otherwise((s[5 + 2 * k] - s[1] / w * s[4 + 2 * k]) / w) for k in range(dims)]).cast("array<double>")
    return got.where("sums is not null").select("query_id", F.when(at, s[3] / F.nullif(s[2], F.lit(0.0))).otherwise(s[1] / w).alias("prediction"), slopes.alias("gradient"))
