"""Polynomials through well-placed rows: as many rows as terms are chosen out of a whole table, and the polynomial meets each of them.

Rows are chosen by pivoting: each next one is the row whose terms reach farthest out of the span of those chosen. No task sees all
rows, so it is a tournament: every task chooses among its rows, winners of several tasks meet in the next round, and
the last ones are chosen among at most the square root of the tasks times the number of terms.

Inputs are scaled to [-1, 1] and terms are products of Chebyshev polynomials, which keeps the matrix of the chosen rows well
conditioned. Defined cases: rows with a null do not take part; of equal rows the one with the least response is chosen; a table
with fewer distinct rows than terms gives the polynomial of least coefficients through them; an empty table is an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def degrees(inputs: int, degree: int) -> list[tuple[int, ...]]:
    """Exponents of all terms up to a total degree."""
    return sorted((e for e in product(range(degree + 1), repeat=inputs) if sum(e) <= degree), key=lambda e: (sum(e), e))


def terms_of(x: np.ndarray, low: np.ndarray, high: np.ndarray, exponents: list[tuple[int, ...]]) -> np.ndarray:
    z = 2 * (x - low) / np.where(high > low, high - low, 1) - 1
    most = max((max(e) for e in exponents), default=0)
    t = [np.ones_like(z), z]
    for _ in range(2, most + 1):
        t.append(2 * z * t[-1] - t[-2])
    return np.stack([np.prod([t[k][:, j] for j, k in enumerate(e)], axis=0) for e in exponents], 1)


def chosen(v: np.ndarray, most: int) -> list[int]:
    """Places of up to `most` rows: each the one farthest from the span of those before it."""
    left, found = v.copy(), []
    size = np.abs(v).max(initial=0.0)
    for _ in range(min(most, len(v))):
        norm = (left * left).sum(1)
        norm[found] = -1
        i = int(norm.argmax())
        if norm[i] <= (1e-12 * size) ** 2:
            break
        found.append(i)
        way = left[i] / math.sqrt(norm[i])
        left = left - np.outer(left @ way, way)
    return found


@dataclass
class Vandermonde:
    """Coefficients of Chebyshev terms on scaled inputs, and the rows that the polynomial goes through."""

    inputs: list[str]
    exponents: list[tuple[int, ...]]
    low: np.ndarray
    high: np.ndarray
    coefficients: np.ndarray
    points: np.ndarray

    def expression(self) -> Column:
        most = max(max(e) for e in self.exponents)
        cheb: list[list[Column]] = []
        for c, lo, hi in zip(self.inputs, self.low.tolist(), self.high.tolist(), strict=True):
            z = (F.col(c).cast("double") - lo) * (2 / (hi - lo if hi > lo else 1)) - 1
            t = [F.lit(1.0), z]
            for _ in range(2, most + 1):
                t.append(2 * z * t[-1] - t[-2])
            cheb.append(t)
        total = F.lit(0.0)
        for e, w in zip(self.exponents, self.coefficients.tolist(), strict=True):
            piece = F.lit(w)
            for j, k in enumerate(e):
                if k:
                    piece = piece * cheb[j][k]
            total = total + piece
        return total

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.expression())


def fit(df: DataFrame, inputs: list[str], y: str, degree: int = 2) -> Vandermonde:
    exponents = degrees(len(inputs), degree)
    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(inputs)], F.col(y).cast("double").alias("y")).dropna()
    ends = rows.agg(*[f(f"x{i}").alias(f"{n}{i}") for i in range(len(inputs)) for n, f in (("low", F.min), ("high", F.max))]).first()
    if ends.low0 is None:
        raise ValueError("no row without nulls to fit on")
    low, high = (np.array([ends[f"{n}{i}"] for i in range(len(inputs))]) for n in ("low", "high"))
    most = len(exponents)

    names = rows.columns

    def winners(m: np.ndarray) -> np.ndarray:
        m = m[np.lexsort(m.T[::-1])]
        keep = chosen(terms_of(m[:, :-1], low, high, exponents), most)
        return m[sorted(keep)]

    def play(batches):
        best = None
        for b in batches:
            if b.num_rows:
                m = np.stack([c.to_numpy() for c in b.columns], 1)
                best = winners(m if best is None else np.concatenate([best, m]))
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.T], names=names)

    first = rows.mapInArrow(play, rows.schema)
    second = first.repartition(max(1, math.isqrt(rows.rdd.getNumPartitions()))).mapInArrow(play, rows.schema)
    got = np.array([tuple(r) for r in second.collect()], float)  # a few times as many rows as there are terms
    points = winners(got)
    v = terms_of(points[:, :-1], low, high, exponents)
    w = np.linalg.lstsq(v, points[:, -1], rcond=1e-13)[0]
    return Vandermonde(list(inputs), exponents, low, high, w, points)
