"""Encoding mixed tables as numbers and back: statistics, simplex codes, scaling, principal components."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OVERFLOW = "__other__"


def regular_simplex(categories: int) -> list[list[float]]:
    """Points of a regular simplex with unit edges: `categories` points in one dimension less; 2 give 0 and 1."""
    n = categories
    if n <= 1:
        return [[]] * n
    pts = [[0.0] * (n - 1)]
    for k in range(1, n):
        centre = [sum(p[j] for p in pts) / k for j in range(n - 1)]
        height = math.sqrt(max(0.0, 1 - sum((a - b) ** 2 for a, b in zip(pts[0], centre, strict=True))))
        new = list(centre)
        new[k - 1] += height
        pts.append(new)
    return pts


def category_weights(point: Column, codes: list[list[float]]) -> Column:
    """Affine weights of a point among the simplex's corners, by the constant inverse of the corner matrix."""
    n = len(codes)
    a = np.vstack([np.array(codes).T.reshape(n - 1, n), np.ones(n)])
    inv = np.linalg.inv(a)
    full = F.concat(point, F.array(F.lit(1.0)))
    return F.array(*[F.aggregate(F.zip_with(full, F.array(*[F.lit(float(v)) for v in row]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for row in inv])


def encode_stats(df: DataFrame, max_categories: int | None = None, order: str | None = None) -> DataFrame:
    """(column, kind, value, rank, n, mean): numeric columns' means; categories by frequency, ties by first occurrence (or value)."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != order]
    others = [c for c in df.columns if c not in numeric and c != order]
    out = None
    if numeric:
        one = df.agg(*[F.avg(c).alias(c) for c in numeric], *[F.count_distinct(c).alias(f"d_{c}") for c in numeric])
        out = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit("number").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(0).alias("rank"), F.col(f"d_{c}").alias("n"), F.col(c).cast("double").alias("mean")) for c in numeric])))
    if others:
        first = F.min(order) if order else F.lit(0)
        cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in others]))
        long = df.select(*([order] if order else []), cells)
        n = long.groupBy("column", "value").agg(F.count("*").alias("n"), first.alias("first"))
        rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "first", "value")) - 1
        cats = n.select("column", F.lit("category").alias("kind"), "value", rank.alias("rank"), "n", F.lit(None).cast("double").alias("mean"))
        if max_categories is not None:
            cats = cats.where(F.col("rank") < max_categories)
        out = cats if out is None else out.unionByName(cats)
    return out


@dataclass
class NumericEncoding:
    """How a table became numbers: per column its kind, mean or codes; enough to go back."""

    columns: list[str]
    kinds: dict[str, str]
    means: dict[str, float] = field(default_factory=dict)
    constants: dict[str, object] = field(default_factory=dict)
    categories: dict[str, list] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, max_categories: int = 100, order: str | None = None) -> NumericEncoding:
        """Learn from one pass per kind; a category beyond `max_categories` shares the code of an overflow category."""
        cols = [c for c in df.columns if c != order]
        kinds, enc = {}, cls(cols, {})
        numeric = [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]
        if numeric:
            one = df.agg(*[F.avg(c).alias(f"a_{c}") for c in numeric], *[F.min(c).alias(f"l_{c}") for c in numeric], *[F.max(c).alias(f"h_{c}") for c in numeric], *[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in numeric]).first()
            for c in numeric:
                if one[f"l_{c}"] == one[f"h_{c}"] and not one[f"m_{c}"]:
                    kinds[c], enc.constants[c] = "constant", one[f"l_{c}"]
                else:
                    kinds[c], enc.means[c] = ("int" if isinstance(df.schema[c].dataType, T.IntegralType) else "float"), one[f"a_{c}"]
        cats = [c for c in cols if c not in numeric]
        if cats:
            stats = encode_stats(df.select(*cats, *([order] if order else [])), max_categories + 1, order)
            rows: dict[str, list] = {c: [] for c in cats}
            for r in stats.orderBy("column", "rank").collect():  # at most max_categories + 1 values a column
                rows[r.column].append(r.value)
            for c in cats:
                vals = rows[c]
                if len(vals) <= 1:
                    kinds[c], enc.constants[c] = "constant", vals[0] if vals else None
                else:
                    kinds[c] = "category"
                    enc.categories[c] = vals if len(vals) <= max_categories else [*vals[: max_categories - 1], OVERFLOW]
        enc.kinds = kinds
        return enc

    def names(self) -> list[str]:
        out = []
        for c in self.columns:
            if self.kinds[c] in ("int", "float"):
                out.append(c)
            elif self.kinds[c] == "category":
                out += [f"{c}-{i + 1}" for i in range(len(self.categories[c]) - 1)]
        return out

    def to_matrix(self, df: DataFrame, name: str = "vector") -> DataFrame:
        """Add the row as array<double>: numbers (null: mean), categories as simplex corners, constants left out."""
        parts = []
        for c in self.columns:
            if self.kinds[c] in ("int", "float"):
                parts.append(F.array(F.coalesce(F.col(c).cast("double"), F.lit(float(self.means[c])))))
            elif self.kinds[c] == "category":
                vals, codes = self.categories[c], regular_simplex(len(self.categories[c]))
                expr = F.array(*[F.lit(x) for x in codes[-1]]) if vals[-1] == OVERFLOW else F.lit(None).cast("array<double>")
                for v, code in reversed(list(zip(vals, codes, strict=True))):
                    if v != OVERFLOW:
                        expr = F.when(F.col(c).cast("string").eqNullSafe(F.lit(v)), F.array(*[F.lit(x) for x in code])).otherwise(expr)
                parts.append(expr)
        return df.withColumn(name, F.concat(*parts) if parts else F.array().cast("array<double>"))

    def from_matrix(self, df: DataFrame, vector: str = "vector") -> DataFrame:
        """Add the columns again: whole numbers rounded half to even, categories by nearest corner, constants restored."""
        at, out = 0, {}
        for c in self.columns:
            kind = self.kinds[c]
            if kind == "constant":
                out[c] = F.lit(self.constants[c])
            elif kind in ("int", "float"):
                v = F.get(F.col(vector), F.lit(at))
                out[c] = F.bround(v, 0).cast("bigint") if kind == "int" else v
                at += 1
            else:
                vals, codes = self.categories[c], regular_simplex(len(self.categories[c]))
                own = F.slice(F.col(vector), at + 1, len(vals) - 1)
                far = lambda code, own=own: F.aggregate(F.zip_with(own, F.array(*[F.lit(x) for x in code]), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
                best = F.array_min(F.array(*[F.struct(far(code).alias("d"), F.lit(i).alias("i")) for i, code in enumerate(codes)]))
                out[c] = F.get(F.array(*[F.lit(v).cast("string") for v in vals]), best["i"])
                at += len(vals) - 1
        return df.withColumns(out)


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, shift, scale) so that (x - shift) / scale is in [0, 1]."""
    one = df.agg(*[F.min(c).alias(f"l_{c}") for c in columns], *[F.max(c).alias(f"h_{c}") for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"l_{c}").cast("double").alias("shift"), (F.col(f"h_{c}") - F.col(f"l_{c}")).cast("double").alias("scale")) for c in columns])))


def min_max_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*[F.min(c).alias(f"_l_{c}") for c in columns], *[F.max(c).alias(f"_h_{c}") for c in columns])
    scaled = {c: F.when(F.col(f"_h_{c}") == F.col(f"_l_{c}"), F.lit(0.0)).otherwise((F.col(c) - F.col(f"_l_{c}")) / (F.col(f"_h_{c}") - F.col(f"_l_{c}"))) for c in columns}
    return df.crossJoin(F.broadcast(one)).withColumns(scaled).select(*df.columns)  # one row


def normalized(df: DataFrame, columns: list[str], by: str = "deviation") -> DataFrame:
    """Less the mean, over the population deviation or variance (0 counts as 1)."""
    f = F.stddev_pop if by == "deviation" else F.var_pop
    one = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[f(c).alias(f"_s_{c}") for c in columns])
    made = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(one)).withColumns(made).select(*df.columns)  # one row


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    return df.crossJoin(F.broadcast(one)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in columns}).select(*df.columns)  # one row


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of the row's JSON, a null cell counted."""
    return F.sha2(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}), 256)


def product(column: str) -> Column:
    return F.product(column)


#: Up to so many columns their products are expressions of one aggregate; more would be thousands of expressions.
FEW_COLUMNS = 8


def second_moments(df: DataFrame, columns: list[str], centred: bool) -> np.ndarray:
    """Mean products of columns, of differences from their means if `centred`; rows with a null are left out.

    One aggregate of a few columns, else sums of matrices of batches; what comes to the driver has a number for each pair.
    """
    d = len(columns)
    if d > FEW_COLUMNS:
        from .models import Rows

        rows = Rows(df, columns, columns[0])
        mean = rows.moments()[0] if centred else np.zeros(d)
        return rows.sums(lambda x, _: [(x - mean).T @ (x - mean)])[0] / rows.n
    pair = F.covar_pop if centred else lambda a, b: F.avg(F.col(a) * F.col(b))
    one = df.dropna(subset=columns).agg(*[pair(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns[: i + 1])]).first()
    return np.array([[one[f"c{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(d)] for i in range(d)])


def covariance(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Population covariance matrix."""
    return second_moments(df, columns, True)


def pca(df: DataFrame, columns: list[str], n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(components as rows, singular values over their sum); a component's first entry that is not 0 is positive."""
    values, vectors = np.linalg.eigh(covariance(df, columns))
    order = np.argsort(-values)[: n or len(columns)]
    comps = vectors[:, order].T
    for c in comps:
        c *= -1 if c[np.flatnonzero(np.abs(c) > 1e-12)[:1]].sum() < 0 else 1
    size = np.sqrt(np.maximum(values, 0))
    return comps, size[order] / max(size.sum(), 1e-300)


def project(df: DataFrame, columns: list[str], matrix: np.ndarray, prefix: str = "pc") -> DataFrame:
    """Add one column for each row of a matrix: the row times the columns. Many weights are multiplied in batches, not as expressions."""
    if matrix.size <= FEW_COLUMNS**2:
        made = {f"{prefix}{i + 1}": sum((F.col(c) * float(w) for c, w in list(zip(columns, row, strict=True))[1:]), F.col(columns[0]) * float(row[0])) for i, row in enumerate(matrix)}
        return df.withColumns(made)
    names = [f"{prefix}{i + 1}" for i in range(len(matrix))]
    df = df.drop(*names)
    turned = np.ascontiguousarray(matrix.T)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.stack([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], 1) @ turned
                for i, name in enumerate(names):
                    b = b.append_column(name, pa.array(x[:, i], pa.float64(), from_pandas=True))
                yield b

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)]))


def metric_pca(df: DataFrame, key: str, columns: list[str], value: str, count: int = 1000, n: int | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Principal directions along which the response changes: PCA of random between-vectors scaled by the response's change."""
    from .sampling import metric_pairs

    vec = df.select(key, F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"), value)
    pairs = metric_pairs(vec, key, "_x", value, count, 2.0, seed)
    flat = pairs.select(*[F.col("direction")[i].alias(f"d{i}") for i in range(len(columns))])
    # directions have no sign: second moments about 0
    d = len(columns)
    m = second_moments(flat, flat.columns, False)
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(-values)[: n or d]
    comps = vectors[:, order].T
    for c in comps:
        c *= -1 if c[np.flatnonzero(np.abs(c) > 1e-12)[:1]].sum() < 0 else 1
    size = np.sqrt(np.maximum(values, 0))
    return comps, size[order] / max(size.sum(), 1e-300)


def conditioned(df: DataFrame, columns: list[str], method: str = "PCA", key: str | None = None, value: str | None = None, dim: int | None = None, scale: bool = True) -> DataFrame:
    """Inputs in the coordinates of PCA or metric PCA (MPCA), scaled by the components' weights; other methods are refused.

    Coordinates that a network learns are those of plrm.states.
    """
    if method not in ("PCA", "MPCA"):
        raise ValueError(f"no such conditioning: {method}")
    comps, weights = pca(df, columns, dim) if method == "PCA" else metric_pca(df, key, columns, value, n=dim)
    return project(df, columns, comps * (weights[:, None] if scale else 1.0))


def polynomial_terms(columns: list[str], degree: int) -> list[tuple[str, Column]]:
    """All monomials up to a degree, the constant first: (name, expression)."""
    from itertools import combinations_with_replacement

    out = [("1", F.lit(1.0))]
    for k in range(1, degree + 1):
        for combo in combinations_with_replacement(columns, k):
            expr = F.col(combo[0]).cast("double")
            for c in combo[1:]:
                expr = expr * F.col(c)
            out.append(("*".join(combo), expr))
    return out


def integer_embedding(column: str, codes: dict[int, list[float]], size: int) -> Column:
    """The vector of an integer category from a table; unknown ones are zero."""
    expr = F.array(*[F.lit(0.0)] * size)
    for k, v in codes.items():
        expr = F.when(F.col(column) == k, F.array(*[F.lit(float(x)) for x in v])).otherwise(expr)
    return expr
