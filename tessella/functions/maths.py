"""Scalar functions as column expressions, and exact arithmetic on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient, exact up to 38 digits."""
    dec = "decimal(38,0)"
    kk = F.least(k, n - k)
    steps = F.when(kk < 1, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("bigint"), kk.cast("bigint")))
    # each partial product is itself a binomial coefficient, so the division is exact
    got = F.aggregate(steps, F.lit(1).cast(dec), lambda a, i: F.floor((a * (n.cast("bigint") - kk.cast("bigint") + i).cast("decimal(19,0)")).cast(dec) / i.cast(dec)).cast(dec))
    return F.when((k < 0) | (k > n), F.lit(0).cast(dec)).otherwise(got)


def pick(samples: Column, n: Column) -> Column:
    """Chance that one of `samples` draws without replacement out of n is a given one: samples / n, telescoped."""
    steps = F.when(samples < 1, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(0).cast("bigint"), samples.cast("bigint") - 1))
    return 1 - F.aggregate(steps, F.lit(1.0), lambda a, i: a * (n - i - 1).cast("double") / (n - i).cast("double"))


def is_prime(n: Column) -> Column:
    """No divisor up to the root; 0 and 1 count as prime."""
    root = F.floor(F.sqrt(n.cast("double"))).cast("bigint")
    return F.when(n < 4, F.lit(True)).otherwise(~F.exists(F.sequence(F.lit(2).cast("bigint"), F.greatest(root, F.lit(2).cast("bigint"))), lambda i: n % i == 0))


def prime_factors(n: Column) -> Column:
    """Prime factors with multiplicity, ascending; meant for numbers up to about 10**6."""
    root = F.floor(F.sqrt(n.cast("double"))).cast("bigint")
    small = F.filter(F.sequence(F.lit(2).cast("bigint"), F.greatest(root, F.lit(2).cast("bigint"))), lambda i: (n % i == 0) & (i < n))
    many = F.flatten(F.transform(small, lambda i: F.array_repeat(i, 40)))
    state = F.struct(n.cast("bigint").alias("rest"), F.array().cast("array<bigint>").alias("out"))
    done = F.aggregate(many, state, lambda s, p: F.struct(F.when(s["rest"] % p == 0, F.expr("0") + (s["rest"] / p).cast("bigint")).otherwise(s["rest"]).alias("rest"), F.when(s["rest"] % p == 0, F.concat(s["out"], F.array(p))).otherwise(s["out"]).alias("out")))
    return F.when(n < 2, F.array().cast("array<bigint>")).otherwise(F.when(done["rest"] > 1, F.concat(done["out"], F.array(done["rest"]))).otherwise(done["out"]))


def primes_up_to(spark: SparkSession, n: int) -> DataFrame:
    """(prime); 1 is in the list."""
    return spark.range(1, n + 1).where(is_prime(F.col("id"))).select(F.col("id").alias("prime"))


def oom_error(x: Column, y: Column) -> Column:
    """Orders of magnitude (base 2) between two numbers; 0 for equal ones."""
    return F.when(x == y, F.lit(0.0)).when((x == 0) | (y == 0), F.lit(float("inf"))).otherwise(F.abs(F.log2(F.abs(x / y))))


def bit_accuracy(x: Column, y: Column) -> Column:
    """Bits that x and y agree in: -log2 of the orders of magnitude between them, infinite for equal ones."""
    return F.when(x == y, F.lit(float("inf"))).otherwise(-F.log2(oom_error(x, y)))


def abs_diff(x: Column, y: Column, kind: str = "number") -> Column:
    """|x - y| of numbers, the 1-norm for arrays, 1 if equal for other values."""
    if kind == "number":
        return F.abs(x - y)
    if kind == "vector":
        return F.aggregate(F.zip_with(x, y, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v)
    return x.eqNullSafe(y).cast("int")


def root(base: Column, power: Column) -> Column:
    return F.pow(base.cast("double"), 1 / power.cast("double"))


def erf(x: Column, terms: int = 120) -> Column:
    """The error function to full precision: a series of positive terms up to |x| = 6, beyond which it is 1 or -1."""
    z = F.least(F.abs(x.cast("double")), F.lit(6.0))
    start = F.struct(z.alias("total"), z.alias("term"))
    # the n-th term is the one before times 2 z^2 / (2 n + 1)
    done = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, lambda s, n: F.struct((s["total"] + s["term"] * 2 * z * z / (2 * n + 1)).alias("total"), (s["term"] * 2 * z * z / (2 * n + 1)).alias("term")))
    return F.when(F.abs(x) >= 6, F.signum(x)).otherwise(F.signum(x) * done["total"] * F.exp(-z * z) * (2 / math.sqrt(math.pi)))


def product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1.0), lambda a, x: a * x.cast("double"))


def chebyshev(spark: SparkSession, n: int) -> DataFrame:
    """(place, x): n Chebyshev nodes in [0, 1]."""
    return spark.range(n).select(F.col("id").alias("place"), ((1 - F.cos((2 * F.col("id") + 1) * math.pi / (2 * n))) / 2).alias("x"))


def chebyshev_mesh(spark: SparkSession, n: int, d: int) -> DataFrame:
    from tessella.operators.joins import mesh

    return mesh(spark, [[(1 - math.cos((2 * i + 1) * math.pi / (2 * n))) / 2 for i in range(n)]] * d)


def polar_mesh(spark: SparkSession, n: int) -> DataFrame:
    """Weakly admissible mesh of the disc in the unit box: the centre and n - 1 rings of 2 n + 1 angles, radii (1 + cos(pi j / n)) / 2."""
    rings = spark.range(1, max(1, n)).select(((1 + F.cos(F.col("id") * math.pi / n)) / 2).alias("r"))
    turns = spark.range(2 * n + 1).select((F.col("id") * (2 * math.pi) / (2 * n + 1)).alias("a"))
    # both sides are as small as the mesh that is asked for
    points = rings.crossJoin(turns).select((F.col("r") * F.cos("a")).alias("x0"), (F.col("r") * F.sin("a")).alias("x1"))
    centre = spark.range(1).select(F.lit(0.0).alias("x0"), F.lit(0.0).alias("x1"))
    return centre.unionByName(points).select(((F.col("x0") + 1) / 2).alias("x0"), ((F.col("x1") + 1) / 2).alias("x1"))


def box_mesh_nodes(spark: SparkSession, n: int) -> DataFrame:
    """Weakly admissible mesh of the unit square: n + 1 nodes (1 + cos(pi j / n)) / 2 crossed."""
    one = spark.range(n + 1).select(((1 + F.cos(F.col("id") * math.pi / n)) / 2).alias("x"))
    return one.select(F.col("x").alias("x0")).crossJoin(one.select(F.col("x").alias("x1")))


def regular_simplex_points(d: int, volume: float = 1.0) -> list[list[float]]:
    """Corners of a regular simplex of a volume in d dimensions, centred at the origin."""
    from tessella.operators.encoding import regular_simplex

    pts = regular_simplex(d + 1)
    centre = [sum(p[j] for p in pts) / (d + 1) for j in range(d)]
    own = math.sqrt((d + 1) / 2**d) / math.factorial(d)
    k = (volume / own) ** (1 / d)
    return [[(a - c) * k for a, c in zip(p, centre, strict=True)] for p in pts]


def fekete_points(points: Sequence[Sequence[float]], count: int, degree: int) -> list[int]:
    """Places of `count` nearly optimal interpolation points: column-pivoted orthogonalisation of the polynomial basis (small sets)."""
    from itertools import combinations_with_replacement

    import numpy as np

    x = np.asarray(points, float)
    terms = [c for k in range(degree + 1) for c in combinations_with_replacement(range(x.shape[1]), k)]
    v = np.stack([np.prod(x[:, list(t)], axis=1) if t else np.ones(len(x)) for t in terms])
    rest, out = v.copy(), []
    for _ in range(min(count, len(terms), len(x))):
        norms = (rest**2).sum(0)
        norms[out] = -1
        j = int(norms.argmax())
        if norms[j] <= 1e-24:
            break
        out.append(j)
        q = rest[:, j] / math.sqrt(norms[j])
        rest -= np.outer(q, q @ rest)
    return out


# Test functions on arrays -------------------------------------------------------------------------

def _fold(x: Column, f) -> Column:
    return F.aggregate(F.transform(x, f), F.lit(0.0), lambda a, v: a + v)


def cosine_norm(x: Column, radius: float = 1.0, peaks: int = 2, power: float = 1.0) -> Column:
    """cos(|x / radius| ** power * (2 peaks - 1) * pi): `peaks` tops between the middle and the radius."""
    return F.cos(F.pow(F.sqrt(_fold(x, lambda v: (v / radius) * (v / radius))), F.lit(float(power))) * (max(0, 2 * peaks - 1) * math.pi))


def _share(value: Column, x: Column, top: float) -> Column:
    """A sum over coordinates as a share of the greatest that [-1, 1] allows."""
    return value / (F.size(x) * F.lit(float(top)))


def steep(x: Column, k: int = 2) -> Column:
    """Sum of |x| ** (2 k / (2 k - 1)): less than quadratic, suddenly steep beside the solution at 0 ("mejr")."""
    return _share(_fold(x, lambda v: F.pow(F.abs(v), F.lit(2 * k / (2 * k - 1)))), x, 1)


def basin(x: Column, k: int = 2) -> Column:
    """Sum of x ** (2 k): flat round the solution at 0."""
    return _share(_fold(x, lambda v: F.pow(v, F.lit(2.0 * k))), x, 1)


def saddle(x: Column, s: float = 0.75) -> Column:
    """Saddle points at +-s, solution at 0; scaled by its value at 1 for s = 0.75."""
    return _share(_fold(x, lambda v: s**4 * v * v / 2 - s**2 * F.pow(v, F.lit(4.0)) / 2 + F.pow(v, F.lit(6.0)) / 6), x, 1 / 6 - 0.75**2 / 2 + 0.75**4 / 2)


def many_minima(x: Column, m: int = 3, a: float = 2.0) -> Column:
    """The Chebyshev polynomial of degree 2 m, which has m minima on either side, over a quadratic; solution at 0 ("multimin")."""
    def one(v):
        before, now = F.lit(1.0), v
        for _ in range(2, 2 * m + 1):
            before, now = now, 2 * v * now - before
        return 1 + a * v * v + now

    return _share(_fold(x, one), x, 4)


def weierstrass(x: Column, k: int = 10, a: float = 0.5, b: int = 3) -> Column:
    """k + 1 terms of a function that is nowhere differentiable in the limit, moved so that its solution is 0."""
    terms = [(a**i, math.pi * b**i) for i in range(k + 1)]
    rest = sum(w * math.cos(t) for w, t in terms)
    return _share(_fold(x, lambda v: sum((w * F.cos(t * (v + 1)) for w, t in terms), F.lit(-rest))), x, 3.998046875)


def skewed(x: Column, power: float = 2.0) -> Column:
    return F.transform(x, lambda v: F.signum(v) * F.pow(F.abs(v), F.lit(power)))


def recentred(x: Column, centre: Sequence[float]) -> Column:
    return F.zip_with(x, F.array(*[F.lit(float(c)) for c in centre]), lambda a, b: a - b)


def rotated(x: Column, matrix: Sequence[Sequence[float]]) -> Column:
    return F.array(*[F.aggregate(F.zip_with(x, F.array(*[F.lit(float(w)) for w in row]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for row in matrix])


def noisy(value: Column, key: Column, size: float = 0.1) -> Column:
    """A value with repeatable noise from a hash of the key."""
    return value + size * (F.pmod(F.xxhash64(key), F.lit(1 << 32)) / float(1 << 32) - 0.5)


def redistributed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every column replaced by the share of rows up to its value: uniform on each axis. Counted by value first."""
    from tessella.operators.distribution import cdf_points

    out = df
    for c in columns:
        pts = cdf_points(df, c, lead=False).select(F.col("x").alias(f"_x_{c}"), F.col("p").alias(f"_p_{c}"))
        out = out.join(pts, out[c].cast("double") == F.col(f"_x_{c}"), "left").withColumn(c, F.col(f"_p_{c}")).drop(f"_x_{c}", f"_p_{c}")
    return out


def resample(values: Column, n: int) -> Column:
    """n evenly spaced percentiles of an ascending array."""
    last = F.size(values) - 1
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("double") * last / max(1, n - 1))
    return F.transform(at, lambda p: F.get(values, F.floor(p).cast("int")) + (p - F.floor(p)) * (F.get(values, F.least(F.floor(p).cast("int") + 1, last)) - F.get(values, F.floor(p).cast("int"))))


# Rational numbers -----------------------------------------------------------------------------------

def fraction(num: Column, den: Column) -> Column:
    """struct(num, den) in lowest terms with den >= 0; x/0 is a signed infinity, 0/0 null. Exact for 18 digits."""
    a, b = num.cast("bigint"), den.cast("bigint")
    g = gcd(F.abs(a), F.abs(b))
    s = F.when(b < 0, -1).otherwise(1)
    quot = lambda x: F.call_function("div", x, g)
    return F.when((a == 0) & (b == 0), F.lit(None)).otherwise(F.struct((s * quot(a)).alias("num"), (s * quot(b)).alias("den")))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps, as many as 64-bit numbers can need."""
    start = F.struct(a.alias("x"), b.alias("y"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.nullif(s["y"], F.lit(0).cast("bigint"))).alias("y"))))
    return F.when(done["x"] == 0, F.lit(1).cast("bigint")).otherwise(done["x"])


def fraction_add(a: Column, b: Column) -> Column:
    return fraction(a["num"] * b["den"] + b["num"] * a["den"], a["den"] * b["den"])


def fraction_multiply(a: Column, b: Column) -> Column:
    return fraction(a["num"] * b["num"], a["den"] * b["den"])


def fraction_divide(a: Column, b: Column) -> Column:
    return fraction(a["num"] * b["den"], a["den"] * b["num"])


def fraction_value(a: Column) -> Column:
    return F.when(a["den"] == 0, F.signum(a["num"].cast("double")) * float("inf")).otherwise(a["num"].cast("double") / a["den"])


def exact(value: float | int | str) -> Fraction:
    """The driver's exact rational of a number."""
    return Fraction(value)


# Polynomials and splines ----------------------------------------------------------------------------

def horner(coefficients: Column, x: Column) -> Column:
    """Value of a polynomial, highest power first."""
    return F.aggregate(coefficients, F.lit(0.0), lambda a, c: a * x + c.cast("double"))


def derivative(coefficients: Column) -> Column:
    n = F.size(coefficients)
    return F.transform(F.slice(coefficients, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda c, i: c * (n - 1 - i))


def newton_polynomial(xs: Sequence[float], ys: Sequence[float]) -> list[float]:
    """Divided differences of the interpolating polynomial (driver)."""
    c = [float(y) for y in ys]
    for k in range(1, len(xs)):
        for i in range(len(xs) - 1, k - 1, -1):
            c[i] = (c[i] - c[i - 1]) / (xs[i] - xs[i - k])
    return c


def newton_value(xs: Sequence[float], c: Sequence[float], x: Column) -> Column:
    out = F.lit(float(c[-1]))
    for a, b in zip(reversed(list(xs)[: len(c) - 1]), reversed(list(c)[:-1]), strict=True):
        out = out * (x - float(a)) + float(b)
    return out


def spline_pieces(nodes: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(low, high, c3, c2, c1, c0) of a cubic between neighbours with slopes from local parabolas; c in powers of (x - low)."""
    from tessella.operators.ordered import scan

    n = nodes.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    n = scan(n, ["x"], lags={"px": F.col("x"), "py": F.col("y")})
    # the next node's values: lags in the opposite order
    ahead = scan(n.withColumn("o", -F.col("x")), ["o"], lags={"nx": F.col("x"), "ny": F.col("y")})
    back, fore = (F.col("y") - F.col("py")) / (F.col("x") - F.col("px")), (F.col("ny") - F.col("y")) / (F.col("nx") - F.col("x"))
    mid = (back * (F.col("nx") - F.col("x")) + fore * (F.col("x") - F.col("px"))) / (F.col("nx") - F.col("px"))
    n = scan(ahead.withColumn("m", F.coalesce(mid, fore, back, F.lit(0.0))), ["o"], lags={"nm": F.col("m")}).where("nx is not null")
    h, d = F.col("nx") - F.col("x"), (F.col("ny") - F.col("y")) / (F.col("nx") - F.col("x"))
    return n.select(F.col("x").alias("low"), F.col("nx").alias("high"), ((F.col("m") + F.col("nm") - 2 * d) / (h * h)).alias("c3"), ((3 * d - 2 * F.col("m") - F.col("nm")) / h).alias("c2"), F.col("m").alias("c1"), F.col("y").alias("c0"))


def spline_eval(at: DataFrame, pieces: DataFrame, column: str, name: str = "value") -> DataFrame:
    """Values of a spline; outside its nodes the end pieces go on. An as-of lookup as one union and one ordered scan."""
    from tessella.operators.ordered import scan

    p = pieces.select(F.col("low").alias("_x"), F.lit(0).alias("_k"), F.struct("low", "c3", "c2", "c1", "c0").alias("_p"))
    q = at.select(F.col(column).cast("double").alias("_x")).distinct().where("_x is not null").select("_x", F.lit(1).alias("_k"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"))
    got = scan(p.unionByName(q), ["_x", "_k"], lasts={"_a": F.col("_p")}, nexts={"_b": F.col("_p")}).where("_k = 1").withColumn("_u", F.coalesce("_a", "_b"))
    t = F.col("_x") - F.col("_u.low")
    got = got.select("_x", (((F.col("_u.c3") * t + F.col("_u.c2")) * t + F.col("_u.c1")) * t + F.col("_u.c0")).alias(name))
    return at.join(got, at[column].cast("double").eqNullSafe(got["_x"]), "left").drop("_x")


# Texts ----------------------------------------------------------------------------------------------

def simplified(value: Column, digits: int = 2) -> Column:
    """A number in scientific form without needless zeros in its exponent."""
    s = F.format_string(f"%.{digits}e", value.cast("double"))
    return F.regexp_replace(F.regexp_replace(s, "e\\+0*([0-9])", "e$1"), "e-0*([0-9])", "e-$1")


def split_quoted(line: Column, sep: str) -> Column:
    """Cells of a line; separators inside double quotes do not count, outer quotes go, cells are trimmed."""
    s = {"|": "\\|", ".": "\\.", "\t": "\\t", "+": "\\+", "*": "\\*", "^": "\\^", "$": "\\$", "?": "\\?"}.get(sep, sep)
    cells = F.split(line, f"{s}(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", -1)
    return F.transform(cells, lambda c: F.when(F.trim(c).rlike('^".*"$') & (F.length(F.trim(c)) > 1), F.regexp_replace(F.trim(c), '^"|"$', "")).otherwise(F.trim(c)))


def without_quoted(line: Column) -> Column:
    return F.regexp_replace(line, '"[^"]*"', "")
