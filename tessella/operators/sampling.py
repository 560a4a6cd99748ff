"""Folds, samples, random designs, deterministic streams, sample-size arithmetic."""

from __future__ import annotations

import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import numbered

#: Multiplier of Knuth's multiplicative hash modulo 2**32.
SPREAD = 2654435761


def spread(key: Column, seed: int = 0) -> Column:
    """A hash that any engine can repeat: (key * 2654435761 + seed) mod 2**32."""
    return F.pmod(F.pmod(key.cast("decimal(20,0)") * SPREAD + seed, F.lit(2**32).cast("decimal(20,0)")), F.lit(2**32).cast("decimal(20,0)")).cast("bigint")


def k_fold(df: DataFrame, key: str, k: int = 10, seed: int = 0) -> DataFrame:
    """Add `fold`: rows shuffled by a hash of the key and cut at int(.5 + fold * n / k)."""
    shuffled = numbered(df.withColumn("_h", spread(F.col(key), seed)), ["_h", key], "_place")
    n = df.count()
    bounds = [int(0.5 + b * n / k) for b in range(k + 1)]
    fold = F.lit(k - 1)
    for b in range(k - 2, -1, -1):
        fold = F.when(F.col("_place") < bounds[b + 1], b).otherwise(fold)
    return shuffled.withColumn("fold", fold).drop("_h", "_place")


def fold_split(folded: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """(training rows, test rows) of a fold."""
    return folded.where(F.col("fold") != fold).drop("fold"), folded.where(F.col("fold") == fold).drop("fold")


def sample_rows(df: DataFrame, key: str, count: int, seed: int = 0) -> DataFrame:
    """Exactly `count` rows (or all), those of least hash: the same ones in every run and engine."""
    return df.withColumn("_h", spread(F.col(key), seed)).orderBy("_h", key).limit(count).drop("_h")


def random_range(spark: SparkSession, start: int, stop: int, step: int = 1, count: int | None = None, seed: int = 0) -> DataFrame:
    """(place, value): the numbers of a range in a random order without repetition, as many as asked for."""
    n = max(0, -(-(stop - start) // step))
    count = n if count is None else min(count, n)
    size = 1 << max(2, (max(1, n) - 1).bit_length())
    # a full-period linear congruential generator over the next power of two, any place of it by closed form
    got = spark.range(size).select("id", congruential(F.col("id"), seed % size, 4 * (seed % 97) + 5, 2 * (seed % 1009) + 1, size).alias("v")).where(F.col("v") < n)
    placed = numbered(got, ["id"], "place")
    return placed.where(F.col("place") < count).select("place", (F.col("v") * step + start).alias("value"))


def congruential(place: Column, value: int, multiplier: int, offset: int, modulus: int) -> Column:
    """The number `place` steps after `value` of the generator x -> (multiplier x + offset) mod `modulus`, a power of two up to 2**32.

    2**k steps are one step of another multiplier and offset; the bits of the place say which of them to take. Products are
    taken in two halves of the multiplier, so that they stay within 64 bits.
    """
    if modulus & (modulus - 1) or modulus > 1 << 32:
        raise ValueError("the modulus has to be a power of two up to 2**32")
    out, mult, add = F.lit(value % modulus).cast("bigint"), multiplier % modulus, offset % modulus
    m = F.lit(modulus).cast("bigint")
    steps = []
    for k in range(max(1, modulus.bit_length() - 1)):
        steps.append(F.struct(F.lit(1 << k).cast("bigint").alias("bit"), F.lit(mult >> 16).cast("bigint").alias("high"), F.lit(mult & 0xFFFF).cast("bigint").alias("low"), F.lit(add).cast("bigint").alias("add")))
        mult, add = mult * mult % modulus, (mult + 1) * add % modulus
    half = F.lit(1 << 16).cast("bigint")
    # in `aggregate` the state is one number; a place beyond the period wraps round
    return F.aggregate(F.array(*steps), out, lambda x, s: F.when(place.bitwiseAND(s["bit"]) == 0, x).otherwise((x * s["high"] % m * half + x * s["low"] + s["add"]) % m))


def uniform_stream(spark: SparkSession, count: int, value: int | None = None, offset: int = 4091, multiplier: int = 1048573, max_numbers: int = 2**32) -> DataFrame:
    """(place, u): a deterministic stream of numbers in [0, 1) that repeats none of `max_numbers`, computable from any place on.

    It starts at `value` (half of `max_numbers` without one); the generator's step is 4 * (max_numbers + multiplier) + 1, its
    increment 2 * offset + 1, its modulus the next power of two.
    """
    most = max(count, max_numbers)
    modulus = 1 << max(1, (most - 1).bit_length())
    start = most // 2 if value is None else value
    x = congruential(F.col("id"), start, 4 * (most + multiplier) + 1, 2 * offset + 1, modulus)
    return spark.range(count).select(F.col("id").alias("place"), (x / F.lit(float(modulus))).alias("u"))


def latin(spark: SparkSession, n: int, d: int, seed: int = 0) -> DataFrame:
    """n points, each coordinate a jittered permutation of the n cells of [0, 1)."""
    out = spark.range(n).select("id")
    for j in range(d):
        col = numbered(spark.range(n).select("id", F.xxhash64("id", F.lit(seed), F.lit(j)).alias("h")), ["h", "id"], "cell")
        jitter = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(j), F.lit(1)), F.lit(1 << 52)) / float(1 << 52)
        out = out.join(col.select("id", ((F.col("cell") + jitter) / n).alias(f"x{j}")), "id")
    return out


def ball(spark: SparkSession, n: int, d: int, radius: float = 1.0, seed: int = 0, surface: bool = False) -> DataFrame:
    """n points uniform in a ball (or on its surface): a normal direction and the d-th root of a uniform radius."""
    raw = spark.range(n).select("id", *[F.randn(seed + j).alias(f"g{j}") for j in range(d)], F.rand(seed + d).alias("u"))
    norm = F.sqrt(sum((F.col(f"g{j}") * F.col(f"g{j}") for j in range(1, d)), F.col("g0") * F.col("g0")))
    r = F.lit(radius) if surface else radius * F.pow("u", F.lit(1.0 / d))
    return raw.select("id", *[(F.col(f"g{j}") / norm * r).alias(f"x{j}") for j in range(d)])


def latin_sphere(spark: SparkSession, n: int, d: int, inside: bool = True, seed: int = 0) -> DataFrame:
    """Well-spread points in or on the unit sphere: Latin coordinates through the normal quantile, then scaled."""
    pts = latin(spark, n, d + 1, seed)
    def run(batches):
        from statistics import NormalDist

        inv = NormalDist().inv_cdf
        for b in batches:
            rows = []
            cols = [b.column(f"x{j}").to_pylist() for j in range(d + 1)]
            for i in range(b.num_rows):
                g = [inv(min(max(c[i], 1e-12), 1 - 1e-12)) for c in cols[:d]]
                size = math.sqrt(sum(x * x for x in g)) or 1.0
                r = cols[d][i] ** (1 / d) if inside else 1.0
                rows.append([x / size * r for x in g])
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array([r[j] for r in rows], pa.float64()) for j in range(d)]], names=["id", *[f"x{j}" for j in range(d)]])
    return pts.mapInArrow(run, "id long, " + ", ".join(f"x{j} double" for j in range(d)))


def random_cdf(nodes: int = 5, power: float = 1.0, seed: int = 0) -> list[tuple[float, float]]:
    """Nodes (x, p) of a random CDF on [0, 1]: sorted uniform places and cumulated powers of uniform steps."""
    import random

    rng = random.Random(seed)
    xs = sorted(rng.random() for _ in range(nodes))
    steps = [rng.random() ** power for _ in range(nodes + 1)]
    total, p, out = sum(steps), 0.0, [(0.0, 0.0)]
    for x, s in zip(xs, steps, strict=False):
        p += s / total
        out.append((x, p))
    return [*out, (1.0, 1.0)]


def test_corpus(df: DataFrame, inputs: list[str], output: str, splits: list[float], seeds: list[int]) -> DataFrame:
    """For every subset of the inputs: distinct points with mean response, marked train or test for each split and seed.

    Points extreme in an input are always training points, so that tests lie inside.
    """
    cube = df.cube(*inputs).agg(F.avg(output).alias(output), F.grouping_id().alias("subset")).where(F.col("subset") < 2 ** len(inputs) - 1)
    ends = cube.groupBy("subset").agg(*[f(c).alias(f"_{n}_{c}") for c in inputs for n, f in (("low", F.min), ("high", F.max))])  # a row a subset
    edge = F.lit(False)
    for c in inputs:
        edge = edge | F.coalesce((F.col(c) == F.col(f"_low_{c}")) | (F.col(c) == F.col(f"_high_{c}")), F.lit(False))
    marked = cube.join(F.broadcast(ends), "subset").select(*inputs, output, "subset", edge.alias("edge"))
    spec = F.array(*[F.struct(F.lit(float(s)).alias("split"), F.lit(int(r)).alias("seed")) for s in splits for r in seeds])
    many = marked.withColumn("_s", F.explode(spec)).select("*", "_s.split", "_s.seed").drop("_s")
    u = F.pmod(F.xxhash64(*inputs, "subset", "seed"), F.lit(1 << 32)) / float(1 << 32)
    return many.withColumn("part", F.when(F.col("edge") | (u < F.col("split")), "train").otherwise("test"))


def well_spaced(points: list[list[float]], count: int) -> list[int]:
    """Places of `count` points left after dropping one of the closest pair again and again (small sets)."""
    import numpy as np

    x = np.asarray(points, float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    alive = list(range(len(x)))
    while len(alive) > max(count, 1):
        sub = d[np.ix_(alive, alive)]
        i, j = np.unravel_index(int(sub.argmin()), sub.shape)
        drop = i if np.sort(sub[i])[1:2].sum() <= np.sort(sub[j])[1:2].sum() else j
        del alive[int(drop)]
    return alive[:count]


def binomial_confidence(n: int, error: Fraction, at: Fraction = Fraction(1, 2)) -> Fraction:
    """Least chance that the share seen in n draws is within `error` of `at`: an exact binomial sum."""
    low, high = math.ceil(n * (at - error)), math.floor(n * (at + error))
    p, q = at, 1 - at
    return sum((Fraction(math.comb(n, k)) * p**k * q ** (n - k) for k in range(max(0, low), min(n, high) + 1)), Fraction(0))


def samples(size: int | None = None, error: float | None = None, confidence: float | None = None, at: float = 0.5) -> float:
    """The missing one of sample size, error and confidence of an empirical CDF value, free of any distribution."""
    a = Fraction(at).limit_denominator(10**6)
    e = None if error is None else Fraction(error).limit_denominator(10**6)
    if confidence is None:
        return float(binomial_confidence(size, e, a))
    if size is None:
        n = 1
        while float(binomial_confidence(n, e, a)) < confidence:
            n *= 2
        low = n // 2
        while low + 1 < n:
            mid = (low + n) // 2
            low, n = (low, mid) if float(binomial_confidence(mid, e, a)) >= confidence else (mid, n)
        return n
    lo, hi = Fraction(0), Fraction(1)
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if float(binomial_confidence(size, mid, a)) >= confidence else (mid, hi)
    return float(hi)


def metric_pairs(df: DataFrame, key: str, vector: str, value: str, count: int, power: float = 1.0, seed: int = 0) -> DataFrame:
    """(a, b, direction): |value difference| * (x_a - x_b) / distance^power of `count` random pairs that differ.

    A pair is a row and the row that follows it in one of several hashed orders, so no pairs but those kept are made.
    """
    n = max(1, df.count())
    rounds = -(-count // n) + 1
    orders = df.select(F.col(key).alias("a"), F.col(vector).alias("xa"), F.col(value).alias("va")).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    numbered_ = numbered(orders.withColumn("h", F.xxhash64("a", "r", F.lit(seed))), ["r", "h", "a"], "i")
    nxt = numbered_.select((F.col("i") - 1).alias("i"), F.col("a").alias("b"), F.col("xa").alias("xb"), F.col("va").alias("vb"), F.col("r").alias("rb"))
    both = numbered_.join(nxt, "i").where((F.col("r") == F.col("rb")) & (F.col("a") != F.col("b")))
    diff = F.zip_with("xa", "xb", lambda x, y: x.cast("double") - y.cast("double"))
    norm = F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, x: s + x * x))
    gap = F.abs(F.col("va").cast("double") - F.col("vb").cast("double"))
    made = both.withColumn("d", diff).withColumn("norm", norm).withColumn("gap", gap).where("norm > 0 and gap > 0")
    return made.select("a", "b", F.transform("d", lambda x: x * F.col("gap") / F.pow("norm", F.lit(float(power)))).alias("direction"), "i").orderBy("i").limit(count).drop("i")
