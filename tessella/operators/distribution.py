"""Empirical distributions as node tables (x, p): building, evaluating, inverting, combining, smoothing, modes."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import scan

LEAD = 2.0 ** -26


def cdf_points(df: DataFrame, column: str, lead: bool = True) -> DataFrame:
    """(x, p): distinct values with the share of rows up to them, after a leading point (least - 2**-26, 0)."""
    v = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("c"))
    n = v.agg(F.sum("c").alias("n"), F.min("x").alias("low"))
    pts = scan(v, ["x"], sums={"upto": F.col("c")}).crossJoin(F.broadcast(n)).select("x", (F.col("upto") / F.col("n")).alias("p"))  # one row
    return pts.unionByName(n.where("low is not null").select((F.col("low") - LEAD).alias("x"), F.lit(0.0).alias("p"))) if lead else pts


def percentiles(df: DataFrame, column: str, percents: Sequence[float]) -> DataFrame:
    """(percent, value), linear between order statistics; exact."""
    got = df.agg(F.percentile(column, F.array(*[F.lit(p / 100) for p in percents])).alias("v"))
    return got.select(F.inline(F.arrays_zip(F.array(*[F.lit(float(p)) for p in percents]).alias("percent"), F.col("v").alias("value"))))


def approximate_percentiles(df: DataFrame, column: str, percents: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """The same with bounded memory and a bounded rank error."""
    got = df.agg(F.percentile_approx(column, F.array(*[F.lit(p / 100) for p in percents]), accuracy).alias("v"))
    return got.select(F.inline(F.arrays_zip(F.array(*[F.lit(float(p)) for p in percents]).alias("percent"), F.col("v").alias("value"))))


def interpolate(at: DataFrame, nodes: DataFrame, column: str, x: str = "x", y: str = "p", name: str = "value", below: float | None = 0.0, above: float | None = 1.0) -> DataFrame:
    """Add the piecewise-linear function of the nodes at each value: an as-of lookup as one union and one ordered scan.

    Outside the nodes the value is `below` or `above` (None: that of the nearest node).
    """
    pts = nodes.select(F.col(x).cast("double").alias("_x"), F.lit(0).alias("_k"), F.col(y).cast("double").alias("_y"))
    vals = at.select(F.col(column).cast("double").alias("_x")).distinct().where("_x is not null").select("_x", F.lit(1).alias("_k"), F.lit(None).cast("double").alias("_y"))
    nx, ny = F.when(F.col("_k") == 0, F.col("_x")), F.col("_y")
    # nodes stand before the values equal to them; the node after a value is the next one in the order
    both = scan(pts.unionByName(vals), ["_x", "_k"], lasts={"_x0": nx, "_y0": ny}, nexts={"_x1": nx, "_y1": ny}).where("_k = 1")
    x0, y0, x1, y1 = (F.col(c) for c in ("_x0", "_y0", "_x1", "_y1"))
    lo = y1 if below is None else F.lit(below)
    hi = y0 if above is None else F.lit(above)
    v = F.when(x0.isNull(), lo).when(x0 == F.col("_x"), y0).when(x1.isNull(), hi).otherwise(y0 + (y1 - y0) * (F.col("_x") - x0) / (x1 - x0))
    done = both.select("_x", v.alias("_v"))
    return at.join(done, at[column].cast("double").eqNullSafe(done["_x"]), "left").select(*at.columns, F.col("_v").alias(name))


def cdf_eval(at: DataFrame, nodes: DataFrame, column: str, name: str = "cdf") -> DataFrame:
    return interpolate(at, nodes, column, name=name)


def inverse_eval(at: DataFrame, nodes: DataFrame, column: str, name: str = "x") -> DataFrame:
    """The inverse of a CDF at probabilities; equal probabilities keep their least x."""
    one = nodes.groupBy("p").agg(F.min("x").alias("x"))
    return interpolate(at, one, column, "p", "x", name, None, None)


def inverse_sample(uniform: DataFrame, nodes: DataFrame, column: str, name: str = "x") -> DataFrame:
    """Samples of a distribution from uniform numbers."""
    return inverse_eval(uniform, nodes, column, name)


def density(nodes: DataFrame) -> DataFrame:
    """(low, high, slope) of the intervals between nodes."""
    n = scan(nodes.select("x", "p"), ["x"], lags={"low": F.col("x"), "q": F.col("p")}).where("low is not null")
    return n.select("low", F.col("x").alias("high"), ((F.col("p") - F.col("q")) / (F.col("x") - F.col("low"))).alias("slope"))


def combine(a: DataFrame, b: DataFrame, wa: float = 0.5, wb: float = 0.5) -> DataFrame:
    """Nodes of wa * A + wb * B on the union of their nodes."""
    xs = a.select("x").union(b.select("x")).distinct()
    both = interpolate(interpolate(xs, a, "x", name="pa"), b, "x", name="pb")
    return both.select("x", (F.col("pa") * wa + F.col("pb") * wb).alias("p"))


def distribution_ks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Greatest difference of two piecewise-linear CDFs; it lies at a node."""
    xs = a.select("x").union(b.select("x")).distinct()
    both = interpolate(interpolate(xs, a, "x", name="pa"), b, "x", name="pb")
    return both.agg(F.max(F.abs(F.col("pa") - F.col("pb"))).alias("ks"))


def gauss_smooth(at: DataFrame, nodes: DataFrame, column: str, deviation: float, n: int = 100, name: str = "smooth") -> DataFrame:
    """A CDF averaged with normal weights at n offsets within 5 deviations of each value."""
    spark = at.sparkSession
    step = 10.0 * deviation / (n - 1)
    offsets = spark.range(n).select((F.col("id") * step - 5 * deviation).alias("_o")).withColumn("_w", F.exp(-F.col("_o") * F.col("_o") / (2 * deviation * deviation)))
    points = at.select(F.col(column).alias("_c")).distinct().crossJoin(F.broadcast(offsets)).select("_c", "_w", (F.col("_c") + F.col("_o")).alias("_q"))
    got = interpolate(points, nodes, "_q", name="_v").groupBy("_c").agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias(name))
    return at.join(got, at[column].eqNullSafe(got["_c"]), "left").drop("_c")


#: Candidate breaks that come to the driver at a time.
BREAK_PAGE = 10_000


def _steps(nodes: DataFrame) -> DataFrame:
    """(x0, p0, x, p, s): steps between neighbouring values and their slopes; the leading point begins none."""
    n = scan(nodes.select(F.col("x").cast("double").alias("x"), F.col("p").cast("double").alias("p")), ["x"], lags={"x0": F.col("x"), "p0": F.col("p")})
    return n.where("p0 > 0").withColumn("s", (F.col("p") - F.col("p0")) / (F.col("x") - F.col("x0")))


def break_candidates(nodes: DataFrame) -> DataFrame:
    """(low, high, below, above) of each step of a CDF that is flatter than the steps beside it; its break is the middle."""
    n = _steps(nodes)
    n = scan(n, ["x"], lags={"before": F.col("s")})
    n = scan(n.withColumn("o", -F.col("x")), ["o"], lags={"after": F.col("s")})
    inner = n.where("s < before and s < after")
    return inner.select(F.col("x0").alias("low"), F.col("x").alias("high"), F.col("p0").alias("below"), F.col("p").alias("above"))


def chosen_breaks(candidates: list[tuple[float, float, float, float]], error: float, breaks: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """`breaks` (x, p) with those of the candidates, in their order, that leave `2 * error` of the mass on both sides of the interval they cut."""
    out = sorted(breaks)
    for low, high, below, above in candidates:
        x, p = (low + high) / 2, (below + above) / 2
        k = bisect_right(out, (x, p))
        if 0 < k < len(out) and min(out[k][1] - p, p - out[k - 1][1]) >= 2 * error:
            insort(out, (x, p))
    return out


def modes(nodes: DataFrame, error: float) -> DataFrame:
    """(mode, low, high, mass, peak): intervals of a linear CDF between breaks, `peak` the middle of its steepest step.

    Breaks are the middles of steps that are flatter than those beside them, the widest step first, as long as both sides of the
    interval that is cut hold twice the sampling error. Candidates come to the driver in pages of the widest; a page already
    leaves out what the breaks so far rule out, so there are few pages: breaks number 1 / (2 * error) at most.
    """
    spark = nodes.sparkSession
    low, high = nodes.where("p > 0").agg(F.min("x"), F.max("x")).first()
    if low is None:
        return spark.createDataFrame([], "mode int, low double, high double, mass double, peak double")
    breaks = [(float(low), 0.0), (float(high), 1.0)]
    all_ = break_candidates(nodes).withColumn("w", F.col("high") - F.col("low")).persist()
    last = None
    while True:
        page = all_ if last is None else all_.where((F.col("w") < last[0]) | ((F.col("w") == last[0]) & (F.col("low") > last[1])))
        p = (F.col("below") + F.col("above")) / 2
        free = []
        for (_, a), (_, b) in zip(breaks, breaks[1:], strict=False):
            if b - a >= 4 * error:
                free.append((p - a >= 2 * error) & (b - p >= 2 * error))
        if not free:
            break
        page = page.where(reduce(lambda u, v: u | v, free))
        rows = page.orderBy(F.desc("w"), "low").limit(BREAK_PAGE).collect()
        breaks = chosen_breaks([(r.low, r.high, r.below, r.above) for r in rows], error, breaks)
        if len(rows) < BREAK_PAGE:
            break
        last = (rows[-1].w, rows[-1].low)
    all_.unpersist()
    return _peaks(nodes, breaks)


def _peaks(nodes: DataFrame, breaks: list[tuple[float, float]]) -> DataFrame:
    spark, steps = nodes.sparkSession, _steps(nodes)
    middle = (F.col("x") + F.col("x0")) / 2
    cuts = F.array(*[F.lit(x) for x, _ in breaks[1:-1]]).cast("array<double>")
    placed = steps.withColumn("mode", F.size(F.filter(cuts, lambda c: c <= middle)))
    peak = placed.groupBy("mode").agg(F.min(F.struct((-F.col("s")).alias("s"), middle.alias("m"))).alias("best")).select("mode", F.col("best.m").alias("peak"))
    rows = [(i, a[0], b[0], b[1] - a[1]) for i, (a, b) in enumerate(zip(breaks, breaks[1:], strict=False))]
    return spark.createDataFrame(rows, "mode int, low double, high double, mass double").join(F.broadcast(peak), "mode", "left").orderBy("mode")


def histogram_pdf(value: Column, low: Column, width: Column) -> Column:
    return F.floor((value - low) / width)
