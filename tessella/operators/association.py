"""Association between columns: correlation, distribution differences, Kolmogorov-Smirnov statistics.

Everything is aggregated by value first, so running sums go over distinct values, and runs per side
or category, not over all rows in one task.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.maths import erf

from .joins import small
from .ordered import scan
from .profile import with_share


def categorical_pdf(df: DataFrame, column: str) -> DataFrame:
    """(value, p) of a column, null among the values."""
    n = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return with_share(n, "p").select("value", "p")


def categorical_diff(p: DataFrame, q: DataFrame) -> DataFrame:
    """Total variation distance of two tables (value, p); raises where one does not sum to 1 within 1e-5."""
    a, b = p.select("value", F.col("p").alias("x")), q.select(F.col("value").alias("v"), F.col("p").alias("y"))
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    one = a.join(b, F.col("value").eqNullSafe(F.col("v")), "full").agg((F.sum(F.abs(x - y)) / 2).alias("d"), F.sum(x).alias("sx"), F.sum(y).alias("sy"))
    return one.select(F.when((F.abs(F.col("sx") - 1) > 1e-5) | (F.abs(F.col("sy") - 1) > 1e-5), F.raise_error(F.lit("probabilities have to sum to 1")).cast("double")).otherwise(F.col("d")).alias("total_variation"))


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, correlation) of all pairs of numeric columns, in one pass."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(cells))


def in_and_out(df: DataFrame, category: str, value: str) -> DataFrame:
    """(category, value, inside, outside): for each category and each distinct value of the table, rows of the category and others."""
    base = df.where(F.col(category).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(category).alias("category"), F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))
    per_value = base.groupBy("value").agg(F.sum("n").alias("all"))
    kinds = base.select("category").distinct()
    grid = per_value.crossJoin(small(kinds))
    return grid.join(base, ["category", "value"], "left").select("category", "value", F.coalesce("n", F.lit(0)).alias("inside"), (F.col("all") - F.coalesce("n", F.lit(0))).alias("outside"))


def ks_statistics(sides: DataFrame, by: str = "category") -> DataFrame:
    """(by, ks, n_inside, n_outside): exact two-sample Kolmogorov-Smirnov statistic of (by, value, inside, outside)."""
    n = sides.groupBy(by).agg(F.sum("inside").alias("n_inside"), F.sum("outside").alias("n_outside"))
    run = scan(sides, ["value"], [by], sums={"i": F.col("inside"), "o": F.col("outside")}).join(n, by)
    d = F.abs(F.col("i") / F.col("n_inside") - F.col("o") / F.col("n_outside"))
    return run.groupBy(by).agg(F.max(d).alias("ks"), F.first("n_inside").alias("n_inside"), F.first("n_outside").alias("n_outside"))


def ks_by_category(df: DataFrame, category: str, value: str) -> DataFrame:
    """(category, ks, n_inside, n_outside): Kolmogorov-Smirnov statistic between a column's values inside and outside each category.

    Between two values of a category its own share stands still and the others' rises, so the difference is greatest at one of
    its values or just before it: no category meets values that it does not hold.
    """
    base = df.where(F.col(category).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(category).alias("category"), F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))
    whole = scan(base.groupBy("value").agg(F.sum("n").alias("a")), ["value"], sums={"all": F.col("a")}).select("value", "a", "all")
    sizes = base.groupBy("category").agg(F.sum("n").alias("n_inside"))
    total = base.agg(F.sum("n").alias("total"))
    run = scan(base, ["value"], ["category"], sums={"own": F.col("n")}).join(whole, "value").join(sizes, "category").crossJoin(F.broadcast(total))  # one row
    rest = F.nullif(F.col("total") - F.col("n_inside"), F.lit(0))
    after = F.abs(F.col("own") / F.col("n_inside") - (F.col("all") - F.col("own")) / rest)
    before = F.abs((F.col("own") - F.col("n")) / F.col("n_inside") - (F.col("all") - F.col("a") - F.col("own") + F.col("n")) / rest)
    return run.groupBy("category").agg(F.max(F.greatest(after, before)).alias("ks"), F.first("n_inside").alias("n_inside"), F.first(F.col("total") - F.col("n_inside")).alias("n_outside"))


def ks_two_sample(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row (ks, n_a, n_b) for two samples of a column."""
    both = a.select(F.col(column).cast("double").alias("value"), F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select(F.col(column).cast("double"), F.lit(0), F.lit(1)))
    sides = both.where("value is not null").groupBy("value").agg(F.sum("x").alias("inside"), F.sum("y").alias("outside")).withColumn("category", F.lit(0))
    return ks_statistics(sides).select("ks", F.col("n_inside").alias("n_a"), F.col("n_outside").alias("n_b"))


def ks_p_value(ks: Column, n1: Column, n2: Column | None = None) -> Column:
    """min(1, 2 exp(-2 ks^2 / |1/n1 + 1/n2|)); without n2 the second sample is a distribution."""
    spread = F.abs(F.lit(1.0) / n1 + (F.lit(1.0) / n2 if n2 is not None else F.lit(0.0)))
    return F.least(F.lit(1.0), 2 * F.exp(-2 * ks * ks / spread))


def normal_ks(df: DataFrame, column: str) -> DataFrame:
    """One row (ks, n, p_value) of a sample against the standard normal distribution."""
    v = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("c"))
    run = scan(v, ["x"], sums={"upto": F.col("c")}).crossJoin(F.broadcast(v.agg(F.sum("c").alias("n"))))  # one row
    e = F.col("upto") / F.col("n")
    cdf = (1 + erf(F.col("x") / math.sqrt(2.0))) / 2
    d = run.select(F.greatest(F.abs(e - cdf), F.abs(e - F.col("c") / F.col("n") - cdf)).alias("d"), "n")
    return d.agg(F.max("d").alias("ks"), F.first("n").alias("n")).withColumn("p_value", ks_p_value(F.col("ks"), F.col("n")))


def epdf_by_category(df: DataFrame, category: str, value: str) -> DataFrame:
    """(category, difference) of the piecewise-linear densities inside and outside each category.

    Each side's mass at its least value is taken off and the rest made 1; the EDF is linear between
    a side's distinct values. The difference is 1 less the sum, over the intervals between the break
    points of both sides, of the smaller rise. A side of one distinct value gives 1.
    """
    return epdf_difference(in_and_out(df, category, value))


def epdf_difference(sides: DataFrame, by: str = "category") -> DataFrame:
    names = ("inside", "outside")
    own = {s: F.col(s) > 0 for s in names}
    low = sides.groupBy(by).agg(*[F.min(F.when(own[s], F.col("value"))).alias(f"low_{s}") for s in names], *[F.sum(s).alias(f"n_{s}") for s in names], *[F.sum(own[s].cast("int")).alias(f"d_{s}") for s in names])
    mass = sides.join(low, by).groupBy(by).agg(*[F.sum(F.when(F.col("value") == F.col(f"low_{s}"), F.col(s)).otherwise(0)).alias(f"mass_{s}") for s in names])
    facts = low.join(mass, by)
    run = scan(sides, ["value"], [by], sums={f"c_{s}": F.col(s) for s in names}).join(facts, by)
    for s in names:
        rest = F.col(f"n_{s}") - F.col(f"mass_{s}")
        run = run.withColumn(f"f_{s}", F.when(own[s], (F.col(f"c_{s}") - F.col(f"mass_{s}")) / F.when(rest > 0, rest))).withColumn(f"x_{s}", F.when(own[s], F.col("value")))
    ends = [f"{c}_{s}" for c in "xf" for s in names]
    run = run.select(by, "value", *ends, F.least("d_inside", "d_outside").alias("few"))
    run = scan(run, ["value"], [by], lasts={f"{c}0": F.col(c) for c in ends}, nexts={f"{c}1": F.col(c) for c in ends})
    for s in names:
        x0, f0, x1, f1 = (F.col(f"{c}_{s}{e}") for e in "01" for c in "xf")
        run = run.withColumn(f"y_{s}", F.when(f0.isNull(), 0.0).when(f1.isNull(), 1.0).when(x1 == x0, f0).otherwise(f0 + (f1 - f0) * (F.col("value") - x0) / (x1 - x0)))
    run = scan(run.select(by, "value", "few", "y_inside", "y_outside"), ["value"], [by], lags={"p_inside": F.col("y_inside"), "p_outside": F.col("y_outside")})
    shared = F.greatest(F.least(*[F.col(f"y_{s}") - F.col(f"p_{s}") for s in names]), F.lit(0.0))
    return run.groupBy(by).agg(F.when(F.min("few") <= 1, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum(shared), F.lit(0.0)))).alias("difference"))


def category_category(df: DataFrame, a: str, b: str) -> DataFrame:
    """(side, category, difference): total variation between the other column's distribution given = and <> each category."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    out = None
    total = n.agg(F.sum("n").alias("total"))
    for given, other, name in (("a", "b", a), ("b", "a", b)):
        cells = n.select(F.col(given).alias("category"), F.col(other).alias("v"), "n")
        values = cells.groupBy("v").agg(F.sum("n").alias("all"))
        sizes = cells.groupBy("category").agg(F.sum("n").alias("own"))
        held = cells.join(values, "v").join(sizes, "category").crossJoin(F.broadcast(total))  # one row
        rest = F.nullif(F.col("total") - F.col("own"), F.lit(0))
        d = F.abs(F.col("n") / F.col("own") - F.coalesce((F.col("all") - F.col("n")) / rest, F.lit(0.0)))
        # values that a category does not hold add their share of the others, together what the held ones leave
        part = held.withColumn("rest", rest).groupBy("category").agg(F.sum(d).alias("d"), F.sum("all").alias("seen"), F.first("total").alias("total"), F.first("rest").alias("rest"))
        part = part.select(F.lit(name).alias("side"), "category", ((F.col("d") + F.coalesce((F.col("total") - F.col("seen")) / F.col("rest"), F.lit(0.0))) / 2).alias("difference"))
        out = part if out is None else out.unionByName(part)
    return out


def _combined(rows: DataFrame, method: str) -> DataFrame:
    c = {"mean": F.avg("difference"), "max": F.max("difference"), "min": F.min("difference")}[method]
    return rows.agg(c.alias("effect"))


def effect(df: DataFrame, a: str, b: str, method: str | None = "mean", use_ks: bool = False) -> DataFrame:
    """Association of two columns: number/number correlation, number/category and category/category differences.

    One row (effect); with method None a row (category, difference) for each category. Kinds come
    from the schema, pairs with a null are left out.
    """
    number = lambda c: isinstance(df.schema[c].dataType, T.NumericType)
    if number(a) and number(b):
        return df.agg(F.corr(a, b).alias("effect"))
    if number(a) or number(b):
        cat, val = (b, a) if number(a) else (a, b)
        if use_ks:
            ks = ks_by_category(df, cat, val)
            rows = ks.select("category", (1 - ks_p_value(F.col("ks"), F.col("n_inside"), F.col("n_outside"))).alias("difference"))
        else:
            rows = epdf_by_category(df, cat, val)
    else:
        rows = category_category(df, a, b).select("category", "difference")
    return rows if method is None else _combined(rows, method)


def effect_table(df: DataFrame, compare_with: list[str] | None = None, method: str = "mean") -> DataFrame:
    """(a, b, effect) of all column pairs that touch `compare_with`, constant columns with null; greatest first."""
    names = df.columns
    spread = df.agg(*[(F.min(c) != F.max(c)).alias(c) for c in names]).first()  # one row
    out = None
    for a, b in combinations(names, 2):
        if compare_with and a not in compare_with and b not in compare_with:
            continue
        if spread[a] and spread[b]:
            part = effect(df, a, b, method).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("effect").cast("double").alias("effect"))
        else:
            part = df.sparkSession.range(1).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(None).cast("double").alias("effect"))
        out = part if out is None else out.unionByName(part)
    return out.orderBy(F.desc_nulls_last(F.abs("effect")), "a", "b")
