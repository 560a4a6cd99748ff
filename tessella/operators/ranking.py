"""Ranks, order statistics, profiles and total variation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import small
from .ordered import scan


def sorted_unique(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def insert_sorted(values: Column, value: Column) -> Column:
    """A value put into an ascending array, before equal ones."""
    at = F.size(F.filter(values, lambda x: x < value))
    return F.concat(F.slice(values, F.lit(1), at), F.array(value), F.slice(values, at + 1, F.size(values) - at))


def count_greater(df: DataFrame, column: str, name: str = "greater") -> DataFrame:
    """For each row how many rows have a strictly greater value: counts by value, then a running sum over values."""
    v = df.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_c")).where("_v is not null")
    run = scan(v, ["_v"], sums={"_upto": F.col("_c")}).crossJoin(F.broadcast(v.agg(F.sum("_c").alias("_n"))))  # one row
    got = run.select("_v", (F.col("_n") - F.col("_upto")).cast("bigint").alias(name))
    return df.join(got, df[column] == got["_v"], "left").drop("_v")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; the limit is taken before the shuffle too."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def rank_probability_ordered(df: DataFrame, place: str, series: str, value: str, interest: str, rank: int) -> DataFrame:
    """Share of places at which the series of interest has that rank (0-based, least rank among equals)."""
    r = df.withColumn("_r", F.rank().over(Window.partitionBy(place).orderBy(value)) - 1).where(F.col(series) == interest)
    return r.agg(F.avg((F.col("_r") == rank).cast("double")).alias("probability"))


def rank_probability_independent(df: DataFrame, series: str, value: str, interest, rank: int) -> DataFrame:
    """Mean over the values of interest of the chance that exactly `rank` of the other series' draws are not greater.

    The chance is a Poisson binomial, folded over the array of the series' probabilities: state k is
    the chance that k draws so far were not greater.
    """
    own = df.where(F.col(series) == interest).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    rest = df.where(F.col(series) != interest)
    others = rest.groupBy(F.col(series).alias("s"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    kinds = others.groupBy("s").agg(F.sum("c").alias("n"))
    # shares up to each value of interest: one union and one running sum per series, marks after the values they equal
    marks = own.select("v").crossJoin(small(kinds.select("s"))).select("s", "v", F.lit(0).cast("bigint").alias("c"), F.lit(1).alias("mark"))
    both = others.where("s is not null").select("s", "v", "c", F.lit(0).alias("mark")).unionByName(marks)
    p = scan(both, ["v", "mark"], ["s"], sums={"upto": F.col("c")}).where("mark = 1").join(kinds, "s").select("v", "s", (F.col("upto") / F.col("n")).alias("p"))
    folded = F.aggregate("ps", F.array(F.lit(1.0)), lambda a, q: F.zip_with(F.concat(F.transform(a, lambda x: x * (1 - q)), F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), F.transform(a, lambda x: x * q)), lambda x, y: x + y))
    got = p.groupBy("v").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "p"))), lambda x: x["p"]).alias("ps")).withColumn("dist", folded)
    k = F.size("ps") + 1 + rank if rank < 0 else F.lit(rank)
    chance = got.select("v", F.coalesce(F.get("dist", k), F.lit(0.0)).alias("chance"))
    return own.join(chance, "v").agg((F.sum(F.col("chance") * F.col("c")) / F.sum("c")).alias("probability"))


def performance_ratio(df: DataFrame, place: str, value: str, name: str = "ratio") -> DataFrame:
    """Each value over the least value of its place."""
    return df.withColumn(name, F.col(value) / F.min(value).over(Window.partitionBy(place)))


def performance_profile(df: DataFrame, series: str, ratio: str, thresholds: list[float]) -> DataFrame:
    """(series, threshold, share) of ratios up to each threshold."""
    one = df.groupBy(series).agg(*[F.avg((F.col(ratio) <= t).cast("double")).alias(f"t{i}") for i, t in enumerate(thresholds)])
    return one.select(series, F.inline(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("share")) for i, t in enumerate(thresholds)])))


def data_profile(df: DataFrame, trial: str, iteration: str, value: str, best: float, tolerances: list[float]) -> DataFrame:
    """(iteration, tolerance, share) of trials whose improvement reaches (1 - tolerance) of the possible one."""
    first = F.first_value(value).over(Window.partitionBy(trial).orderBy(iteration))
    gain = df.withColumn("_f", first)
    one = gain.groupBy(iteration).agg(*[F.avg((F.col("_f") - F.col(value) >= (1 - t) * (F.col("_f") - best)).cast("double")).alias(f"t{i}") for i, t in enumerate(tolerances)])
    return one.select(iteration, F.inline(F.array(*[F.struct(F.lit(float(t)).alias("tolerance"), F.col(f"t{i}").alias("share")) for i, t in enumerate(tolerances)])))


def total_variation(df: DataFrame, axis: str, x: str, y: str, dims: int = 1) -> DataFrame:
    """(axis, variation): sum of |dy| / (dx * dims) over neighbours in x of each axis, steps without dx skipped."""
    steps = scan(df.where(F.col(axis).isNotNull()), [x, y], [axis], lags={"_x": F.col(x), "_y": F.col(y)})
    dx, dy = F.col(x) - F.col("_x"), F.abs(F.col(y) - F.col("_y"))
    return steps.select(axis, dx.alias("dx"), dy.alias("dy")).where("dx > 0").groupBy(axis).agg(F.sum(F.col("dy") / (F.col("dx") * dims)).alias("variation"))


def axis_weights(variation: DataFrame, axis: str) -> DataFrame:
    """(axis, weight): variation^-2 over its median, scaled so that the product is 1; axes without variation count as the median."""
    v = variation.withColumn("w", F.when(F.col("variation") > 0, F.pow("variation", F.lit(-2.0))))
    whole = Window.partitionBy()
    v = v.withColumn("m", F.median("w").over(whole))
    v = v.withColumn("w", F.coalesce(F.col("w") / F.col("m"), F.lit(1.0)))
    return v.select(axis, (F.col("w") / F.exp(F.avg(F.log("w")).over(whole))).alias("weight"))
