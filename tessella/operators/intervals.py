"""Range joins and as-of joins without nested loops.

Range joins cut the line into bins. A bin's width is a quantile of the intervals' lengths, so most intervals lie in one or two
bins; intervals that would lie in more than MAX_BINS of a width go to a coarser level, whose bins are MAX_BINS times as wide, and so
on: an interval has at most MAX_BINS + 1 bins of its level. A point looks in one bin of each level that occurs, and a
pair is found in the one bin that holds the point, so there are no duplicates. Both sides are shuffled by level and bin;
bins with many points are dealt to parts, into which their intervals are copied. Two intervals that overlap are
found where the later of their starts lies, so the join of intervals is that of starts.

Counts and sums of the points of intervals need no pairs: totals() takes them from running sums over all places.

As-of joins union both sides and scan them in order, group by group: a row takes the last (or next) row of the other side.

Defined cases: rows with a null end, point, time or key match nothing and, in as-of joins, stay with nulls; intervals that end
before they start hold nothing; both ends belong to an interval; ties in time go to the right row with the greatest
tie columns (all columns, if none are named); column names that both sides have are refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import scan

MAX_BINS = 16
#: Points of a bin and part at most, on average.
PART_ROWS = 100_000


def _levels(intervals: DataFrame, low: str, high: str, share: float) -> tuple[float, list[int]]:
    """(width of the finest bins, levels that occur)."""
    length = F.col(high).cast("double") - F.col(low).cast("double")
    width = intervals.select(F.percentile_approx(length, share).alias("w"), F.max(length).alias("m")).first()
    if width.w is None:
        return 1.0, []
    fine = max(float(width.w), float(width.m) * 2.0**-40, 1e-300)
    return fine, list(range(1 + _steps(float(width.m), fine)))


def _steps(most: float, fine: float) -> int:
    steps = 0
    while fine * MAX_BINS ** (steps + 1) < most:
        steps += 1
    return steps


def _bin(value: Column, fine: float, level: Column) -> Column:
    return F.floor(value.cast("double") / (F.lit(fine) * F.pow(F.lit(float(MAX_BINS)), level)))


def covering(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, share: float = 0.5) -> DataFrame:
    """Pairs of a point and an interval that holds it, with the columns of both."""
    clash = set(points.columns) & set(intervals.columns)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    proper = intervals.where(F.col(low) <= F.col(high))
    fine, levels = _levels(proper, low, high, share)
    if not levels:
        return points.limit(0).crossJoin(intervals.limit(0))
    length = F.col(high).cast("double") - F.col(low).cast("double")
    level = F.lit(0)
    for k in levels[1:]:
        level = F.when(length > fine * MAX_BINS**k, k).otherwise(level)
    dealt = proper.withColumn("_level", level.cast("int"))
    dealt = dealt.withColumn("_bin", F.explode(F.sequence(_bin(F.col(low), fine, F.col("_level")), _bin(F.col(high), fine, F.col("_level")))))
    asked = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels])))
    asked = asked.withColumn("_bin", _bin(F.col(at), fine, F.col("_level")))
    # hot bins: their points are dealt to parts, their intervals copied to each
    counts = asked.groupBy("_level", "_bin").agg(F.count("*").alias("n")).where(F.col("n") > PART_ROWS).select("_level", "_bin", F.ceil(F.col("n") / PART_ROWS).alias("_parts"))
    hot = F.broadcast(counts)  # a row for each PART_ROWS points at most
    salt = F.pmod(F.xxhash64(*points.columns), F.coalesce("_parts", F.lit(1)))
    asked = asked.join(hot, ["_level", "_bin"], "left").withColumn("_part", salt).drop("_parts")
    dealt = dealt.join(hot, ["_level", "_bin"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    both = asked.join(dealt, ["_level", "_bin", "_part"]).where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high)))
    return both.select(*points.columns, *intervals.columns)


def totals(points: DataFrame, intervals: DataFrame, at: str, key: str, low: str, high: str, sums: dict[str, Column]) -> DataFrame:
    """(key, n, least, `sums`) of the points that each interval holds: their number, least place and sums; none where it holds none.

    No pair is made: running sums over all places are read at both ends of an interval, and the place that follows its start. Sums
    of whole numbers are exact; equal keys count as one row with the points of all their intervals. A sum of nulls only is 0.
    """
    place = lambda c: F.col(c).cast("double") + 0.0
    own = points.where(F.col(at).isNotNull()).groupBy(place(at).alias("_at")).agg(F.count("*").alias("_n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"_{k}") for k, c in sums.items()])
    held = ["_n", *[f"_{k}" for k in sums]]
    # starts come before the points of their place, ends after them
    ends = F.array(F.struct(place(low).alias("_at"), F.lit(0).alias("_side")), F.struct(place(high).alias("_at"), F.lit(2).alias("_side")))
    proper = (intervals.where(F.col(low) <= F.col(high)).select(F.col(key).alias("_key"), ends.alias("_ends")).withColumn("_turn", F.monotonically_increasing_id())
              .select("_key", "_turn", F.inline("_ends")))
    none = [F.lit(0).cast(own.schema[c].dataType).alias(c) for c in held]
    nobody = F.lit(None).cast(proper.schema["_key"].dataType).alias("_key")
    rows = (own.select("_at", F.lit(1).alias("_side"), F.lit(-1).cast("bigint").alias("_turn"), nobody, *held)
            .unionByName(proper.select("_at", "_side", "_turn", "_key", *none)))
    run = scan(rows, ["_at", "_side", "_turn"], sums={f"_up{c}": F.col(c) for c in held}, nexts={"_first": F.when(F.col("_side") == 1, F.col("_at"))}).where("_side <> 1")
    start = F.col("_side") == 0
    one = run.groupBy("_turn", "_key").agg(F.max(F.when(start, F.col("_first"))).alias("least"), *[(F.max(F.when(~start, F.col(f"_up{c}"))) - F.max(F.when(start, F.col(f"_up{c}")))).alias(c) for c in held])
    return one.where("_n > 0").groupBy(F.col("_key").alias(key)).agg(F.sum("_n").alias("n"), F.min("least").alias("least"), *[F.sum(f"_{k}").alias(k) for k in sums])


def overlapping(left: DataFrame, right: DataFrame, left_low: str, left_high: str, right_low: str, right_high: str) -> DataFrame:
    """Pairs of intervals that share a point: one side's start lies in the other; equal starts count once."""
    a = left.where(F.col(left_low) <= F.col(left_high))
    b = right.where(F.col(right_low) <= F.col(right_high))
    one = covering(b, a, right_low, left_low, left_high)
    two = covering(a, b, left_low, right_low, right_high).where(F.col(left_low) > F.col(right_low))
    return one.select(*left.columns, *right.columns).unionByName(two.select(*left.columns, *right.columns))


def as_of(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: Sequence[tuple[str, str]] = (), direction: str = "backward",
          tolerance: float | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Each left row with the last right row at or before its time (`forward`: the first at or after it), of equal keys.

    `by` are pairs of key columns; `tolerance` is the greatest difference in time, in the time's own numbers or seconds.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"no such direction: {direction}")
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    number = lambda df, c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6 if "time" in df.schema[c].dataType.typeName() else F.col(c).cast("double")
    keys = [f"_k{i}" for i in range(len(by))]
    forward = direction == "forward"
    sign = -1 if forward else 1
    row, found = F.struct(*left.columns), F.struct(*right.columns)

    def usable(t: str, cols: list[str]) -> Column:
        good = F.col(t).isNotNull()
        for c in cols:
            good = good & F.col(c).isNotNull()
        return good

    asked = usable(left_time, [a for a, _ in by])
    ready, others = left.where(asked), right.where(usable(right_time, [b for _, b in by]))
    shape = [F.lit(None).cast(ready.select(row.alias("s")).schema["s"].dataType).alias("_l"), F.lit(None).cast(others.select(found.alias("s")).schema["s"].dataType).alias("_r")]
    # of rows at one time the right side's come first, in the order of the ties
    tie = F.struct(*[F.col(t) for t in ties or right.columns])
    nothing = F.lit(None).cast(others.select(tie.alias("s")).schema["s"].dataType)
    a = ready.select(*[F.col(c).alias(k) for k, (c, _) in zip(keys, by, strict=True)], (sign * number(left, left_time)).alias("_t"), F.lit(1).alias("_side"), nothing.alias("_tie"), row.alias("_l"), shape[1])
    b = others.select(*[F.col(c).alias(k) for k, (_, c) in zip(keys, by, strict=True)], (sign * number(right, right_time)).alias("_t"), F.lit(0).alias("_side"), tie.alias("_tie"), shape[0], found.alias("_r"))
    got = scan(a.unionByName(b), ["_t", "_side", "_tie"], keys, lasts={"_got": F.col("_r")}).where("_side = 1")
    near = F.col("_got").isNotNull()
    if tolerance is not None:
        at = F.col(f"_got.{right_time}")
        at = F.unix_micros(at.cast("timestamp")) / 1e6 if "time" in right.schema[right_time].dataType.typeName() else at.cast("double")
        near = near & (F.abs(F.col("_t") * sign - at) <= tolerance)
    matched = got.select("_l.*", *[F.when(near, F.col(f"_got.{c}")).alias(c) for c in right.columns])
    rest = left.where(~asked).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in right.columns])
    return matched.unionByName(rest)
