"""Running sums, last and next known values and lags over a whole order, without one task that holds it.

Rows are range-partitioned by the order. Windows run inside a range; what crosses ranges (a sum, the
last value known) comes from a table with one row for each range and group. All frames grow from
their start: Spark computes frames that end at the last row anew for every row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Exprs = Mapping[str, Column]


def in_ranges(df: DataFrame, parts: int, order: Sequence[str | Column]) -> DataFrame:
    """Rows in ranges of an order, with the range's number in `_part`.

    Bounds come from a sample that differs from exchange to exchange, so the ranges are kept: all
    readers have to see the same ones. What is lost with an executor is made anew with the same bounds.
    """
    ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    return ranged.persist(StorageLevel.MEMORY_AND_DISK)


def scan(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), sums: Exprs | None = None, lasts: Exprs | None = None,
         nexts: Exprs | None = None, lags: Exprs | None = None, parts: int | None = None) -> DataFrame:
    """Add columns by name: running `sums` up to the row, `lasts` (last value not null up to it), `nexts`
    (first one not null from it on) and `lags` (value of the row before), each inside a group of `by`.

    `order` are ascending columns; they should tell the rows of a group apart. Group keys are not null.
    """
    sums, lasts, nexts, lags, by = dict(sums or {}), dict(lasts or {}), dict(nexts or {}), dict(lags or {}), list(by)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = in_ranges(df, parts, order)
    keys = [*by, "_part"]
    step = Window.partitionBy(*keys).orderBy(*order)
    up = step.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {f"_s_{k}": F.sum(c).over(up) for k, c in sums.items()} | {f"_l_{k}": F.last(c, True).over(up) for k, c in lasts.items()}
    local |= {f"_g_{k}": F.lag(c).over(step) for k, c in lags.items()}
    if lags:
        local["_rn"] = F.row_number().over(step)
    out = ranged.withColumns(local)
    if nexts:
        out = out.withColumns({f"_n_{k}": F.last(c, True).over(down) for k, c in nexts.items()})
    place = F.struct(*order)
    known = lambda c: F.when(c.isNotNull(), place)
    one = ranged.groupBy(*keys).agg(F.count("*").alias("_c"), *[F.sum(c).alias(f"_s_{k}") for k, c in sums.items()], *[F.max_by(c, known(c)).alias(f"_l_{k}") for k, c in lasts.items()],
                                    *[F.min_by(c, known(c)).alias(f"_n_{k}") for k, c in nexts.items()], *[F.max_by(c, place).alias(f"_g_{k}") for k, c in lags.items()])
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    carry = one.select(*keys, *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_cs_{k}") for k in sums], *[F.last(f"_l_{k}", True).over(before).alias(f"_cl_{k}") for k in lasts],
                       *[F.last(f"_n_{k}", True).over(after).alias(f"_cn_{k}") for k in nexts], *[F.last(f"_g_{k}").over(before).alias(f"_cg_{k}") for k in lags])
    got = out.join(carry, keys)
    return got.select(*df.columns, *[(F.coalesce(f"_s_{k}", F.lit(0)) + F.col(f"_cs_{k}")).alias(k) for k in sums], *[F.coalesce(f"_l_{k}", f"_cl_{k}").alias(k) for k in lasts],
                      *[F.coalesce(f"_n_{k}", f"_cn_{k}").alias(k) for k in nexts], *[F.when(F.col("_rn") == 1, F.col(f"_cg_{k}")).otherwise(F.col(f"_g_{k}")).alias(k) for k in lags])
