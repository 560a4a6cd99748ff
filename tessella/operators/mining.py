"""Frequent itemsets, level by level, as self joins on the transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import kept as written
from .joins import small


def frequent_itemsets(df: DataFrame, key: str, item: str, support: float, longest: int = 3, max_items: int | None = None) -> DataFrame:
    """(items, size, n, support): item sets held by a share `support` of the transactions or more.

    A set of the next level joins a kept set with a later kept single item of the same transaction; what transactions hold at a
    level is written once, as it is counted and joined again. Mining stops at an empty level. With `max_items` each level
    keeps that many of its best sets only (by count, then items).
    """
    rows = df.where(F.col(item).isNotNull()).select(F.col(key).alias("t"), F.col(item).cast("string").alias("i")).distinct()
    total = df.select(key).distinct().count()

    def level(sets: DataFrame) -> DataFrame:
        n = sets.groupBy("items").agg(F.count("*").alias("n")).where(F.col("n") >= support * total)
        return n if max_items is None else n.orderBy(F.desc("n"), "items").limit(max_items)  # each task sends its best `max_items`

    holders = rows.select("t", F.array("i").alias("items"), F.col("i").alias("last"))
    kept = written(level(holders), "sets")
    singles = rows.join(small(kept.select(F.col("items")[0].alias("i"))), "i")
    holders = holders.join(small(kept.select("items")), "items")
    out, size = kept.withColumn("size", F.lit(1)), 1
    while size < longest:
        size += 1
        nxt = written(holders.join(singles, "t").where(F.col("i") > F.col("last"))
                      .select("t", F.concat("items", F.array("i")).alias("items"), F.col("i").alias("last")), "holders")
        kept = written(level(nxt), "sets")
        if kept.isEmpty():
            break
        holders = nxt.join(small(kept.select("items")), "items")
        out = out.unionByName(kept.withColumn("size", F.lit(size)))
    return out.select("items", "size", "n", (F.col("n") / total).alias("support"))


def frequent_itemsets_fp(df: DataFrame, key: str, item: str, support: float) -> DataFrame:
    """(items, n) by FP-growth, without the limit on a level; items sorted."""
    from pyspark.ml.fpm import FPGrowth

    baskets = df.where(F.col(item).isNotNull()).groupBy(key).agg(F.collect_set(F.col(item).cast("string")).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=support).fit(baskets).freqItemsets
    return found.select(F.array_sort("items").alias("items"), F.col("freq").alias("n"))
