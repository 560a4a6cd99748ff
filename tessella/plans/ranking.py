"""Queries of ranks, profiles and order statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import ranking

from .registry import query, table


@query("sorted_unique", "SELECT DISTINCT p_brand FROM part")
def sorted_unique(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.sorted_unique(table(spark, sf, "part"), "p_brand")


@query("insert_sorted", "SELECT n_nationkey, array_to_string(list_sort(list_append([2, 5, 5, 9, 20], n_nationkey)), ',') AS v FROM nation")
def insert_sorted(spark: SparkSession, sf: str) -> DataFrame:
    got = ranking.insert_sorted(F.array(*[F.lit(i) for i in (2, 5, 5, 9, 20)]), F.col("n_nationkey").cast("int"))
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(F.transform(got, lambda x: x.cast("string")), ",").alias("v"))


@query("count_greater", "SELECT p_partkey, (SELECT count(*) FROM part) - count(*) OVER (ORDER BY p_size RANGE UNBOUNDED PRECEDING) AS greater FROM part")
def count_greater(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.count_greater(table(spark, sf, "part"), "p_size").select("p_partkey", "greater")


@query("topk_per_group", "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 3")
def topk_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top_k(table(spark, sf, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3).select("c_nationkey", "c_custkey", "c_acctbal")


@query("rank_prob_ordered", """
WITH a AS (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY 1, 2)
SELECT round(avg((r = 0)::INT::DOUBLE), 9) AS probability FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY v) - 1 AS r FROM a) WHERE event_type = 'click'""")
def rank_prob_ordered(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    return ranking.rank_probability_ordered(a, "user_id", "event_type", "v", "click", 0).select(F.round("probability", 9).alias("probability"))


@query("rank_prob_independent", """
WITH q AS (SELECT l_linestatus, l_returnflag AS s, l_quantity AS v FROM lineitem), i AS (SELECT v, count(*) AS c FROM q WHERE s = 'A' GROUP BY 1),
n AS (SELECT v, (SELECT count(*) FROM q WHERE s = 'N' AND q.v <= i.v) / (SELECT count(*) FROM q WHERE s = 'N') AS pn, (SELECT count(*) FROM q WHERE s = 'R' AND q.v <= i.v) / (SELECT count(*) FROM q WHERE s = 'R') AS pr, c FROM i)
SELECT round(sum(c * (pn * (1 - pr) + pr * (1 - pn))) / sum(c), 9) AS probability FROM n""")
def rank_prob_independent(spark: SparkSession, sf: str) -> DataFrame:
    got = ranking.rank_probability_independent(table(spark, sf, "lineitem").select("l_returnflag", "l_quantity"), "l_returnflag", "l_quantity", "A", 1)
    return got.select(F.round("probability", 9).alias("probability"))


@query("perf_ratio", "SELECT s_suppkey, round((s_acctbal + 2000) / min(s_acctbal + 2000) OVER (PARTITION BY s_nationkey), 6) AS ratio FROM supplier")
def perf_ratio(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").withColumn("v", F.col("s_acctbal") + 2000)
    return ranking.performance_ratio(s, "s_nationkey", "v").select("s_suppkey", F.round("ratio", 6).alias("ratio"))


@query("perf_profile", """
WITH r AS (SELECT s_nationkey % 5 AS series, (s_acctbal + 2000) / min(s_acctbal + 2000) OVER (PARTITION BY s_nationkey) AS ratio FROM supplier)
SELECT series, t::DOUBLE AS threshold, round(avg((ratio <= t)::INT::DOUBLE), 9) AS share FROM r, (SELECT unnest([1.0, 1.5, 2.0, 4.0]) AS t) GROUP BY 1, 2""")
def perf_profile(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").withColumn("v", F.col("s_acctbal") + 2000).withColumn("series", F.col("s_nationkey") % 5)
    got = ranking.performance_profile(ranking.performance_ratio(s, "s_nationkey", "v"), "series", "ratio", [1.0, 1.5, 2.0, 4.0])
    return got.withColumn("share", F.round("share", 9))


@query("data_profile", """
WITH f AS (SELECT l_orderkey, l_linenumber, min(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2), g AS (SELECT *, first_value(v) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS f FROM f)
SELECT l_linenumber, t::DOUBLE AS tolerance, round(avg((f - v >= (1 - t) * (f - 900.0))::INT::DOUBLE), 9) AS share FROM g, (SELECT unnest([0.1, 0.5, 0.9]) AS t) GROUP BY 1, 2""")
def data_profile(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_extendedprice").alias("v"))
    return ranking.data_profile(f, "l_orderkey", "l_linenumber", "v", 900.0, [0.1, 0.5, 0.9]).withColumn("share", F.round("share", 9))


@query("total_variation", """
WITH d AS (SELECT o_orderpriority AS axis, lead(o_orderkey) OVER w - o_orderkey AS dx, abs(lead(o_totalprice) OVER w - o_totalprice) AS dy FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey, o_totalprice))
SELECT axis, round(sum(dy / (dx * 2)), 2) AS variation FROM d WHERE dx > 0 GROUP BY 1""")
def total_variation(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("axis"), F.col("o_orderkey").alias("x"), F.col("o_totalprice").alias("y"))
    return ranking.total_variation(o, "axis", "x", "y", 2).withColumn("variation", F.round("variation", 2))


@query("axis_weights", """
WITH d AS (SELECT o_orderpriority AS axis, lead(o_orderkey) OVER w - o_orderkey AS dx, abs(lead(o_totalprice) OVER w - o_totalprice) AS dy FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey, o_totalprice)),
v AS (SELECT axis, pow(sum(dy / dx), -2) AS w FROM d WHERE dx > 0 GROUP BY 1), m AS (SELECT axis, w / (SELECT median(w) FROM v) AS w FROM v)
SELECT axis, round(w / exp((SELECT avg(ln(w)) FROM m)), 6) AS weight FROM m""")
def axis_weights(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("axis"), F.col("o_orderkey").alias("x"), F.col("o_totalprice").alias("y"))
    return ranking.axis_weights(ranking.total_variation(o, "axis", "x", "y"), "axis").withColumn("weight", F.round("weight", 6))
