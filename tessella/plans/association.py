"""Queries of the association operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import association as assoc

from .registry import query, table

KS = """
WITH b AS (SELECT {cat} AS category, {val}::DOUBLE AS value, count(*) AS n FROM {tab} GROUP BY 1, 2),
v AS (SELECT value, sum(n) AS al FROM b GROUP BY 1), k AS (SELECT DISTINCT category FROM b),
g AS (SELECT k.category, v.value, coalesce(b.n, 0)::DOUBLE AS i, (v.al - coalesce(b.n, 0))::DOUBLE AS o FROM v CROSS JOIN k LEFT JOIN b ON b.value = v.value AND b.category = k.category),
c AS (SELECT *, sum(i) OVER w AS ci, sum(o) OVER w AS co, sum(i) OVER (PARTITION BY category) AS ni, sum(o) OVER (PARTITION BY category) AS no FROM g WINDOW w AS (PARTITION BY category ORDER BY value ROWS UNBOUNDED PRECEDING)),
r AS (SELECT category, max(abs(ci / ni - co / no)) AS ks, max(ni) AS ni, max(no) AS no FROM c GROUP BY 1)
"""

EPDF = """
WITH b AS (SELECT {cat} AS category, {val}::DOUBLE AS value, count(*) AS n FROM {tab} GROUP BY 1, 2),
v AS (SELECT value, sum(n) AS al FROM b GROUP BY 1), k AS (SELECT DISTINCT category FROM b),
g AS (SELECT k.category, v.value, coalesce(b.n, 0)::DOUBLE AS i, (v.al - coalesce(b.n, 0))::DOUBLE AS o FROM v CROSS JOIN k LEFT JOIN b ON b.value = v.value AND b.category = k.category),
s AS (SELECT category, value, 'i' AS side, i AS n FROM g UNION ALL SELECT category, value, 'o', o FROM g),
m AS (SELECT *, min(CASE WHEN n > 0 THEN value END) OVER p AS low, sum(n) OVER p AS total, sum((n > 0)::INT) OVER p AS d FROM s WINDOW p AS (PARTITION BY category, side)),
f AS (SELECT *, sum(CASE WHEN value = low THEN n ELSE 0 END) OVER (PARTITION BY category, side) AS mass, sum(n) OVER (PARTITION BY category, side ORDER BY value ROWS UNBOUNDED PRECEDING) AS cum FROM m),
e AS (SELECT *, CASE WHEN n > 0 THEN (cum - mass) / nullif(total - mass, 0) END AS fx, CASE WHEN n > 0 THEN value END AS x FROM f),
y AS (SELECT category, value, side, d, last_value(fx IGNORE NULLS) OVER b4 AS f0, last_value(x IGNORE NULLS) OVER b4 AS x0, first_value(fx IGNORE NULLS) OVER af AS f1, first_value(x IGNORE NULLS) OVER af AS x1 FROM e
  WINDOW b4 AS (PARTITION BY category, side ORDER BY value ROWS UNBOUNDED PRECEDING), af AS (PARTITION BY category, side ORDER BY value ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
z AS (SELECT category, value, side, d, CASE WHEN f0 IS NULL THEN 0 WHEN f1 IS NULL THEN 1 WHEN x1 = x0 THEN f0 ELSE f0 + (f1 - f0) * (value - x0) / (x1 - x0) END AS y FROM y),
t AS (SELECT category, value, max(CASE WHEN side = 'i' THEN y END) AS yi, max(CASE WHEN side = 'o' THEN y END) AS yo, min(d) AS d FROM z GROUP BY 1, 2),
l AS (SELECT category, d, greatest(least(yi - lag(yi) OVER w, yo - lag(yo) OVER w), 0) AS shared FROM t WINDOW w AS (PARTITION BY category ORDER BY value)),
r AS (SELECT category, CASE WHEN min(d) <= 1 THEN 1 ELSE greatest(0, 1 - sum(shared)) END AS difference FROM l GROUP BY 1)
"""

TV = """
WITH n AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM {tab} GROUP BY 1, 2),
ga AS (SELECT k.a AS category, v.b AS v, coalesce(n.n, 0) AS n, v.al FROM (SELECT DISTINCT a FROM n) k CROSS JOIN (SELECT b, sum(n) AS al FROM n GROUP BY 1) v LEFT JOIN n ON n.a = k.a AND n.b = v.b),
gb AS (SELECT k.b AS category, v.a AS v, coalesce(n.n, 0) AS n, v.al FROM (SELECT DISTINCT b FROM n) k CROSS JOIN (SELECT a, sum(n) AS al FROM n GROUP BY 1) v LEFT JOIN n ON n.b = k.b AND n.a = v.a),
d AS (SELECT '{a}' AS side, category, abs(n / sum(n) OVER p - coalesce((al - n) / nullif(sum(al - n) OVER p, 0), 0)) AS d FROM ga WINDOW p AS (PARTITION BY category)
  UNION ALL SELECT '{b}', category, abs(n / sum(n) OVER p - coalesce((al - n) / nullif(sum(al - n) OVER p, 0), 0)) FROM gb WINDOW p AS (PARTITION BY category)),
r AS (SELECT side, category, sum(d) / 2 AS difference FROM d GROUP BY 1, 2)
"""


@query("flag_price_effect", KS.format(cat="l_returnflag", val="l_extendedprice", tab="lineitem") + ", s AS (SELECT l_returnflag AS category, count(*)::BIGINT AS n FROM lineitem GROUP BY 1) SELECT category, n, round(n / sum(n) OVER (), 6) AS share, round(ks, 9) AS ks FROM r JOIN s USING (category)")
def flag_price_effect(spark: SparkSession, sf: str) -> DataFrame:
    """Frequency and share of each return flag, and how far its prices differ from the others'."""
    from tessella.operators.profile import shares

    t = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    ks = assoc.ks_by_category(t, "l_returnflag", "l_extendedprice").select("category", F.round("ks", 9).alias("ks"))
    return shares(t, "l_returnflag").withColumnRenamed("value", "category").withColumn("share", F.round("share", 6)).join(ks, "category")


@query("cat_num_ks", KS.format(cat="event_type", val="value", tab="events") + "SELECT category, round(ks, 9) AS ks, ni::BIGINT AS n_inside, no::BIGINT AS n_outside, round(least(1, 2 * exp(-2 * ks * ks / abs(1 / ni + 1 / no))), 9) AS p_value FROM r")
def cat_num_ks(spark: SparkSession, sf: str) -> DataFrame:
    k = assoc.ks_by_category(table(spark, sf, "events"), "event_type", "value")
    p = assoc.ks_p_value(F.col("ks"), F.col("n_inside"), F.col("n_outside"))
    return k.select("category", F.round("ks", 9).alias("ks"), "n_inside", "n_outside", F.round(p, 9).alias("p_value"))


@query("cat_num_epdf", EPDF.format(cat="l_returnflag", val="l_quantity", tab="lineitem") + "SELECT category, round(difference, 9) AS difference FROM r")
def cat_num_epdf(spark: SparkSession, sf: str) -> DataFrame:
    return assoc.epdf_by_category(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity").withColumn("difference", F.round("difference", 9))


@query("cat_num_epdf_prices", EPDF.format(cat="o_orderpriority", val="o_totalprice", tab="orders") + "SELECT round(avg(difference), 9) AS effect FROM r")
def cat_num_epdf_prices(spark: SparkSession, sf: str) -> DataFrame:
    return assoc.effect(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice").select(F.round("effect", 9).alias("effect"))


@query("cat_cat_tv", TV.format(a="l_returnflag", b="l_linestatus", tab="lineitem") + "SELECT side, category, round(difference, 9) AS difference FROM r")
def cat_cat_tv(spark: SparkSession, sf: str) -> DataFrame:
    return assoc.category_category(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").withColumn("difference", F.round("difference", 9))


@query("cat_cat_effect", TV.format(a="p_brand", b="p_type", tab="part") + "SELECT round(avg(difference), 9) AS effect FROM r")
def cat_cat_effect(spark: SparkSession, sf: str) -> DataFrame:
    return assoc.effect(table(spark, sf, "part"), "p_brand", "p_type").select(F.round("effect", 9).alias("effect"))


@query("corr_matrix", """
SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 9) AS correlation FROM lineitem UNION ALL
SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 9) FROM lineitem UNION ALL
SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 9) FROM lineitem""")
def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return assoc.correlation(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("correlation", F.round("correlation", 9))


@query("ks_two_sample", """
WITH s AS (SELECT o_totalprice AS v, (o_orderstatus = 'F')::INT AS x, (o_orderstatus <> 'F')::INT AS y FROM orders), g AS (SELECT v, sum(x) AS x, sum(y) AS y FROM s GROUP BY 1)
SELECT round(max(abs(cx / nx - cy / ny)), 9) AS ks, max(nx)::BIGINT AS n_a, max(ny)::BIGINT AS n_b FROM
  (SELECT sum(x) OVER (ORDER BY v)::DOUBLE AS cx, sum(y) OVER (ORDER BY v)::DOUBLE AS cy, sum(x) OVER () AS nx, sum(y) OVER () AS ny FROM g)""")
def ks_two_sample(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return assoc.ks_two_sample(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), "o_totalprice").withColumn("ks", F.round("ks", 9))


@query("categorical_pdf", "SELECT p_brand AS value, round(count(*) / sum(count(*)) OVER (), 9) AS p FROM part GROUP BY 1")
def categorical_pdf(spark: SparkSession, sf: str) -> DataFrame:
    return assoc.categorical_pdf(table(spark, sf, "part"), "p_brand").withColumn("p", F.round("p", 9))


@query("categorical_diff", """
WITH p AS (SELECT event_type AS v, count(*) / sum(count(*)) OVER () AS p FROM events WHERE user_id % 2 = 0 GROUP BY 1), q AS (SELECT event_type AS v, count(*) / sum(count(*)) OVER () AS q FROM events WHERE user_id % 2 = 1 GROUP BY 1)
SELECT round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 9) AS total_variation FROM p FULL JOIN q USING (v)""")
def categorical_diff(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    d = assoc.categorical_diff(assoc.categorical_pdf(e.where("user_id % 2 = 0"), "event_type"), assoc.categorical_pdf(e.where("user_id % 2 = 1"), "event_type"))
    return d.select(F.round("total_variation", 9).alias("total_variation"))


@query("effect_table", "SELECT * FROM (" + TV.format(a="l_returnflag", b="l_linestatus", tab="lineitem") + "SELECT 'l_returnflag' AS a, 'l_linestatus' AS b, round(avg(difference), 9) AS effect FROM r) UNION ALL SELECT * FROM ("
       + EPDF.format(cat="l_returnflag", val="l_quantity", tab="lineitem") + "SELECT 'l_returnflag' AS a, 'l_quantity' AS b, round(avg(difference), 9) AS effect FROM r) UNION ALL SELECT * FROM ("
       + EPDF.format(cat="l_linestatus", val="l_quantity", tab="lineitem") + "SELECT 'l_linestatus' AS a, 'l_quantity' AS b, round(avg(difference), 9) AS effect FROM r)")
def effect_table(spark: SparkSession, sf: str) -> DataFrame:
    return assoc.effect_table(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")).withColumn("effect", F.round("effect", 9))


@query("normal_confidence")
def normal_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Standardised part prices against the normal distribution."""
    p = table(spark, sf, "part")
    m = p.agg(F.avg("p_retailprice").alias("m"), F.stddev_pop("p_retailprice").alias("s"))
    return assoc.normal_ks(p.crossJoin(F.broadcast(m)).select(((F.col("p_retailprice") - F.col("m")) / F.col("s")).alias("z")), "z")  # one row
