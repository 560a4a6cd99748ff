"""Queries of distributions and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import cubic, sampling, sketch
from tessella.operators import distribution as dist

from .registry import query, table

NODES = """
WITH c AS (SELECT o_totalprice AS x, count(*) AS c FROM orders GROUP BY 1), n AS (SELECT x, sum(c) OVER (ORDER BY x) / sum(c) OVER () AS p FROM c UNION ALL SELECT min(x) - pow(2, -26), 0 FROM c)
"""


@query("cdf_points", NODES + "SELECT round(x, 6) AS x, round(p, 9) AS p FROM n")
def cdf_points(spark: SparkSession, sf: str) -> DataFrame:
    return dist.cdf_points(table(spark, sf, "orders"), "o_totalprice").select(F.round("x", 6).alias("x"), F.round("p", 9).alias("p"))


@query("cdf_eval", NODES + """, q AS (SELECT unnest(range(0, 600000, 7919))::DOUBLE AS v)
SELECT v, round(CASE WHEN x0 IS NULL THEN 0 WHEN x0 = v THEN p0 WHEN x1 IS NULL THEN 1 ELSE p0 + (p1 - p0) * (v - x0) / (x1 - x0) END, 9) AS cdf FROM (
  SELECT v, (SELECT max(x) FROM n WHERE x <= v) AS x0, (SELECT arg_max(p, x) FROM n WHERE x <= v) AS p0, (SELECT min(x) FROM n WHERE x > v) AS x1, (SELECT arg_min(p, x) FROM n WHERE x > v) AS p1 FROM q)""")
def cdf_eval(spark: SparkSession, sf: str) -> DataFrame:
    nodes = dist.cdf_points(table(spark, sf, "orders"), "o_totalprice")
    q = spark.range(0, 600000, 7919).select(F.col("id").cast("double").alias("v"))
    return dist.cdf_eval(q, nodes, "v").withColumn("cdf", F.round("cdf", 9))


CUBIC = NODES + """,
near AS (SELECT x, p, lag(x) OVER o AS xa, lag(p) OVER o AS pa, lead(x) OVER o AS xb, lead(p) OVER o AS pb, lag(x, 2) OVER o AS xy, lag(p, 2) OVER o AS py, lead(x, 2) OVER o AS xz, lead(p, 2) OVER o AS pz FROM n WINDOW o AS (ORDER BY x)),
d AS (SELECT *, x - xa AS h0, (p - pa) / (x - xa) AS d0, xb - x AS h1, (pb - p) / (xb - x) AS d1, xz - xb AS h2, (pz - pb) / (xz - xb) AS d2, xa - xy AS g, (pa - py) / (xa - xy) AS e FROM near),
r AS (SELECT *, ((2 * h1 + h2) * d1 - h1 * d2) / (h1 + h2) AS mf, ((2 * h0 + g) * d0 - h0 * e) / (h0 + g) AS ml FROM d),
s AS (SELECT x, p, CASE
  WHEN d0 IS NOT NULL AND d1 IS NOT NULL THEN CASE WHEN d0 * d1 <= 0 THEN 0 ELSE (3 * h0 + 3 * h1) / ((2 * h1 + h0) / d0 + (h1 + 2 * h0) / d1) END
  WHEN d1 IS NOT NULL THEN CASE WHEN d2 IS NULL THEN d1 WHEN sign(mf) <> sign(d1) THEN 0 WHEN sign(d1) <> sign(d2) AND abs(mf) > 3 * abs(d1) THEN 3 * d1 ELSE mf END
  ELSE CASE WHEN e IS NULL THEN d0 WHEN sign(ml) <> sign(d0) THEN 0 WHEN sign(d0) <> sign(e) AND abs(ml) > 3 * abs(d0) THEN 3 * d0 ELSE ml END END AS m FROM r),
pieces AS (SELECT x AS low, lead(x) OVER o AS high, p AS y0, lead(p) OVER o AS y1, m AS m0, lead(m) OVER o AS m1 FROM s WINDOW o AS (ORDER BY x)),
q AS (SELECT unnest(range(0, 600000, 7919))::DOUBLE AS v),
j AS (SELECT v, pieces.*, (v - low) / (high - low) AS t, high - low AS h FROM q LEFT JOIN pieces ON v >= low AND v <= high)
"""


@query("cdf_cubic", CUBIC + """SELECT v, round(max(CASE WHEN low IS NULL THEN CASE WHEN v < (SELECT min(x) FROM n) THEN 0 ELSE 1 END ELSE y0 * (1 + 2 * t) * (1 - t) * (1 - t) + m0 * h * t * (1 - t) * (1 - t) + y1 * t * t * (3 - 2 * t) - m1 * h * t * t * (1 - t) END), 9) AS cdf,
round(max(CASE WHEN low IS NULL THEN 0 ELSE 6 * t * (1 - t) * (y1 - y0) / h + m0 * (1 - t) * (1 - 3 * t) - m1 * t * (2 - 3 * t) END), 12) AS density FROM j GROUP BY v""")
def cdf_cubic(spark: SparkSession, sf: str) -> DataFrame:
    """The monotone cubic distribution of all order totals and its density at places over its whole range."""
    found = cubic.pieces(dist.cdf_points(table(spark, sf, "orders"), "o_totalprice"))
    q = spark.range(0, 600000, 7919).select(F.col("id").cast("double").alias("v"))
    both = cubic.evaluate(cubic.evaluate(q, found, "v", "cdf"), found, "v", "density", slope=True)
    return both.withColumns({"cdf": F.round("cdf", 9), "density": F.round("density", 12)})


@query("cdf_cubic_inverse")
def cdf_cubic_inverse(spark: SparkSession, sf: str) -> DataFrame:
    """The price of every part found again from its share in the cubic distribution of all prices."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("price"))
    found = cubic.pieces(dist.cdf_points(p, "price"))
    return cubic.invert(cubic.evaluate(p, found, "price", "share"), found, "share", "again")


@query("sketched_percentiles")
def sketched_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """All percentiles of the prices of all lines from a sketch, with the bound on the error of their ranks."""
    return sketch.quantile_table(table(spark, sf, "lineitem"), "l_extendedprice", list(range(101)))


@query("percentiles", """
SELECT unnest([0.0, 5.0, 25.0, 50.0, 75.0, 95.0, 100.0])::DOUBLE AS percent, unnest(list_transform(quantile_cont(o_totalprice, [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]), lambda x: round(x, 4))) AS value FROM orders""")
def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return dist.percentiles(table(spark, sf, "orders"), "o_totalprice", [0, 5, 25, 50, 75, 95, 100]).withColumn("value", F.round("value", 4))


@query("distribution_ks", """
WITH a AS (SELECT value AS x, sum(count(*)) OVER (ORDER BY value) / sum(count(*)) OVER () AS p FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT value AS x, sum(count(*)) OVER (ORDER BY value) / sum(count(*)) OVER () AS p FROM events WHERE event_type = 'click' GROUP BY 1),
an AS (SELECT * FROM a UNION ALL SELECT min(x) - pow(2, -26), 0 FROM a), bn AS (SELECT * FROM b UNION ALL SELECT min(x) - pow(2, -26), 0 FROM b), xs AS (SELECT x FROM an UNION SELECT x FROM bn),
j AS (SELECT xs.x, 'a' AS s, an.p, CASE WHEN an.p IS NOT NULL THEN xs.x END AS nx FROM xs LEFT JOIN an ON an.x = xs.x UNION ALL SELECT xs.x, 'b', bn.p, CASE WHEN bn.p IS NOT NULL THEN xs.x END FROM xs LEFT JOIN bn ON bn.x = xs.x),
y AS (SELECT x, s, last_value(p IGNORE NULLS) OVER u AS p0, last_value(nx IGNORE NULLS) OVER u AS x0, first_value(p IGNORE NULLS) OVER v AS p1, first_value(nx IGNORE NULLS) OVER v AS x1 FROM j
  WINDOW u AS (PARTITION BY s ORDER BY x ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY s ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
z AS (SELECT x, s, CASE WHEN x0 IS NULL THEN 0 WHEN x0 = x THEN p0 WHEN x1 IS NULL THEN 1 ELSE p0 + (p1 - p0) * (x - x0) / (x1 - x0) END AS p FROM y)
SELECT round(max(abs(m.p - n.p)), 9) AS ks FROM z m JOIN z n ON m.x = n.x AND m.s = 'a' AND n.s = 'b'""")
def distribution_ks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    a, b = (dist.cdf_points(e.where(F.col("event_type") == t), "value") for t in ("view", "click"))
    return dist.distribution_ks(a, b).select(F.round("ks", 9).alias("ks"))


@query("inverse_sampling")
def inverse_sampling(spark: SparkSession, sf: str) -> DataFrame:
    nodes = dist.cdf_points(table(spark, sf, "part"), "p_retailprice")
    u = spark.range(1000).select("id", ((F.col("id") + 0.5) / 1000).alias("u"))
    return dist.inverse_sample(u, nodes, "u", "price")


@query("smoothed_cdf")
def smoothed_cdf(spark: SparkSession, sf: str) -> DataFrame:
    nodes = dist.cdf_points(table(spark, sf, "part"), "p_retailprice")
    at = spark.range(0, 40).select((F.col("id") * 50.0).alias("v"))
    return dist.gauss_smooth(at, nodes, "v", 25.0)


@query("modes")
def modes(spark: SparkSession, sf: str) -> DataFrame:
    return dist.modes(dist.cdf_points(table(spark, sf, "orders"), "o_totalprice"), 0.05)


@query("combined_distributions")
def combined_distributions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    a, b = (dist.cdf_points(e.where(F.col("event_type") == t), "value") for t in ("view", "click"))
    return dist.combine(a, b)


@query("density_intervals", NODES.replace("pow(2, -26)", "pow(2, -26)") + "SELECT round(low, 6) AS low, round(high, 6) AS high FROM (SELECT lag(x) OVER (ORDER BY x) AS low, x AS high FROM n) WHERE low IS NOT NULL")
def density_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return dist.density(dist.cdf_points(table(spark, sf, "orders"), "o_totalprice")).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


FOLDS = """
WITH h AS (SELECT c_custkey, (c_custkey * 2654435761 + 1) % 4294967296 AS h FROM customer), p AS (SELECT c_custkey, row_number() OVER (ORDER BY h, c_custkey) - 1 AS place, (SELECT count(*) FROM customer) AS n FROM h),
f AS (SELECT c_custkey, (SELECT min(b) FROM range(0, 11) t(b) WHERE place < floor(0.5 + (b + 1) * n / 11))::INT AS fold FROM p)
"""


@query("kfold_sizes", FOLDS + "SELECT fold, count(*)::BIGINT AS n FROM f GROUP BY 1")
def kfold_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.k_fold(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 11, 1).groupBy("fold").agg(F.count("*").alias("n"))


@query("kfold_test_rows", FOLDS + "SELECT c_custkey FROM f WHERE fold = 3")
def kfold_test_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.fold_split(sampling.k_fold(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 11, 1), 3)[1]


@query("sample_rows", "SELECT o_orderkey FROM (SELECT o_orderkey, (o_orderkey * 2654435761 + 7) % 4294967296 AS h FROM orders) ORDER BY h, o_orderkey LIMIT 100")
def sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_rows(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 100, 7)


@query("random_range_values", "SELECT unnest(range(5, 500, 3))::BIGINT AS value")
def random_range_values(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.random_range(spark, 5, 500, 3).select("value")


@query("uniform_lcg", """
WITH RECURSIVE r(place, x) AS (SELECT 0::BIGINT, 12345::HUGEINT UNION ALL SELECT place + 1, (x * ((4 * (4294967296::HUGEINT + 1048573) + 1) % 4294967296) + 2 * 4091 + 1) % 4294967296 FROM r WHERE place < 999)
SELECT place, (x / 4294967296.0::DOUBLE)::DOUBLE AS u FROM r""")
def uniform_lcg(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.uniform_stream(spark, 1000, 12345)


@query("uniform_lcg_defaults", """
WITH RECURSIVE r(place, x) AS (SELECT 0::BIGINT, 2147483648::HUGEINT UNION ALL SELECT place + 1, (x * ((4 * (4294967296::HUGEINT + 1048573) + 1) % 4294967296) + 2 * 4091 + 1) % 4294967296 FROM r WHERE place < 499)
SELECT place, (x / 4294967296.0::DOUBLE)::DOUBLE AS u FROM r""")
def uniform_lcg_defaults(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.uniform_stream(spark, 500)


@query("latin_cells", "SELECT unnest(range(0, 200))::BIGINT AS cell, 3::BIGINT AS n")
def latin_cells(spark: SparkSession, sf: str) -> DataFrame:
    x = sampling.latin(spark, 200, 3)
    return x.select(F.explode(F.array("x0", "x1", "x2")).alias("v")).groupBy(F.floor(F.col("v") * 200).alias("cell")).agg(F.count("*").alias("n"))


@query("ball_radii", "SELECT 500::BIGINT AS n, true AS inside")
def ball_radii(spark: SparkSession, sf: str) -> DataFrame:
    b = sampling.ball(spark, 500, 3, 2.0, 5)
    r = F.sqrt(F.col("x0") ** 2 + F.col("x1") ** 2 + F.col("x2") ** 2)
    return b.agg(F.count("*").alias("n"), (F.max(r) <= 2.0 + 1e-9).alias("inside"))


@query("latin_sphere_points")
def latin_sphere_points(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.latin_sphere(spark, 200, 3)


@query("test_corpus_parts")
def test_corpus_parts(spark: SparkSession, sf: str) -> DataFrame:
    t = sampling.test_corpus(table(spark, sf, "part"), ["p_size", "p_brand"], "p_retailprice", [0.5, 0.9], [1, 2])
    return t.groupBy("subset", "split", "seed", "part").agg(F.count("*").alias("n"))


@query("metric_pairs")
def metric_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.metric_pairs(table(spark, sf, "embeddings"), "vec_id", "embedding", "label", 200)
