"""Queries of scalar functions, user functions and optimisers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import maths, optimize, parallel
from tessella.operators import distribution as dist
from tessella.operators import splines

from .registry import query, table


@query("primes", """
WITH n AS (SELECT range AS n FROM range(0, 300)) SELECT n::BIGINT AS n, (n < 4 OR NOT EXISTS (SELECT 1 FROM range(2, 18) d(d) WHERE d * d <= n AND n % d = 0)) AS prime FROM n""")
def primes(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(300).select(F.col("id").alias("n"), maths.is_prime(F.col("id")).alias("prime"))


@query("primes_up_to", "SELECT n::BIGINT AS prime FROM range(1, 201) t(n) WHERE n < 4 OR NOT EXISTS (SELECT 1 FROM range(2, 15) d(d) WHERE d * d <= n AND n % d = 0)")
def primes_up_to(spark: SparkSession, sf: str) -> DataFrame:
    return maths.primes_up_to(spark, 200)


@query("prime_factors", """
WITH RECURSIVE f(n, rest, d, out) AS (SELECT n, n, 2, '' FROM range(2, 150) t(n) UNION ALL
  SELECT n, CASE WHEN rest % d = 0 THEN rest // d ELSE rest END, CASE WHEN rest % d = 0 THEN d ELSE d + 1 END, CASE WHEN rest % d = 0 THEN out || (CASE WHEN out = '' THEN '' ELSE ',' END) || d ELSE out END FROM f WHERE rest > 1)
SELECT n::BIGINT AS n, out AS factors FROM f WHERE rest = 1""")
def prime_factors(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(2, 150).select(F.col("id").alias("n"), F.array_join(F.transform(maths.prime_factors(F.col("id")), lambda x: x.cast("string")), ",").alias("factors"))


@query("choose", "SELECT n::BIGINT AS n, k::BIGINT AS k, (factorial(n::INT) / (factorial(k::INT) * factorial((n - k)::INT)))::BIGINT AS c FROM range(0, 21) a(n), range(0, 21) b(k) WHERE k <= n")
def choose(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.range(21).select(F.col("id").alias("n")).join(spark.range(21).select(F.col("id").alias("k")), F.col("k") <= F.col("n"))
    return n.withColumn("c", maths.choose(F.col("n"), F.col("k")).cast("bigint"))


@query("pick", "SELECT s::BIGINT AS s, round(s / 50.0::DOUBLE, 9) AS p FROM range(0, 51) t(s)")
def pick(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(51).select(F.col("id").alias("s"), F.round(maths.pick(F.col("id"), F.lit(50)), 9).alias("p"))


@query("accuracy_measures", "SELECT p_partkey, round(abs(log2(p_retailprice / (p_size + 0.5))), 9) AS magnitude, round(abs(p_retailprice - p_size), 6) AS gap, round(pow(p_retailprice, 1.0 / 3), 9) AS cube FROM part")
def accuracy_measures(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.round(maths.oom_error(F.col("p_retailprice"), F.col("p_size") + 0.5), 9).alias("magnitude"), F.round(maths.abs_diff(F.col("p_retailprice"), F.col("p_size")), 6).alias("gap"), F.round(maths.root(F.col("p_retailprice"), F.lit(3)), 9).alias("cube"))


@query("bit_accuracy", "SELECT p_partkey, round(-log2(abs(log2(p_retailprice / (p_size + 0.5)))), 6) AS bits FROM part")
def bit_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.round(maths.bit_accuracy(F.col("p_retailprice"), F.col("p_size") + 0.5), 6).alias("bits"))


@query("chebyshev", "SELECT i::BIGINT AS place, round((1 - cos((2 * i + 1) * pi() / 32)) / 2, 12) AS x FROM range(0, 16) t(i)")
def chebyshev(spark: SparkSession, sf: str) -> DataFrame:
    return maths.chebyshev(spark, 16).withColumn("x", F.round("x", 12))


@query("polar_mesh", """
SELECT 0.5::DOUBLE AS x0, 0.5::DOUBLE AS x1 UNION ALL
SELECT round((r * cos(a) + 1) / 2, 9), round((r * sin(a) + 1) / 2, 9) FROM (SELECT 0.5 * (1 + cos(j * pi() / 6)) AS r, 2 * pi() * i / 13 AS a FROM range(1, 6) u(j), range(0, 13) v(i))""")
def polar_mesh(spark: SparkSession, sf: str) -> DataFrame:
    return maths.polar_mesh(spark, 6).select(F.round("x0", 9).alias("x0"), F.round("x1", 9).alias("x1"))


@query("box_mesh_nodes", "SELECT round(0.5 * (1 + cos(i * pi() / 5)), 9) AS x0, round(0.5 * (1 + cos(j * pi() / 5)), 9) AS x1 FROM range(0, 6) u(i), range(0, 6) v(j)")
def box_mesh_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return maths.box_mesh_nodes(spark, 5).select(F.round("x0", 9).alias("x0"), F.round("x1", 9).alias("x1"))


@query("test_functions", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), w AS (SELECT list(range) AS i, list_sum(list(pow(0.5, range) * cos(pi() * pow(3, range)))) AS rest FROM range(0, 11))
SELECT vec_id, round(list_sum(list_transform(x, lambda v: pow(abs(v), 4.0 / 3))) / len(x), 9) AS mejr,
  round(list_sum(list_transform(x, lambda v: pow(v, 4))) / len(x), 9) AS basin,
  round(list_sum(list_transform(x, lambda v: pow(0.75, 4) * pow(v, 2) / 2 - pow(0.75, 2) * pow(v, 4) / 2 + pow(v, 6) / 6)) / (len(x) * (1.0 / 6 - pow(0.75, 2) / 2 + pow(0.75, 4) / 2)), 7) AS saddle,
  round((len(x) + 2 * list_sum(list_transform(x, lambda v: pow(v, 2))) + list_sum(list_transform(x, lambda v: 32 * pow(v, 6) - 48 * pow(v, 4) + 18 * pow(v, 2) - 1))) / (4 * len(x)), 9) AS multimin,
  round(list_sum(list_transform(x, lambda v: list_sum(list_transform(i, lambda k: pow(0.5, k) * cos(pi() * pow(3, k) * (v + 1)))) - rest)) / (3.998046875 * len(x)), 6) AS weierstrass,
  round(cos(pow(sqrt(list_sum(list_transform(x, lambda v: pow(v / 2, 2)))), 1.5) * 5 * pi()), 6) AS cosine FROM e, w""")
def test_functions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    x = F.col("x")
    return e.select("vec_id", F.round(maths.steep(x), 9).alias("mejr"), F.round(maths.basin(x), 9).alias("basin"), F.round(maths.saddle(x), 7).alias("saddle"), F.round(maths.many_minima(x), 9).alias("multimin"),
                    F.round(maths.weierstrass(x), 6).alias("weierstrass"), F.round(maths.cosine_norm(x, 2.0, 3, 1.5), 6).alias("cosine"))


@query("test_transforms")
def test_transforms(spark: SparkSession, sf: str) -> DataFrame:
    """Skewed, recentred, rotated in the plane of the first two coordinates, with noise."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    dims = e.select(F.max(F.size("x"))).first()[0]
    c, s = math.cos(0.3), math.sin(0.3)
    turn = [[{(0, 0): c, (0, 1): -s, (1, 0): s, (1, 1): c}.get((i, j), float(i == j)) for j in range(dims)] for i in range(dims)]
    moved = maths.rotated(maths.recentred(maths.skewed(F.col("x")), [0.1] * dims), turn)
    return e.select("vec_id", maths.noisy(maths.basin(moved), F.col("vec_id")).alias("value"))


@query("fractions", """
WITH f AS (SELECT n_nationkey + 1 AS a, n_regionkey + 2 AS b FROM nation), g AS (SELECT *, a * 3 + b * 2 AS num, b * 3 AS den FROM f)
SELECT a, b, (num // gcd(num, den))::BIGINT AS num, (den // gcd(num, den))::BIGINT AS den FROM g""")
def fractions(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "nation").select((F.col("n_nationkey") + 1).alias("a"), (F.col("n_regionkey") + 2).alias("b"))
    s = maths.fraction_add(maths.fraction(F.col("a"), F.col("b")), maths.fraction(F.lit(2), F.lit(3)))
    return f.withColumn("s", s).select("a", "b", "s.num", "s.den")


@query("horner", "SELECT p_partkey, round(2.0 * pow(p_size, 3) - 5.0 * pow(p_size, 2) + 0.5 * p_size + 7, 6) AS value, round(6.0 * pow(p_size, 2) - 10.0 * p_size + 0.5, 6) AS slope FROM part")
def horner(spark: SparkSession, sf: str) -> DataFrame:
    c = F.array(*[F.lit(v) for v in (2.0, -5.0, 0.5, 7.0)])
    x = F.col("p_size").cast("double")
    return table(spark, sf, "part").select("p_partkey", F.round(maths.horner(c, x), 6).alias("value"), F.round(maths.horner(maths.derivative(c), x), 6).alias("slope"))


@query("spline")
def spline(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "part").groupBy("p_size").agg(F.avg("p_retailprice").alias("m"))
    at = spark.range(0, 200).select((F.col("id") / 4).alias("x"))
    return maths.spline_eval(at, maths.spline_pieces(nodes, "p_size", "m"), "x")


def _spend(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").cast("double").alias("x"), F.col("o_totalprice").alias("y"))


@query("spline_natural")
def spline_natural(spark: SparkSession, sf: str) -> DataFrame:
    """The spline through all orders with two continuous derivatives, between the orders and at them."""
    nodes = _spend(spark, sf)
    found = splines.kept(splines.cubic(nodes, block=4096), "natural")
    at = nodes.select((F.col("x") + 0.25).alias("v"))
    return splines.evaluate(splines.evaluate(at, found, "v"), found, "v", "bend", 2)


@query("spline_local")
def spline_local(spark: SparkSession, sf: str) -> DataFrame:
    """A spline with one continuous derivative out of parabolas through three neighbours."""
    nodes = _spend(spark, sf)
    found = splines.kept(splines.fit(nodes, 2), "local")
    return splines.evaluate(nodes.select((F.col("x") + 0.25).alias("v")), found, "v")


@query("newton_polynomial", "SELECT i::BIGINT AS i, round(pow(i / 10.0, 3) - 2 * (i / 10.0) + 1, 6) AS value FROM range(0, 50) t(i)")
def newton_polynomial(spark: SparkSession, sf: str) -> DataFrame:
    xs = [0.0, 1.0, 2.0, 4.0]
    c = maths.newton_polynomial(xs, [x**3 - 2 * x + 1 for x in xs])
    return spark.range(50).select(F.col("id").alias("i"), F.round(maths.newton_value(xs, c, F.col("id") / 10.0), 6).alias("value"))


@query("redistribute", "SELECT p_partkey, round(cume_dist() OVER (ORDER BY p_retailprice), 9) AS u FROM part")
def redistribute(spark: SparkSession, sf: str) -> DataFrame:
    return maths.redistributed(table(spark, sf, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"]).select("p_partkey", F.round("p_retailprice", 9).alias("u"))


@query("resample", "SELECT n_regionkey, array_to_string(list_transform(quantile_cont(n_nationkey::DOUBLE, [0.0, 0.25, 0.5, 0.75, 1.0]), lambda x: printf('%.3f', x)), ',') AS v FROM nation GROUP BY 1")
def resample(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.col("n_nationkey").cast("double"))).alias("v"))
    return n.select("n_regionkey", F.array_join(F.transform(maths.resample(F.col("v"), 5), lambda x: F.format_string("%.3f", x)), ",").alias("v"))


@query("split_quoted", "SELECT p_partkey, 3 AS cells, p_name || ', ' || p_brand AS second FROM part")
def split_quoted(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.col("p_partkey"), F.lit(' , "'), F.col("p_name"), F.lit(", "), F.col("p_brand"), F.lit('",'), F.col("p_type"))
    c = maths.split_quoted(line, ",")
    return table(spark, sf, "part").select("p_partkey", F.size(c).alias("cells"), c[1].alias("second"))


@query("simplified_numbers", "SELECT p_partkey, regexp_replace(regexp_replace(printf('%.5e', p_retailprice), 'e\\+0*([0-9])', 'e\\1'), 'e-0*([0-9])', 'e-\\1') AS text FROM part")
def simplified_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", maths.simplified(F.col("p_retailprice"), 5).alias("text"))


@query("parallel_map", "SELECT i::BIGINT AS place, (i * i)::BIGINT AS result FROM range(0, 100) t(i)")
def parallel_map(spark: SparkSession, sf: str) -> DataFrame:
    return parallel.parallel_map(spark, lambda x: x * x, range(100), "bigint")


@query("map_column", "SELECT r_regionkey, reverse(r_name) AS back FROM region")
def map_column(spark: SparkSession, sf: str) -> DataFrame:
    return parallel.map_column(table(spark, sf, "region"), "r_name", lambda s: s[::-1], "back").select("r_regionkey", "back")


@query("sort_by_function", "SELECT (row_number() OVER (ORDER BY length(n_name), n_name) - 1)::BIGINT AS place, n_name FROM nation")
def sort_by_function(spark: SparkSession, sf: str) -> DataFrame:
    """The places in the order of a Python key; names of one length in the order of the names."""
    from tessella.operators.frame import numbered

    got = parallel.sort_by(table(spark, sf, "nation").select("n_name").orderBy("n_name"), "n_name", lambda s: len(s) + sum(ord(c) / 200 ** (i + 2) for i, c in enumerate(s[:5])))
    return numbered(got.select("n_name", F.monotonically_increasing_id().alias("at")), ["at"], "place").select(F.col("place").cast("bigint").alias("place"), "n_name")


@query("split_rows", "SELECT part::INT AS part, count(*)::BIGINT AS n, min(o_orderkey) AS first, sum(o_orderkey)::BIGINT AS total FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) % 7 AS part FROM orders) GROUP BY 1")
def split_rows(spark: SparkSession, sf: str) -> DataFrame:
    got = parallel.split_rows(table(spark, sf, "orders"), 7, "o_orderkey")
    return got.groupBy(F.col("part").cast("int").alias("part")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.sum("o_orderkey").cast("bigint").alias("total"))


@query("table_function", "SELECT n_regionkey, (i - 1)::INT AS place, v[i]::VARCHAR AS value FROM (SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS v, unnest(range(1, count(*) + 1)) AS i FROM nation GROUP BY 1)")
def table_function(spark: SparkSession, sf: str) -> DataFrame:
    parallel.register_unstack(spark)
    table(spark, sf, "nation").createOrReplaceTempView("tessella_nation")
    return spark.sql("SELECT n_regionkey, u.place, u.value FROM (SELECT n_regionkey, array_sort(collect_list(n_nationkey)) AS v FROM tessella_nation GROUP BY 1) t, LATERAL unstack_list(t.v) u")


@query("batch_minimum")
def batch_minimum(spark: SparkSession, sf: str) -> DataFrame:
    x, f = optimize.batch_minimize(spark, maths.many_minima, [(-1, 1), (-1, 1)], 2000)
    return spark.createDataFrame([(x[0], x[1], f)], "x double, y double, f double")


@query("minimizers", "SELECT unnest(['adagrad', 'adam', 'adaptive_normal', 'ampgo', 'direct', 'l_bfgs', 'random', 'sgd']) AS method, true AS near")
def minimizers(spark: SparkSession, sf: str) -> DataFrame:
    """Whether every method comes near the minimum of a bowl, 0 at (0.3, -0.2)."""
    f = lambda v: (v[0] - 0.3) ** 2 + (v[1] + 0.2) ** 2
    rows = [(m, abs(float(optimize.minimize(f, bounds=[(-1, 1), (-1, 1)], method=m, max_steps=400).best)) < 0.01) for m in sorted(optimize.METHODS)]
    return spark.createDataFrame(rows, "method string, near boolean")


@query("line_searches", "SELECT 'binary' AS method, round(pow(2, 1.0 / 3), 5) AS x UNION ALL SELECT 'false_position', round(pow(2, 1.0 / 3), 5) UNION ALL SELECT 'golden_section', 1.5")
def line_searches(spark: SparkSession, sf: str) -> DataFrame:
    rows = [("binary", optimize.binary_search(lambda x: x**3 - 2, 0, 2)), ("false_position", optimize.false_position(lambda x: x**3 - 2, 0, 2)), ("golden_section", optimize.golden_section(lambda x: (x - 1.5) ** 2, 0, 4))]
    return spark.createDataFrame(rows, "method string, x double").withColumn("x", F.round("x", 5))


@query("descent_fit")
def descent_fit(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select((F.col("p_size") / 50.0).alias("a"), (F.col("p_size") / 10.0 + 1).alias("y"))
    w = optimize.least_squares_descent(p, ["a"], "y", 20)
    return spark.createDataFrame([tuple(w)], "slope double, intercept double")


@query("approximate_percentiles", "SELECT unnest([5.0, 50.0, 95.0])::DOUBLE AS percent, true AS near")
def approximate_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the share of rows up to each approximate percentile is within a thousandth of the percent."""
    lines = table(spark, sf, "lineitem").select("l_extendedprice")
    got = dist.approximate_percentiles(lines, "l_extendedprice", [5, 50, 95])
    share = lines.crossJoin(F.broadcast(got)).groupBy("percent").agg((F.count_if(F.col("l_extendedprice") < F.col("value")) / F.count("*")).alias("below"), (F.count_if(F.col("l_extendedprice") <= F.col("value")) / F.count("*")).alias("upto"))  # three rows
    return share.select(F.col("percent").cast("double").alias("percent"), ((F.col("below") <= F.col("percent") / 100 + 0.001) & (F.col("upto") >= F.col("percent") / 100 - 0.001)).alias("near"))
