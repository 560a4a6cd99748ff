"""Queries of encoding, mining and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import encoding, fekete, gradients, meshes, mining, models, plrm as networks

from .registry import query, table


@query("encode_stats", """
SELECT 'c_acctbal' AS "column", 'number' AS kind, NULL::VARCHAR AS value, 0 AS rank, count(DISTINCT c_acctbal)::BIGINT AS n, round(avg(c_acctbal), 6) AS mean FROM customer UNION ALL
SELECT 'c_mktsegment', 'category', c_mktsegment, (row_number() OVER (ORDER BY count(*) DESC, min(c_custkey)) - 1)::INT, count(*)::BIGINT, NULL FROM customer GROUP BY c_mktsegment""")
def encode_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return encoding.encode_stats(c, order="c_custkey").withColumn("mean", F.round("mean", 6))


@query("minmax_scale", "SELECT p_partkey, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())::DOUBLE, 9) AS p_size FROM part")
def minmax_scale(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.min_max_scaled(table(spark, sf, "part").select("p_partkey", "p_size"), ["p_size"]).withColumn("p_size", F.round("p_size", 9))


@query("minmax_parameters", """SELECT 'p_size' AS "column", min(p_size)::DOUBLE AS shift, (max(p_size) - min(p_size))::DOUBLE AS scale FROM part UNION ALL SELECT 'p_retailprice', min(p_retailprice), max(p_retailprice) - min(p_retailprice) FROM part""")
def minmax_parameters(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.min_max(table(spark, sf, "part"), ["p_size", "p_retailprice"])


@query("normalize_deviation", "SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 6) AS p_retailprice FROM part")
def normalize_deviation(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.normalized(table(spark, sf, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"]).withColumn("p_retailprice", F.round("p_retailprice", 6))


@query("normalize_variance", "SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT var_pop(p_retailprice) FROM part), 9) AS p_retailprice FROM part")
def normalize_variance(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.normalized(table(spark, sf, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"], "variance").withColumn("p_retailprice", F.round("p_retailprice", 9))


@query("impute_mean", "SELECT p_partkey, round(coalesce(nullif(p_size, 7), (SELECT avg(nullif(p_size, 7)) FROM part))::DOUBLE, 9) AS p_size FROM part")
def impute_mean(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.nullif("p_size", F.lit(7)).alias("p_size"))
    return encoding.impute_mean(p, ["p_size"]).withColumn("p_size", F.round("p_size", 9))


@query("matrix_roundtrip", "SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, c_mktsegment FROM customer")
def matrix_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as numbers and back again."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    enc = encoding.NumericEncoding.fit(c, order="c_custkey")
    return enc.from_matrix(enc.to_matrix(c).drop("c_nationkey", "c_mktsegment")).select("c_custkey", "c_nationkey", "c_mktsegment")


@query("simplex_codes", "SELECT c_custkey, 4 AS dims, 1.0::DOUBLE AS distance FROM customer WHERE c_mktsegment <> (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, min(c_custkey) LIMIT 1)")
def simplex_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Every category but the commonest lies one unit away from the commonest's corner, the origin."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    enc = encoding.NumericEncoding.fit(c, order="c_custkey")
    v = enc.to_matrix(c)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return v.select("c_custkey", F.size("vector").alias("dims"), F.round(norm, 9).alias("distance")).where("distance > 0")


@query("row_hashes", "SELECT r_regionkey, sha256('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}') AS h FROM region")
def row_hashes(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region")
    return r.select("r_regionkey", encoding.row_hash(r, ["r_regionkey", "r_name"]).alias("h"))


@query("group_product", "SELECT n_regionkey, product(n_nationkey + 1)::DOUBLE AS p FROM nation GROUP BY 1")
def group_product(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").withColumn("v", F.col("n_nationkey") + 1).groupBy("n_regionkey").agg(encoding.product("v").alias("p"))


def _components(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """(vec_id, label and each component of the vectors as a column, the columns' names)."""
    e = table(spark, sf, "embeddings")
    cols = [f"e{i}" for i in range(e.select(F.max(F.size("embedding"))).first()[0])]
    return e.select("vec_id", F.col("label").cast("double").alias("y"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)]), cols


@query("pca_weights")
def pca_weights(spark: SparkSession, sf: str) -> DataFrame:
    e, cols = _components(spark, sf)
    comps, weights = encoding.pca(e, cols, 3)
    return encoding.project(e, cols, comps * weights[:, None]).select("vec_id", "pc1", "pc2", "pc3")


@query("metric_pca")
def metric_pca(spark: SparkSession, sf: str) -> DataFrame:
    e, cols = _components(spark, sf)
    return encoding.conditioned(e, cols, "MPCA", "vec_id", "y").select("vec_id", "pc1", "pc2", "pc3", "pc4")


ITEMS = "WITH t AS (SELECT DISTINCT l_orderkey AS t, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT t) AS n FROM t)"


@query("frequent_itemsets_1_2_3", ITEMS + """, a AS (SELECT i AS items, 1 AS size, count(*) AS c FROM t GROUP BY 1 HAVING count(*) >= 0.02 * (SELECT n FROM n)),
b AS (SELECT x.i || ',' || y.i AS items, 2 AS size, count(*) AS c FROM t x JOIN t y ON x.t = y.t AND x.i < y.i GROUP BY 1 HAVING count(*) >= 0.02 * (SELECT n FROM n)),
d AS (SELECT x.i || ',' || y.i || ',' || z.i AS items, 3 AS size, count(*) AS c FROM t x JOIN t y ON x.t = y.t AND x.i < y.i JOIN t z ON y.t = z.t AND y.i < z.i GROUP BY 1 HAVING count(*) >= 0.02 * (SELECT n FROM n))
SELECT items, size, c::BIGINT AS n, round(c / (SELECT n FROM n), 9) AS support FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM d)""")
def frequent_itemsets_1_2_3(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")
    got = mining.frequent_itemsets(rows, "l_orderkey", "p_brand", 0.02, 3, 10_000)
    return got.select(F.array_join("items", ",").alias("items"), "size", "n", F.round("support", 9).alias("support"))


@query("frequent_itemsets_fp", """
WITH RECURSIVE t AS (SELECT DISTINCT user_id AS t, event_type AS i FROM events), n AS (SELECT 0.3 * count(DISTINCT t) AS least FROM t),
s(t, items, last) AS (SELECT t, i, i FROM t UNION ALL SELECT s.t, s.items || ',' || t.i, t.i FROM s JOIN t ON s.t = t.t AND t.i > s.last)
SELECT items, count(*)::BIGINT AS n FROM s GROUP BY 1 HAVING count(*) >= (SELECT least FROM n)""")
def frequent_itemsets_fp(spark: SparkSession, sf: str) -> DataFrame:
    """Itemsets of every size."""
    got = mining.frequent_itemsets_fp(table(spark, sf, "events"), "user_id", "event_type", 0.3)
    return got.select(F.array_join(F.array_sort("items"), ",").alias("items"), "n")


@query("cube_averages", "SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS mean, grouping(l_returnflag, l_linestatus)::BIGINT AS subset FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_averages(spark: SparkSession, sf: str) -> DataFrame:
    got = models.subset_averages(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return got.select("l_returnflag", "l_linestatus", F.round("l_extendedprice", 4).alias("mean"), "subset")


@query("avg_duplicates", "SELECT p_brand, p_size, round(avg(p_retailprice), 4) AS p_retailprice FROM part GROUP BY 1, 2")
def avg_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return models.unique_points(table(spark, sf, "part"), ["p_brand", "p_size"], "p_retailprice").withColumn("p_retailprice", F.round("p_retailprice", 4))


VEC = "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), d AS (SELECT q.vec_id AS query_id, p.vec_id, p.label::DOUBLE AS y, sqrt(list_sum(list_transform(list_zip(q.e, p.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM v q, v p WHERE q.vec_id % 50 = 0 AND p.vec_id % 50 <> 0)"


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(queries, points): the vectors whose id is divisible by 50, and all others."""
    v = table(spark, sf, "embeddings")
    return v.where("vec_id % 50 = 0"), v.where("vec_id % 50 <> 0")


@query("knn_predict", VEC + "SELECT query_id, round(avg(y), 9) AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS k FROM d) WHERE k <= 4 GROUP BY 1")
def knn_predict(spark: SparkSession, sf: str) -> DataFrame:
    q, p = _split(spark, sf)
    return models.predict_weighted(models.knn_weights(q, p, 4, "vec_id", "vec_id", "embedding"), p, "vec_id", "label").withColumn("prediction", F.round("prediction", 9))


@query("knn_classify", VEC + """, w AS (SELECT query_id, y, count(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS k FROM d) WHERE k <= 5 GROUP BY 1, 2)
SELECT query_id, y::INT AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, y) AS r FROM w) WHERE r = 1""")
def knn_classify(spark: SparkSession, sf: str) -> DataFrame:
    q, p = _split(spark, sf)
    return models.classify_weighted(models.knn_weights(q, p, 5, "vec_id", "vec_id", "embedding"), p, "vec_id", "label")


@query("average_model", "SELECT round(avg(p_retailprice), 6) AS prediction FROM part")
def average_model(spark: SparkSession, sf: str) -> DataFrame:
    return models.average(table(spark, sf, "part"), "p_retailprice").withColumn("prediction", F.round("prediction", 6))


@query("shepard_predict", VEC + "SELECT query_id, round(sum(y / (d * d)) / sum(1 / (d * d)), 9) AS prediction FROM d GROUP BY 1")
def shepard_predict(spark: SparkSession, sf: str) -> DataFrame:
    q, p = _split(spark, sf)
    return models.shepard_predict(q, p, "vec_id", "vec_id", "embedding", "label").withColumn("prediction", F.round("prediction", 9))


@query("shepard_weights", VEC + "SELECT query_id, vec_id, round((1 / (d * d)) / sum(1 / (d * d)) OVER (PARTITION BY query_id), 9) AS weight FROM d")
def shepard_weights(spark: SparkSession, sf: str) -> DataFrame:
    q, p = _split(spark, sf)
    return models.shepard_weights(q, p, "vec_id", "vec_id", "embedding").withColumn("weight", F.round("weight", 9))


@query("shepmod_predict", """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
a AS (SELECT q.vec_id AS qid, p.vec_id, p.label::DOUBLE AS y, sqrt(list_sum(list_transform(list_zip(q.e, p.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM v q, v p WHERE p.vec_id % 50 <> 0),
r AS (SELECT qid AS vec_id, max(d) AS r FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS k FROM a WHERE qid % 50 <> 0 AND qid <> vec_id) WHERE k <= 11 GROUP BY 1),
d AS (SELECT a.*, r, max((d < r)::INT) OVER (PARTITION BY qid) AS any_in, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS k FROM a JOIN r USING (vec_id) WHERE qid % 50 = 0),
w AS (SELECT qid, y, CASE WHEN any_in = 1 THEN CASE WHEN d < r THEN pow((r - d) / (r * d), 2) ELSE 0 END WHEN k <= 11 THEN 1 / (d * d) ELSE 0 END AS w FROM d)
SELECT qid AS query_id, round(sum(w * y) / sum(w), 9) AS prediction FROM w GROUP BY 1""")
def shepmod_predict(spark: SparkSession, sf: str) -> DataFrame:
    q, p = _split(spark, sf)
    w = models.modified_shepard_weights(q, p, "vec_id", "vec_id", "embedding", 10)
    return models.predict_weighted(w, p, "vec_id", "label").withColumn("prediction", F.round("prediction", 9))


@query("linear_fit", "SELECT round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 4) AS intercept, round(regr_r2(p_retailprice, p_size), 9) AS r2 FROM part")
def linear_fit(spark: SparkSession, sf: str) -> DataFrame:
    got = models.simple_regression(table(spark, sf, "part"), "p_size", "p_retailprice")
    return got.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 9).alias("r2"))


@query("linear_model_predict", "SELECT p_partkey, round(s * p_size + i, 3) AS prediction FROM part, (SELECT regr_slope(p_retailprice, p_size) AS s, regr_intercept(p_retailprice, p_size) AS i FROM part)")
def linear_model_predict(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return models.linear_fit(p, ["p_size"], "p_retailprice").predict(p).select("p_partkey", F.round("prediction", 3).alias("prediction"))


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_partkey") % 97).cast("double").alias("b"), F.col("p_retailprice").alias("y"))


@query("poly_fit")
def poly_fit(spark: SparkSession, sf: str) -> DataFrame:
    p = _parts(spark, sf)
    return models.polynomial_fit(p, ["a", "b"], "y", 3).predict(p).select("p_partkey", "prediction")


@query("linear_gradient", "SELECT p_partkey, round(s, 9) AS slope FROM part, (SELECT regr_slope(p_retailprice, p_size) AS s FROM part)")
def linear_gradient(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    got = gradients.gradient(models.linear_fit(p, ["p_size"], "p_retailprice"), p)
    return got.select("p_partkey", F.round(F.col("gradient")[0], 9).alias("slope"))


@query("polynomial_gradient")
def polynomial_gradient(spark: SparkSession, sf: str) -> DataFrame:
    """Both slopes of a cubic surface over all parts, at every part."""
    p = _parts(spark, sf)
    return gradients.gradient(models.polynomial_fit(p, ["a", "b"], "y", 3), p).select("p_partkey", F.col("gradient")[0].alias("by_a"), F.col("gradient")[1].alias("by_b"))


@query("shepard_gradient")
def shepard_gradient(spark: SparkSession, sf: str) -> DataFrame:
    q, p = _planes(spark, sf)
    got = gradients.shepard_gradient(q, p, "c_custkey", "c_custkey", "x", "y")
    return got.select("query_id", "prediction", F.col("gradient")[0].alias("by_0"), F.col("gradient")[1].alias("by_1"))


@query("vandermonde")
def vandermonde(spark: SparkSession, sf: str) -> DataFrame:
    """A cubic surface through the ten best placed of all parts."""
    p = _parts(spark, sf)
    model = fekete.fit(p, ["a", "b"], "y", 3)
    used = p.select("p_partkey", F.struct("a", "b", "y").isin([F.struct(*[F.lit(v) for v in r]) for r in model.points.tolist()]).alias("chosen"))
    return model.predict(p).join(used, "p_partkey").select("p_partkey", "prediction", "chosen")


@query("decision_tree")
def decision_tree(spark: SparkSession, sf: str) -> DataFrame:
    p = _parts(spark, sf)
    _, predict = models.decision_tree(p, ["a", "b"], "y")
    return predict(p).select("p_partkey", "prediction")


@query("svr")
def svr(spark: SparkSession, sf: str) -> DataFrame:
    p = _parts(spark, sf)
    return models.svr_fit(p, ["a", "b"], "y").predict(p).select("p_partkey", "prediction")


@query("mars")
def mars(spark: SparkSession, sf: str) -> DataFrame:
    p = _parts(spark, sf)
    return models.mars_fit(p, ["a", "b"], "y", 9).predict(p).select("p_partkey", "prediction")


@query("neural_network")
def neural_network(spark: SparkSession, sf: str) -> DataFrame:
    p = _parts(spark, sf)
    return models.network_fit(p, ["a", "b"], "y", steps=200).predict(p).select("p_partkey", "prediction")


@query("plrm")
def plrm(spark: SparkSession, sf: str) -> DataFrame:
    p = _parts(spark, sf)
    return models.plrm_fit(p, ["a", "b"], "y", steps=200).predict(p).select("p_partkey", "prediction")


@query("plrm_categories")
def plrm_categories(spark: SparkSession, sf: str) -> DataFrame:
    """The amount of every sale line from its quantity and its item, an integer without an order."""
    lines = table(spark, sf, "sale_lines").select("sale_id", "line_no", F.col("quantity").cast("double").alias("quantity"), "item_id", F.col("amount").alias("y"))
    return networks.fit(lines, ["quantity"], ["item_id"], "y", steps=100).predict(lines)


@query("split_model")
def split_model(spark: SparkSession, sf: str) -> DataFrame:
    p = _parts(spark, sf)
    return models.split_fit(p, p, "p_partkey", 3, lambda d: models.linear_fit(d, ["a", "b"], "y")).select("p_partkey", "prediction")


@query("embedding_interpolator")
def embedding_interpolator(spark: SparkSession, sf: str) -> DataFrame:
    p = _parts(spark, sf)
    return models.embedding_interpolator(p.where("p_partkey % 50 <> 0"), p.where("p_partkey % 50 = 0"), ["a", "b"], "y", "p_partkey", "p_partkey", steps=100)


def _planes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(queries, points) in two dimensions: customers whose key is divisible by 50, and all others, equal points as one."""
    p = table(spark, sf, "customer").select("c_custkey", F.array(F.col("c_nationkey").cast("double") + F.pmod("c_custkey", F.lit(13)) / 13.0, F.col("c_acctbal") / 1000).alias("x"), (F.col("c_acctbal") * 0.5).alias("y"))
    points = p.where("c_custkey % 50 <> 0").groupBy("x").agg(F.min("c_custkey").alias("c_custkey"), F.avg("y").alias("y")).select("c_custkey", "x", "y")
    return p.where("c_custkey % 50 = 0"), points


@query("lshep")
def lshep(spark: SparkSession, sf: str) -> DataFrame:
    q, p = _planes(spark, sf)
    return models.linear_shepard_predict(q, p, models.linear_shepard_fit(p, "c_custkey", "x", "y"), "c_custkey", "c_custkey", "x", "y")


@query("voronoi")
def voronoi(spark: SparkSession, sf: str) -> DataFrame:
    q, p = _planes(spark, sf)
    return models.predict_weighted(models.voronoi_weights(q, p, "c_custkey", "c_custkey", "x"), p, "c_custkey", "y")


@query("boxmesh")
def boxmesh(spark: SparkSession, sf: str) -> DataFrame:
    q, p = _planes(spark, sf)
    return models.predict_weighted(models.box_mesh_weights(q, p, "c_custkey", "c_custkey", "x"), p, "c_custkey", "y")


@query("delaunay")
def delaunay(spark: SparkSession, sf: str) -> DataFrame:
    q, p = _planes(spark, sf)
    return models.predict_weighted(models.delaunay_weights(q, p, "c_custkey", "c_custkey", "x"), p, "c_custkey", "y")


@query("voronoi_cells")
def voronoi_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The mesh by searches in cells, as it is beyond what a task holds."""
    q, p = _planes(spark, sf)
    return models.predict_weighted(meshes.voronoi_weights(q, p, "c_custkey", "c_custkey", "x"), p, "c_custkey", "y")


@query("boxmesh_cells")
def boxmesh_cells(spark: SparkSession, sf: str) -> DataFrame:
    q, p = _planes(spark, sf)
    return models.predict_weighted(meshes.box_mesh_weights(q, p, "c_custkey", "c_custkey", "x"), p, "c_custkey", "y")


@query("delaunay_cells")
def delaunay_cells(spark: SparkSession, sf: str) -> DataFrame:
    q, p = _planes(spark, sf)
    return models.predict_weighted(meshes.delaunay_weights(q, p, "c_custkey", "c_custkey", "x", models.delaunay_weights_of), p, "c_custkey", "y")


@query("best_k_model")
def best_k_model(spark: SparkSession, sf: str) -> DataFrame:
    q, v = _split(spark, sf)
    k = models.best_k(v, "vec_id", "embedding", "label", 20, 16)
    return models.predict_weighted(models.knn_weights(q, v, k, "vec_id", "vec_id", "embedding"), v, "vec_id", "label").withColumn("k", F.lit(k))
