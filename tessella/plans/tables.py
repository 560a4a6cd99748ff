"""Queries of the table operators: scans, selection, predicates, joins, reshaping, profiling, set-like ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import cells, intervals, joins, profile, reshape
from tessella.operators.frame import RID, Frame, arithmetic, compare, differs, equals, row_elementwise
from tessella.sources import files

from .registry import query, table


@query("counts_returnflag", "SELECT l_returnflag AS value, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lineitem GROUP BY 1")
def counts_returnflag(spark: SparkSession, sf: str) -> DataFrame:
    return profile.shares(table(spark, sf, "lineitem"), "l_returnflag").withColumn("share", F.round("share", 6))


@query("counts_all_orders", """
SELECT "column", value, count(*)::BIGINT AS n FROM (
  SELECT unnest(['o_orderstatus', 'o_orderpriority']) AS "column", unnest([nullif(o_orderstatus, 'F'), o_orderpriority]) AS value FROM orders
) GROUP BY 1, 2""")
def counts_all_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"), "o_orderpriority")
    return profile.counts(orders)


@query("missing_profile", """
SELECT 'c_name' AS "column", count_if(c_name IS NULL)::BIGINT AS missing, count(c_name)::BIGINT AS present FROM customer UNION ALL
SELECT 'c_mktsegment', count_if(nullif(c_mktsegment, 'BUILDING') IS NULL)::BIGINT, count(nullif(c_mktsegment, 'BUILDING'))::BIGINT FROM customer UNION ALL
SELECT 'c_nationkey', count_if(nullif(c_nationkey, 3) IS NULL)::BIGINT, count(nullif(c_nationkey, 3))::BIGINT FROM customer""")
def missing_profile(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"), F.nullif("c_nationkey", F.lit(3)).alias("c_nationkey"))
    return profile.missing(c)


@query("missing_footer", """
SELECT count(*)::BIGINT AS n_rows, 2::BIGINT AS n_columns, count_if(a IS NULL OR b IS NULL)::BIGINT AS rows_with_missing,
  (max((a IS NULL)::INT) + max((b IS NULL)::INT))::BIGINT AS columns_with_missing, sum((a IS NULL)::INT + (b IS NULL)::INT)::BIGINT AS missing_cells
FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS a, nullif(c_nationkey, 3) AS b FROM customer)""")
def missing_footer(spark: SparkSession, sf: str) -> DataFrame:
    return profile.missing_footer(table(spark, sf, "customer").select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("a"), F.nullif("c_nationkey", F.lit(3)).alias("b")))


@query("shape_events", "SELECT count(*)::BIGINT AS n_rows, 6::BIGINT AS n_columns FROM events")
def shape_events(spark: SparkSession, sf: str) -> DataFrame:
    return profile.shape(table(spark, sf, "events"))


@query("summary_head_orders", """
SELECT 'o_orderstatus' AS "column", 'category' AS kind, count(DISTINCT o_orderstatus)::BIGINT AS n_distinct, count_if(o_orderstatus IS NULL)::BIGINT AS n_missing FROM orders UNION ALL
SELECT 'o_orderpriority', 'category', count(DISTINCT o_orderpriority)::BIGINT, count_if(o_orderpriority IS NULL)::BIGINT FROM orders UNION ALL
SELECT 'o_totalprice', 'number', count(DISTINCT o_totalprice)::BIGINT, count_if(o_totalprice IS NULL)::BIGINT FROM orders""")
def summary_head_orders(spark: SparkSession, sf: str) -> DataFrame:
    return profile.summary_head(table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice"))


@query("summary_orders", """
WITH s AS (SELECT 'o_orderstatus' AS "column", 'category' AS kind, o_orderstatus AS item, count(*)::BIGINT AS n FROM orders GROUP BY 3 ORDER BY 4 DESC, 3 LIMIT 10),
p AS (SELECT 'o_orderpriority' AS "column", 'category' AS kind, o_orderpriority AS item, count(*)::BIGINT AS n FROM orders GROUP BY 3 ORDER BY 4 DESC, 3 LIMIT 10),
b AS (SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 9)), 8)::INT AS bin FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)),
h AS (SELECT 'o_totalprice' AS "column", 'bin' AS kind, bin::VARCHAR AS item, count(*)::BIGINT AS n FROM b GROUP BY bin)
SELECT *, round(n / (SELECT count(*) FROM orders), 6) AS share FROM (SELECT * FROM s UNION ALL SELECT * FROM p UNION ALL SELECT * FROM h)""")
def summary_orders(spark: SparkSession, sf: str) -> DataFrame:
    s = profile.summary(table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice"))
    return s.withColumn("share", F.round("share", 6))


@query("histogram_totalprice", """
WITH r AS (SELECT min(o_totalprice) - (max(o_totalprice) - min(o_totalprice)) * 0.03 AS lo, (max(o_totalprice) - min(o_totalprice)) * 1.03 AS w FROM orders)
SELECT bin, round(lo + bin * (w / 50), 4) AS low, n, round(n / sum(n) OVER (), 6) AS share
FROM (SELECT least(floor((o_totalprice - lo) / (w / 50)), 49)::INT AS bin, count(*)::BIGINT AS n FROM orders, r GROUP BY 1), r""")
def histogram_totalprice(spark: SparkSession, sf: str) -> DataFrame:
    h = profile.histogram(table(spark, sf, "orders"), "o_totalprice", 50, 0.03, True)
    return h.select("bin", F.round("low", 4).alias("low"), "n", F.round("share", 6).alias("share"))


@query("box_by_segment", """
SELECT c_mktsegment, min(c_acctbal) AS least, round(quantile_cont(c_acctbal, 0.25), 6) AS q1, round(quantile_cont(c_acctbal, 0.5), 6) AS median, round(quantile_cont(c_acctbal, 0.75), 6) AS q3,
  max(c_acctbal) AS greatest, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS deviation FROM customer GROUP BY 1""")
def box_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    b = profile.boxes(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal")
    return b.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3", "mean", "deviation")})


@query("percentile_cloud", """
SELECT event_type, percent, round(value, 6) AS value FROM (
  SELECT event_type, unnest([0.0, 25.0, 50.0, 75.0, 100.0])::DOUBLE AS percent, unnest(quantile_cont(value, [0.0, 0.25, 0.5, 0.75, 1.0])) AS value FROM events GROUP BY 1)""")
def percentile_cloud(spark: SparkSession, sf: str) -> DataFrame:
    p = profile.percentile_cloud(table(spark, sf, "events"), "event_type", "value", (0, 25, 50, 75, 100))
    return p.withColumn("value", F.round("value", 6))


@query("filter_eq_null_safe", "SELECT p_partkey, nullif(p_brand, 'Brand#11') AS brand FROM part WHERE nullif(p_brand, 'Brand#11') IS NOT DISTINCT FROM NULL")
def filter_eq_null_safe(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.nullif("p_brand", F.lit("Brand#11")).alias("brand"))
    return p.where(equals(F.col("brand"), None))


@query("filter_not_equal", "SELECT p_partkey FROM part WHERE nullif(p_size, 7) IS DISTINCT FROM 10")
def filter_not_equal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(differs(F.nullif("p_size", F.lit(7)), 10)).select("p_partkey")


@query("filter_in_set", "SELECT p_partkey FROM part WHERE nullif(p_size, 7) IN (1, 2, 3) OR nullif(p_size, 7) IS NULL")
def filter_in_set(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(equals(F.nullif("p_size", F.lit(7)), {1, 2, 3, None})).select("p_partkey")


@query("filter_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 20000")
def filter_range(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.where(compare(F.col("o_totalprice"), ">=", 1000) & compare(F.col("o_totalprice"), "<", 20000)).select("o_orderkey", "o_totalprice")


@query("column_arithmetic", """
SELECT p_partkey, round(p_retailprice + p_size, 6) AS added, round(p_retailprice * p_size, 6) AS times, round(p_size / 7.0::DOUBLE, 6) AS over, floor(p_size / 7.0::DOUBLE)::BIGINT AS floored, p_brand || '/' || p_type AS joined FROM part""")
def column_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", F.round(arithmetic(a, "+", b), 6).alias("added"), F.round(arithmetic(a, "*", b), 6).alias("times"), F.round(arithmetic(b, "/", F.lit(7)), 6).alias("over"),
                                           arithmetic(b, "//", F.lit(7)).alias("floored"), arithmetic(F.concat(F.col("p_brand"), F.lit("/")), "+", F.col("p_type"), True).alias("joined"))


@query("row_elementwise", "SELECT n_nationkey, (n_nationkey > 4)::VARCHAR || ',' || (n_regionkey > 2)::VARCHAR AS flags FROM nation")
def row_elementwise_query(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    flags = row_elementwise([F.col("n_nationkey"), F.col("n_regionkey")], ">", [4, 2])
    return n.select("n_nationkey", F.array_join(F.transform(flags, lambda x: x.cast("string")), ",").alias("flags"))


@query("project_reorder_retype", "SELECT l_shipinstruct, key, l_quantity FROM (SELECT l_returnflag AS l_shipinstruct, l_orderkey::VARCHAR AS key, l_quantity::BIGINT AS l_quantity FROM lineitem)")
def project_reorder_retype(spark: SparkSession, sf: str) -> DataFrame:
    f = Frame(table(spark, sf, "lineitem")).select("l_orderkey", "l_quantity", "l_returnflag").retype({"l_orderkey": "string", "l_quantity": "bigint"})
    return f.rename({"l_orderkey": "key", "l_returnflag": "l_shipinstruct"}).reorder("l_shipinstruct", "key").df


@query("project_by_position", "SELECT n_name, n_nationkey FROM nation")
def project_by_position(spark: SparkSession, sf: str) -> DataFrame:
    return Frame(table(spark, sf, "nation")).select(1, slice(0, 1)).df


@query("add_column", "SELECT o_orderkey, 'x' AS mark, round(o_totalprice * 0.1, 4) AS tenth FROM orders")
def add_column(spark: SparkSession, sf: str) -> DataFrame:
    return Frame(table(spark, sf, "orders")).with_column("tenth", F.round(F.col("o_totalprice") * 0.1, 4)).with_column("mark", "x", 1).select("o_orderkey", "mark", "tenth").df


@query("conditional_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def conditional_update(spark: SparkSession, sf: str) -> DataFrame:
    return Frame(table(spark, sf, "customer")).assign(F.col("c_acctbal") < 0, "c_acctbal", 0).select("c_custkey", "c_acctbal").df


@query("drop_column", "SELECT r_name FROM region")
def drop_column(spark: SparkSession, sf: str) -> DataFrame:
    return Frame(table(spark, sf, "region")).drop("r_regionkey").df


ORDERED = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rid FROM orders)"


@query("slice_step", f"SELECT rid::BIGINT AS _rid, o_orderkey FROM {ORDERED} WHERE rid >= 10 AND rid < 500 AND (rid - 10) % 7 = 0")
def slice_step(spark: SparkSession, sf: str) -> DataFrame:
    return Frame(table(spark, sf, "orders"), "o_orderkey").rows(10, 500, 7).df.select(RID, "o_orderkey")


@query("reverse_head", f"SELECT o_orderkey, o_totalprice FROM {ORDERED} ORDER BY rid DESC LIMIT 25")
def reverse_head(spark: SparkSession, sf: str) -> DataFrame:
    return Frame(table(spark, sf, "orders"), "o_orderkey").rows(step=-1).head(25).select("o_orderkey", "o_totalprice")


@query("row_access", f"SELECT o_orderkey, o_totalprice FROM {ORDERED} WHERE rid = 42 OR rid = (SELECT count(*) - 1 FROM orders)")
def row_access(spark: SparkSession, sf: str) -> DataFrame:
    f = Frame(table(spark, sf, "orders"), "o_orderkey")
    return f.row(42).df.unionByName(f.row(-1).df).select("o_orderkey", "o_totalprice")


@query("row_list", f"SELECT pos::BIGINT AS _rid, o_orderkey FROM (SELECT unnest([0, 1, 2, 3]) AS pos, unnest([3, 0, 0, 17]) AS rid) p JOIN {ORDERED} o USING (rid)")
def row_list(spark: SparkSession, sf: str) -> DataFrame:
    return Frame(table(spark, sf, "orders"), "o_orderkey").take([3, 0, 0, 17]).df.select(RID, "o_orderkey")


@query("row_lookup", """
SELECT min(rid)::BIGINT AS first_row FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS rid FROM (SELECT p_partkey, p_brand, nullif(p_size, 1) AS p_size FROM part))
WHERE coalesce(p_brand = 'Brand#12', true) AND coalesce(p_size = 5, true)""")
def row_lookup(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_brand", F.nullif("p_size", F.lit(1)).alias("p_size"))
    return Frame(p, "p_partkey").lookup([None, "Brand#12", 5])


@query("append_row", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NOWHERE'")
def append_row(spark: SparkSession, sf: str) -> DataFrame:
    return Frame(table(spark, sf, "region"), "r_regionkey").append([99, "NOWHERE"]).df.select("r_regionkey", "r_name")


@query("insert_and_drop_row", """
SELECT CASE WHEN rid >= 2 THEN rid + 1 ELSE rid END::BIGINT AS _rid, r_name FROM (SELECT *, row_number() OVER (ORDER BY r_regionkey) - 1 AS rid FROM region) WHERE rid <> 0
UNION ALL SELECT 2, 'NEW' ORDER BY 1""")
def insert_and_drop_row(spark: SparkSession, sf: str) -> DataFrame:
    f = Frame(table(spark, sf, "region"), "r_regionkey").insert(2, [98, "NEW"])
    return f.df.where(F.col(RID) != 0).select(RID, "r_name")


@query("merge_full_outer", """
SELECT coalesce(c.c_nationkey, s.c_nationkey) AS c_nationkey, c.c_custkey, s.s_suppkey FROM (SELECT nullif(c_nationkey, 3) AS c_nationkey, c_custkey FROM customer) c
FULL JOIN (SELECT nullif(s_nationkey, 3) AS c_nationkey, s_suppkey FROM supplier WHERE s_nationkey <> 5) s ON c.c_nationkey IS NOT DISTINCT FROM s.c_nationkey""")
def merge_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.nullif("c_nationkey", F.lit(3)).alias("c_nationkey"), "c_custkey")
    s = table(spark, sf, "supplier").where("s_nationkey <> 5").select(F.nullif("s_nationkey", F.lit(3)).alias("c_nationkey"), "s_suppkey")
    return joins.merge_on_column(c, s, "c_nationkey")


@query("merge_with_suffix", """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.n AS n_text, d.lang, l.n AS n_label FROM (SELECT doc_id, lang, n_chars AS n FROM documents) d FULL JOIN (SELECT doc_id, quality::BIGINT AS n FROM labels) l ON d.doc_id IS NOT DISTINCT FROM l.doc_id""")
def merge_with_suffix(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").alias("n"))
    q = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("bigint").alias("n"))
    return joins.merge_on_column(d, q, "doc_id", "text", "label")


@query("collect_lists", """
SELECT c.custkey, coalesce(o.orders, '') AS orders FROM (SELECT c_custkey AS custkey FROM customer) c
LEFT JOIN (SELECT o_custkey AS custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1) o USING (custkey)""")
def collect_lists(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey")
    got = joins.collect_join(c, o, ["o_orderkey"])
    return got.select("custkey", F.array_join(F.transform("o_orderkey", lambda x: x.cast("string")), ",").alias("orders"))


@query("zip_join", """
SELECT a.rid::BIGINT AS _rid, a.o_orderkey, b.dearest FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rid FROM orders) a
JOIN (SELECT o_orderkey AS dearest, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rid FROM orders) b USING (rid)""")
def zip_join(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in the order of their keys beside orders in the order of their prices."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    a = Frame(orders.select("o_orderkey"), "o_orderkey").rid()
    b = Frame(orders.select((-F.col("o_totalprice")).alias("price"), F.col("o_orderkey").alias("dearest")), ["price", "dearest"]).rid()
    return a.add_columns(b).df.select(RID, "o_orderkey", "dearest")


@query("stack_events", "SELECT user_id, event_type, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events GROUP BY 1, 2")
def stack_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    got = reshape.stack(e, ["event_id"], [F.col("event_id")])
    return got.select("user_id", "event_type", F.array_join(F.transform("event_id", lambda x: x.cast("string")), ",").alias("ids"))


@query("unstack_roundtrip", "SELECT conv_id, turn, role FROM conversations")
def unstack_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return reshape.unstack(reshape.stack(c, ["turn", "role"], [F.col("turn")]), ["turn", "role"])


@query("unpack_pack", """
SELECT n_name, string_agg(c, '' ORDER BY i) AS letters FROM (SELECT n_name, unnest(range(1, length(n_name) + 1)) AS i, unnest(string_split(n_name, '')) AS c FROM nation) GROUP BY 1""")
def unpack_pack(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select("n_name", F.col("n_name").alias("letter"))
    got = reshape.pack(reshape.unpack(n, "letter"), "letter")
    return got.select("n_name", F.array_join("letter", "").alias("letters"))


@query("flatten_lists", "SELECT r_regionkey, (i - 1)::INT AS place, substr(r_name, i::INT, 1) AS value FROM (SELECT r_regionkey, r_name, unnest(range(1, length(r_name) + 1)) AS i FROM region)")
def flatten_lists(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region").select("r_regionkey", F.array(F.array("r_name")).alias("deep"))
    return reshape.flatten(r, "deep")


@query("transpose_regions", """
SELECT 'n' AS name, max(CASE WHEN n_regionkey = 0 THEN n END) AS "0", max(CASE WHEN n_regionkey = 1 THEN n END) AS "1" FROM (SELECT n_regionkey, count(*)::BIGINT AS n FROM nation GROUP BY 1)""")
def transpose_regions(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    return reshape.transpose(n, "n_regionkey", [0, 1])


@query("unique_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def unique_rows(spark: SparkSession, sf: str) -> DataFrame:
    return Frame(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")).unique().df


@query("unique_first", "SELECT min(rid)::BIGINT AS _rid, user_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rid FROM events) GROUP BY 2, 3")
def unique_first(spark: SparkSession, sf: str) -> DataFrame:
    e = Frame(table(spark, sf, "events"), "event_id").rid()
    return Frame(e.df.select(RID, "user_id", "event_type"), RID).unique().df


@query("union_by_name", "SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    b = table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key"))
    return Frame(a).union(Frame(b)).df


@query("union_missing", "SELECT n_nationkey AS key, n_name AS name, n_regionkey AS up FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def union_missing(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("up"))
    b = table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key"))
    return Frame(b).union(Frame(a)).df.select("key", "name", "up")


@query("sort_topk", "SELECT (row_number() OVER (ORDER BY o_orderpriority NULLS LAST, o_totalprice, o_orderkey) - 1)::BIGINT AS _rid, o_orderkey FROM orders")
def sort_topk(spark: SparkSession, sf: str) -> DataFrame:
    f = Frame(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderkey")
    return f.sort("o_orderpriority", "o_totalprice").df.select(RID, "o_orderkey")


@query("filter_mask_and_set", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def filter_mask_and_set(spark: SparkSession, sf: str) -> DataFrame:
    return Frame(table(spark, sf, "lineitem")).filter(equals(F.col("l_returnflag"), "R") & compare(F.col("l_quantity"), ">", 45)).select("l_orderkey", "l_linenumber", "l_quantity").df


@query("pairwise_distance", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT q.vec_id AS query_id, p.vec_id, round(sqrt(list_sum(list_transform(list_zip(q.e, p.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS distance FROM v q, v p WHERE q.vec_id % 50 = 0""")
def pairwise_distance(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qe"))
    return joins.pairwise_distance(q, v, "query_id", "vec_id", "qe", "embedding").withColumn("distance", F.round("distance", 6))


KNN = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
d AS (SELECT q.vec_id AS query_id, p.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, p.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance FROM v q, v p WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, round(distance, 6) AS distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= 5"""


@query("knn_topk", KNN)
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qe"))
    return joins.nearest(q, v, 5, "query_id", "vec_id", "qe", "embedding").withColumn("distance", F.round("distance", 6))


@query("knn_cells", KNN)
def knn_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The same neighbours out of cells, without a comparison of all pairs."""
    v = table(spark, sf, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qe"))
    return cells.nearest(q, v, 5, "query_id", "vec_id", "qe", "embedding").withColumn("distance", F.round("distance", 6))


@query("knn_cells_self", """
WITH p AS (SELECT c_custkey, c_nationkey + c_custkey % 13 / 13 AS a, c_acctbal / 1000 AS b FROM customer),
d AS (SELECT q.c_custkey AS query_id, p.c_custkey, sqrt((q.a - p.a) * (q.a - p.a) + (q.b - p.b) * (q.b - p.b)) AS distance FROM p q, p WHERE q.c_custkey <> p.c_custkey)
SELECT query_id, c_custkey, round(distance, 6) AS distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, c_custkey) AS rank FROM d) WHERE rank <= 3""")
def knn_cells_self(spark: SparkSession, sf: str) -> DataFrame:
    """Three neighbours of every customer among all others."""
    c = table(spark, sf, "customer").select("c_custkey", F.array(F.col("c_nationkey") + F.col("c_custkey") % 13 / 13, F.col("c_acctbal") / 1000).alias("x"))
    return cells.nearest(c, c, 3, "c_custkey", "c_custkey", "x", "x", exclude_self=True).withColumn("distance", F.round("distance", 6))


@query("balance_ranges", """
SELECT s_suppkey, count(*)::BIGINT AS n, sum(c_custkey)::BIGINT AS keys, round(min(c_acctbal), 4) AS least FROM supplier JOIN customer ON c_acctbal BETWEEN s_acctbal - 10 * (1 + s_suppkey % 7) AND s_acctbal + 25 GROUP BY 1""")
def balance_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The customers whose balance lies in a range around each supplier's."""
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") - 10 * (1 + F.col("s_suppkey") % 7)).alias("low"), (F.col("s_acctbal") + 25).alias("high"))
    got = intervals.totals(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), s, "c_acctbal", "s_suppkey", "low", "high", {"keys": F.col("c_custkey")})
    return got.select("s_suppkey", "n", "keys", F.round("least", 4).alias("least"))


@query("sale_click", """
WITH c AS (SELECT client_id AS k, ts, max(click_id) AS click_id FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2)
SELECT sale_id, sold_at, client_id, CASE WHEN epoch(sold_at) - epoch(ts) <= 86400 THEN click_id END AS click_id FROM sales LEFT JOIN LATERAL (SELECT ts, click_id FROM c WHERE k = client_id AND ts <= sold_at ORDER BY ts DESC LIMIT 1) ON true""")
def sale_click(spark: SparkSession, sf: str) -> DataFrame:
    """The last click of a sale's client before the sale, if it came within a day."""
    clicks = table(spark, sf, "clicks").select("click_id", "ts", F.col("client_id").alias("who"))
    sales = table(spark, sf, "sales").select("sale_id", "sold_at", "client_id")
    return intervals.as_of(sales, clicks, "sold_at", "ts", [("client_id", "who")], tolerance=86_400, ties=["click_id"]).select("sale_id", "sold_at", "client_id", "click_id")


@query("all_pairs_regions", "SELECT a.r_regionkey AS a, b.r_regionkey AS b FROM region a JOIN region b ON a.r_regionkey > b.r_regionkey")
def all_pairs_regions(spark: SparkSession, sf: str) -> DataFrame:
    return joins.all_pairs(table(spark, sf, "region"), "r_regionkey")


@query("pair_index_roundtrip", """
WITH p AS (SELECT i, j, (i * (i - 1)) // 2 + j AS index FROM range(1, 60) t(i), range(0, 59) u(j) WHERE i > j)
SELECT i::BIGINT AS i, j::BIGINT AS j, index::BIGINT AS index, i::BIGINT AS i2, j::BIGINT AS j2 FROM p""")
def pair_index_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.range(1, 60).select(F.col("id").alias("i")).join(spark.range(0, 59).select(F.col("id").alias("j")), F.col("i") > F.col("j"))
    p = p.withColumn("index", joins.pair_to_index(F.col("i"), F.col("j")))
    i, j = joins.index_to_pair(F.col("index"))
    return p.select("i", "j", "index", i.alias("i2"), j.alias("j2"))


@query("mesh", "SELECT a AS x0, b AS x1, c AS x2 FROM (SELECT unnest([0.0, 0.5, 1.0])::DOUBLE AS a), (SELECT unnest([0.0, 0.5, 1.0])::DOUBLE AS b), (SELECT unnest([2.0, 3.0])::DOUBLE AS c)")
def mesh(spark: SparkSession, sf: str) -> DataFrame:
    return joins.mesh(spark, [[0.0, 0.5, 1.0], [0.0, 0.5, 1.0], [2.0, 3.0]])


@query("mesh_sample_rows", "SELECT a AS x0, b AS x1, true AS inside FROM (SELECT unnest([0, 1, 2, 3])::INT AS a), (SELECT unnest([5, 6, 7])::INT AS b)")
def mesh_sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All the mesh's rows and whether samples of 10 and of 12 of them hold distinct rows of it only."""
    nodes = [[0, 1, 2, 3], [5, 6, 7]]
    rows = joins.mesh(spark, nodes).select(F.col("x0").cast("int").alias("x0"), F.col("x1").cast("int").alias("x1"))
    some, all_ = (joins.mesh_sample(spark, nodes, n, 4).select(F.col("x0").cast("int").alias("x0"), F.col("x1").cast("int").alias("x1")) for n in (10, 12))
    fine = some.distinct().count() == 10 and some.exceptAll(rows).isEmpty()
    return rows.join(all_.withColumn("in_sample", F.lit(True)), ["x0", "x1"], "left").select("x0", "x1", (F.coalesce("in_sample", F.lit(False)) & F.lit(fine)).alias("inside"))


@query("separator_stats", """
WITH l AS (SELECT row_number() OVER () AS id, regexp_replace(line, '"[^"]*"', '', 'g') AS v FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line, ' ') <> ''),
m AS (SELECT id, unnest(string_split(v, '')) AS character FROM l WHERE trim(v, ' ') <> ''),
n AS (SELECT id, character, count(*) AS n FROM m WHERE character IN (',', ' ', '|', '"', '!', '=', '@', '(', ')') GROUP BY 1, 2)
SELECT character, min(n)::BIGINT AS least, max(n)::BIGINT AS most, count(*)::BIGINT AS lines FROM n GROUP BY 1""")
def separator_stats(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return files.separator_stats(lines).where(F.col("character").isin(",", " ", "|", '"', "!", "=", "@", "(", ")"))


@query("sniffed_types", """SELECT * FROM (VALUES ('event_id', 'bigint'), ('value', 'double'), ('event_type', 'string')) t("column", type)""")
def sniffed_types(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("value").cast("string").alias("value"), "event_type")
    return files.column_types(e)


@query("cell_texts", "SELECT p_partkey, CASE WHEN length(p_name || ' ' || p_type || ' ' || p_brand) > 30 THEN substr(p_name || ' ' || p_type || ' ' || p_brand, 1, 28) || '..' ELSE p_name || ' ' || p_type || ' ' || p_brand END AS cell FROM part")
def cell_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", profile.cell_text(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("cell"))


@query("table_text", """
WITH r AS (SELECT n_nationkey, n_nationkey::VARCHAR || ' | ' || n_name || ' | ' || n_regionkey::VARCHAR AS row FROM nation)
SELECT row, 'head' AS place FROM (SELECT row FROM r ORDER BY n_nationkey LIMIT 5) UNION ALL SELECT row, 'tail' FROM (SELECT row FROM r ORDER BY n_nationkey DESC LIMIT 5)""")
def table_text(spark: SparkSession, sf: str) -> DataFrame:
    return profile.table_text(table(spark, sf, "nation"), ["n_nationkey"])


@query("colour_scale", """
SELECT s_suppkey, 'rgb(' || floor(30 + t * 170 + 0.5)::BIGINT || ',' || floor(60 + t * 0 + 0.5)::BIGINT || ',' || floor(200 + t * -170 + 0.5)::BIGINT || ')' AS colour
FROM (SELECT s_suppkey, (s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()) AS t FROM supplier)""")
def colour_scale(spark: SparkSession, sf: str) -> DataFrame:
    return profile.colour_scale(table(spark, sf, "supplier"), "s_acctbal").select("s_suppkey", "colour")


@query("ranked_cells", """
WITH v AS (SELECT s_suppkey, round(s_acctbal, 2) AS v, s_acctbal FROM supplier), w AS (SELECT DISTINCT v FROM v ORDER BY v LIMIT 1 OFFSET 1)
SELECT s_suppkey, CASE WHEN v = (SELECT v FROM w) THEN '<' || printf('%.2f', s_acctbal) || '>' ELSE printf('%.2f', s_acctbal) END AS text FROM v""")
def ranked_cells(spark: SparkSession, sf: str) -> DataFrame:
    return profile.ranked_cells(table(spark, sf, "supplier"), "s_acctbal", 1, "<", ">", 2).select("s_suppkey", "text")


@query("aligned_numbers", "SELECT p_partkey, lpad(printf('%.3f', p_retailprice), 12, ' ') AS text FROM part")
def aligned_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", profile.aligned_numbers(F.col("p_retailprice")).alias("text"))


@query("membership", "SELECT count_if(n_name = 'GERMANY' OR n_name IS NULL)::BIGINT AS n FROM nation")
def membership(spark: SparkSession, sf: str) -> DataFrame:
    n = Frame(table(spark, sf, "nation"), "n_nationkey")
    return n.matches([None, "GERMANY", None]).agg(F.count("*").alias("n"))
