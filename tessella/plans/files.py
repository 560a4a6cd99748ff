"""Queries of files, persistence, types and helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import maths, parallel
from tessella.operators import models, sampling
from tessella.operators.frame import Frame, is_iterable, is_numeric
from tessella.sources import files, lines
from tessella.sources.scratch import shared_folder

from .registry import query, table

CUSTOMERS = "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal, c_nationkey::BIGINT AS c_nationkey FROM customer"


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"), "c_nationkey")


def _saved(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    path = f"{shared_folder(spark, 'saved')}.{kind}"
    files.save(_customers(spark, sf), path)
    got = files.load(spark, path)
    return got.select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), F.col("c_nationkey").cast("bigint").alias("c_nationkey"))


@query("save_load_csv", CUSTOMERS)
def save_load_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Saved with a header in many part files, read back with types found."""
    return _saved(spark, sf, "csv")


@query("save_load_tsv", CUSTOMERS)
def save_load_tsv(spark: SparkSession, sf: str) -> DataFrame:
    return _saved(spark, sf, "tsv")


@query("save_load_gz", CUSTOMERS)
def save_load_gz(spark: SparkSession, sf: str) -> DataFrame:
    return _saved(spark, sf, "csv.gz")


@query("save_load_parquet", CUSTOMERS)
def save_load_parquet(spark: SparkSession, sf: str) -> DataFrame:
    return _saved(spark, sf, "parquet")


@query("save_load_json", CUSTOMERS)
def save_load_json(spark: SparkSession, sf: str) -> DataFrame:
    return _saved(spark, sf, "json")


@query("load_any_separator", "SELECT n_nationkey AS key, n_name AS name, n_regionkey AS up FROM nation UNION ALL SELECT 99, 'key;name;up', NULL")
def load_any_separator(spark: SparkSession, sf: str) -> DataFrame:
    """A file whose separator is found, with a quoted cell that reads like the header."""
    path = shared_folder(spark, "separated")
    n = table(spark, sf, "nation").select(F.format_string("%d;%s;%d", "n_nationkey", "n_name", "n_regionkey").alias("line"), F.col("n_nationkey").alias("at"))
    extra = spark.createDataFrame([("key;name;up", -1), ('99;"key;name;up";', 99)], "line string, at int")
    n.unionByName(extra).coalesce(1).sortWithinPartitions("at").select("line").write.text(path)
    got = files.read_delimited(spark, path)
    return got.select(F.col("key").cast("int").alias("key"), "name", F.col("up").cast("int").alias("up"))


@query("header_lines_as_data", "SELECT 'name' AS name, 2::BIGINT AS n UNION ALL SELECT 'x', 1")
def header_lines_as_data(spark: SparkSession, sf: str) -> DataFrame:
    """Data lines that read like the header stay."""
    path = shared_folder(spark, "headers")
    spark.createDataFrame([("name",), ("x",), ("name",), ("name",)], "line string").coalesce(1).write.text(path)
    return files.read_delimited(spark, path, ",").groupBy("name").agg(F.count("*").alias("n"))


@query("load_append", "SELECT n_nationkey AS key, n_name AS name, NULL::BIGINT AS n FROM nation UNION ALL SELECT r_regionkey, NULL, length(r_name) FROM region")
def load_append(spark: SparkSession, sf: str) -> DataFrame:
    """A file's rows after a table's, columns by name."""
    path = f"{shared_folder(spark, 'appended')}.parquet"
    files.save(table(spark, sf, "region").select(F.col("r_regionkey").alias("key"), F.length("r_name").cast("bigint").alias("n")), path)
    return files.load_onto(table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), path).select("key", "name", "n")


@query("file_chunks", "SELECT sum(length(r_name) + 1)::BIGINT AS bytes, ceil(sum(length(r_name) + 1) / 7)::BIGINT AS parts, true AS same FROM region")
def file_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A file taken apart into chunks of 7 bytes and put together again."""
    path = shared_folder(spark, "chunked")
    table(spark, sf, "region").select("r_name").coalesce(1).write.text(path)
    chunks = files.disassemble(spark, f"{path}/*.txt", 7)
    whole = files.assemble(chunks.orderBy(F.desc("part")))
    raw = spark.read.format("binaryFile").load(f"{path}/*.txt").select("path", F.col("content").alias("raw"))
    parts = chunks.groupBy("path").agg(F.count("*").alias("parts"))
    return whole.join(raw, "path").join(parts, "path").select(F.length("raw").cast("bigint").alias("bytes"), "parts", (F.col("content") == F.col("raw")).alias("same"))


def _as_file(df: DataFrame, path: str) -> None:
    """Write a small table as one CSV file of that very name."""
    spark = df.sparkSession
    df.coalesce(1).write.option("header", True).csv(f"{path}.parts")
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = home.getFileSystem(spark._jsc.hadoopConfiguration())
    made = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}.parts/part-*.csv"))[0].getPath()
    fs.rename(made, home)
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}.parts"), True)


@query("corpus_folders", "SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'test' ELSE 'train' END AS part, (n_nationkey % 2)::INT AS number, 2 AS dims, 'a_b' AS names, 18 AS train, 7 AS test, sum(n_regionkey)::BIGINT AS total FROM nation GROUP BY 1, 2")
def corpus_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a tree of training and test files with what their paths say."""
    path = shared_folder(spark, "corpus")
    n = table(spark, sf, "nation").withColumn("part", F.when(F.col("n_nationkey") % 4 == 0, "Test").otherwise("Train")).withColumn("number", (F.col("n_nationkey") % 2).cast("int"))
    for part in ("Train", "Test"):
        for number in (0, 1):
            _as_file(n.where((F.col("part") == part) & (F.col("number") == number)).select("n_nationkey", "n_regionkey"), f"{path}/2-a_b/18--7/{part}-{number}.csv")
    got = files.corpus_tree(spark, path).groupBy(F.col("_part").alias("part"), F.col("_number").alias("number"), F.col("_dims").alias("dims"), F.col("_names").alias("names"), F.col("_train").alias("train"), F.col("_test").alias("test"))
    return got.agg(F.sum("n_regionkey").cast("bigint").alias("total"))


@query("model_round_trip", "SELECT p_partkey, true AS same FROM part")
def model_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A model written as JSON and read again predicts the same."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_partkey") % 97).cast("double").alias("b"), F.col("p_retailprice").alias("y"))
    model = models.mars_fit(p, ["a", "b"], "y", 5)
    again = models.ArrayModel.from_json(model.to_json())
    return again.predict(model.predict(p, "one"), "two").select("p_partkey", (F.col("one") == F.col("two")).alias("same"))


@query("rows_constructed", "SELECT 1::BIGINT AS a, 'x' AS b, 0.5::DOUBLE AS c UNION ALL SELECT 2, NULL, 1.0")
def rows_constructed(spark: SparkSession, sf: str) -> DataFrame:
    return Frame.from_rows(spark, [[1, "x", 0.5], [2, None, 1.0]], ["a", "b", "c"]).df.select(F.col("a").cast("bigint").alias("a"), "b", F.col("c").cast("double").alias("c"))


@query("copies_are_independent", "SELECT n_nationkey, n_name, upper(n_name) || '!' AS changed FROM nation")
def copies_are_independent(spark: SparkSession, sf: str) -> DataFrame:
    """A copy that is changed leaves the table as it was; views are plans over the same rows."""
    n = Frame(table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    changed = n.copy().assign(F.lit(True), "n_name", F.concat(F.upper("n_name"), F.lit("!")))
    return n.df.join(changed.df.select("n_nationkey", F.col("n_name").alias("changed")), "n_nationkey").select("n_nationkey", "n_name", "changed")


@query("column_kinds", "SELECT * FROM (VALUES ('embedding', false, true), ('label', true, false), ('vec_id', true, false)) t(name, is_numeric, is_iterable)")
def column_kinds(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    return spark.createDataFrame([(c, bool(is_numeric(e, c)), bool(is_iterable(e, c))) for c in e.columns], "name string, is_numeric boolean, is_iterable boolean")


@query("fekete_places", "SELECT 10::BIGINT AS n, true AS distinct_places, true AS independent")
def fekete_places(spark: SparkSession, sf: str) -> DataFrame:
    """As many points as cubic monomials of two variables, at which these are independent."""
    import numpy as np

    points = [tuple(r) for r in maths.box_mesh_nodes(spark, 6).orderBy("x0", "x1").collect()]  # 49 points
    places = maths.fekete_points(points, 10, 3)
    x = np.array([points[i] for i in places])
    v = np.stack([x[:, 0] ** i * x[:, 1] ** j for i in range(4) for j in range(4 - i)], 1)
    return spark.createDataFrame([(len(places), len(set(places)) == len(places), bool(np.linalg.matrix_rank(v) == 10))], "n bigint, distinct_places boolean, independent boolean")


@query("sample_sizes", "SELECT 101::BIGINT AS size, round(sum(exp(lgamma(102) - lgamma(k + 1) - lgamma(102 - k)) * pow(0.5, 101)), 6) AS confidence FROM range(41, 61) t(k)")
def sample_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """The confidence that the share of 101 rows below the median is within a tenth of a half: an exact binomial sum."""
    return spark.createDataFrame([(101, round(sampling.samples(101, 0.1), 6))], "size bigint, confidence double")


@query("model_times", "SELECT unnest([100, 200])::BIGINT AS rows, true AS measured")
def model_times(spark: SparkSession, sf: str) -> DataFrame:
    def some(n):
        return spark.range(n).select((F.col("id") % 10).cast("double").alias("a"), F.col("id").cast("double").alias("y"))

    got = models.timed(lambda d: models.linear_fit(d, ["a"], "y"), lambda m, d: m.predict(d), [100, 200], some)
    return spark.createDataFrame([(n, fit > 0 and predict > 0) for n, fit, predict in got], "rows bigint, measured boolean")


@query("background_and_guards", "SELECT 25::BIGINT AS from_background, 25::BIGINT AS in_time, -1::BIGINT AS too_late, true AS refused, true AS same_hash")
def background_and_guards(spark: SparkSession, sf: str) -> DataFrame:
    """A call in the background, one with time enough, one without, one with a wrong argument, and two runs' digests."""
    nation = table(spark, sf, "nation")
    later = parallel.background(lambda: nation.count())()
    in_time = parallel.with_timeout(spark, 600, lambda: nation.count(), -1)
    slow = spark.range(64).repartition(8).mapInArrow(_sleepy, "id long")
    too_late = parallel.with_timeout(spark, 1.0, lambda: slow.count(), -1)

    @parallel.checked(int)
    def whole(x):
        return x

    try:
        refused = whole("1") is None
    except TypeError:
        refused = True
    same = parallel.result_hash(nation) == parallel.result_hash(nation.orderBy(F.desc("n_name")))
    return spark.createDataFrame([(later.result(), in_time, too_late, refused, same)], "from_background bigint, in_time bigint, too_late bigint, refused boolean, same_hash boolean")


def _sleepy(batches):
    import time

    for b in batches:
        time.sleep(10)
        yield b


@query("cached_query", "SELECT n_regionkey, count(*)::BIGINT AS n, 1::BIGINT AS runs FROM nation GROUP BY 1")
def cached_query(spark: SparkSession, sf: str) -> DataFrame:
    """A query's result kept in a folder: the second call reads it."""
    runs = []

    def counted(path: str) -> DataFrame:
        runs.append(path)
        return table(spark, path, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))

    folder = shared_folder(spark, "cache")
    parallel.cached(spark, folder, counted, sf)
    again = parallel.cached(spark, folder, counted, sf)
    return again.withColumn("runs", F.lit(len(runs)).cast("bigint"))


@query("sampled_lines")
def sampled_lines(spark: SparkSession, sf: str) -> DataFrame:
    """About a fifth of the lines of all orders as a text file, by reading about a fifth of its bytes."""
    folder = shared_folder(spark, "lines")
    table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey").write.csv(folder)
    return lines.read_lines(spark, folder, 0.2, block=256).select("offset", "line", "part", "bytes")
