"""Files: round trips, detection, widening, dropped lines; streams."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import maths, optimize, parallel
from tessella.operators import distribution, models
from tessella.sources import files
from tessella.streaming import tables


@pytest.mark.parametrize("ext", ["csv", "tsv", "csv.gz", "parquet", "json"])
def test_round_trip(spark, tmp_path, ext):
    d = spark.createDataFrame([(1, "a, b", 1.5), (2, None, None), (3, "plain", 2.0)], "i long, s string, f double")
    path = f"{tmp_path}/t.{ext}"
    files.save(d, path)
    got = files.load(spark, path).select("i", "s", "f")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, d.collect()), key=repr)


def test_detection_and_widening(spark, tmp_path):
    p = tmp_path / "x.dat"
    p.write_text('a;b;c\n1;"x;y";2\n2.5;z;\n\n3;w;7;9\n4;v\n')
    assert files.read_delimited(spark, str(p), ";", report=True).first().line == "3;w;7;9"
    got = files.read_delimited(spark, str(p), ";")
    assert dict(got.dtypes) == {"a": "double", "b": "string", "c": "bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == [(1.0, "x;y", 2), (2.5, "z", None), (4.0, "v", None)]
    q = tmp_path / "y.txt"
    q.write_text("a;b\n1;2\n3;4\n")
    assert files.detect_separator(spark.read.text(str(q))) == ";"
    typed = files.read_delimited(spark, str(p), ";", types={"a": "bigint"}, report=True)
    assert {r.line for r in typed.collect()} == {"3;w;7;9", "2.5;z;"}


def test_disassemble(spark, tmp_path):
    p = tmp_path / "blob.bin"
    p.write_bytes(bytes(range(256)) * 5)
    parts = files.disassemble(spark, str(p), 100)
    assert parts.count() == 13
    assert bytes(files.assemble(parts).first().content) == p.read_bytes()


def test_streams(spark, tmp_path, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/ev")
    s = tables.read_stream(spark, f"{tmp_path}/ev", schema, 1)
    got = {r.value: r.n for r in tables.drain(tables.running_counts(s, "event_type"), "counts").collect()}
    want = {r.event_type: r["count"] for r in spark.read.parquet(f"{tmp_path}/ev").groupBy("event_type").count().collect()}
    assert got == want
    h = tables.drain(tables.running_histogram(tables.read_stream(spark, f"{tmp_path}/ev", schema), "value", 0.0, 10.0, 5), "bins")
    assert h.agg(F.sum("n")).first()[0] == sum(want.values())
    timed = tables.read_stream(spark, f"{tmp_path}/ev", schema).withColumn("ts", F.col("ts").cast(T.TimestampType()))
    w = tables.drain(tables.windowed_counts(timed, "ts", "event_type", "1 day", late="400 days"), "windows")
    assert w.agg(F.sum("n")).first()[0] == sum(want.values())


def test_parallel_and_guards(spark):
    assert [r.result for r in parallel.parallel_map(spark, lambda x: x + 1, [3, 1, 2], "bigint").orderBy("place").collect()] == [4, 2, 3]
    assert parallel.background(lambda: 7)().result(10) == 7
    a, b = spark.range(10), spark.range(9, -1, -1)
    assert parallel.result_hash(a) == parallel.result_hash(b) != parallel.result_hash(spark.range(11))
    with pytest.raises(TypeError):
        parallel.checked(int)(lambda x: x)("a")


def test_cached(spark, tmp_path):
    calls = []

    def q(n):
        calls.append(n)
        return spark.range(n)

    assert parallel.cached(spark, f"file://{tmp_path}", q, 5).count() == 5
    assert parallel.cached(spark, f"file://{tmp_path}", q, 5).count() == 5 and calls == [5]


@pytest.mark.parametrize("method", sorted(optimize.METHODS))
def test_minimizers(method):
    got = optimize.minimize(lambda v: (v[0] - .3) ** 2 + (v[1] + .2) ** 2, bounds=[(-1, 1), (-1, 1)], method=method, max_steps=600)
    assert got.best < 0.05


def test_line_searches():
    assert optimize.binary_search(lambda x: x**3 - 2, 0, 2) == pytest.approx(2 ** (1 / 3))
    assert optimize.false_position(lambda x: x**3 - 2, 0, 2) == pytest.approx(2 ** (1 / 3))
    assert optimize.golden_section(lambda x: (x - 1.5) ** 2, 0, 4) == pytest.approx(1.5, abs=1e-6)


def test_cdf_and_inverse(spark):
    d = spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.0, 4.0)], "v double")
    nodes = distribution.cdf_points(d, "v")
    at = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,), (4.0,), (9.0,)], "x double")
    got = {r.x: r.cdf for r in distribution.cdf_eval(at, nodes, "x").collect()}
    assert got == {0.0: 0.0, 1.0: .25, 2.0: .75, 3.0: .875, 4.0: 1.0, 9.0: 1.0}
    u = spark.createDataFrame([(.25,), (.875,), (1.0,)], "u double")
    assert [r.x for r in distribution.inverse_eval(u, nodes, "u").orderBy("u").collect()] == pytest.approx([1.0, 3.0, 4.0])


def test_weights_sum_to_one(spark):
    pts = spark.createDataFrame([(i, [float(i % 5), float(i // 5)], float(i)) for i in range(25)], "id long, x array<double>, y double")
    q = spark.createDataFrame([(100, [1.3, 2.2]), (101, [3.0, 3.0])], "id long, x array<double>")
    for w in (models.shepard_weights(q, pts, "id", "id", "x"), models.modified_shepard_weights(q, pts, "id", "id", "x", 5), models.voronoi_weights(q, pts, "id", "id", "x"), models.box_mesh_weights(q, pts, "id", "id", "x"), models.delaunay_weights(q, pts, "id", "id", "x")):
        sums = {r[0]: r[1] for r in w.groupBy("query_id").agg(F.sum("weight")).collect()}
        assert sums == pytest.approx({100: 1.0, 101: 1.0})
        exact = {r.query_id: r.prediction for r in models.predict_weighted(w, pts, "id", "y").collect()}
        assert exact[101] == pytest.approx(18.0)
    # barycentric weights give a linear response exactly
    d = {r.query_id: r.prediction for r in models.predict_weighted(models.delaunay_weights(q, pts, "id", "id", "x"), pts, "id", "y").collect()}
    assert d[100] == pytest.approx(1.3 + 5 * 2.2)


def test_models_learn(spark):
    d = spark.range(400).select((F.col("id") % 20 / 20.0).alias("a"), (F.floor(F.col("id") / 20) / 20.0).alias("b"))
    d = d.withColumn("y", 2 * F.col("a") + F.greatest(F.col("b") - 0.5, F.lit(0.0)))
    mean = d.agg(F.var_pop("y")).first()[0]
    for m in (models.linear_fit(d, ["a", "b"], "y"), models.mars_fit(d, ["a", "b"], "y", 7), models.network_fit(d, ["a", "b"], "y", steps=300), models.svr_fit(d, ["a", "b"], "y")):
        err = m.predict(d).agg(F.avg(F.pow(F.col("prediction") - F.col("y"), F.lit(2.0)))).first()[0]
        assert err < 0.1 * mean
    again = models.ArrayModel.from_json(models.mars_fit(d, ["a", "b"], "y", 5).to_json())
    assert again.predict(d).count() == 400


def test_fractions(spark):
    d = spark.createDataFrame([(6, 4), (-3, 9), (1, 0), (0, 0)], "a long, b long")
    got = [r[0] for r in d.select(maths.fraction(F.col("a"), F.col("b"))).collect()]
    assert [None if g is None else tuple(g) for g in got] == [(3, 2), (-1, 3), (1, 0), None]


def test_tree(spark, tmp_path):
    root = tmp_path / "2-a--b" / "3--1"
    root.mkdir(parents=True)
    (root / "Train-0.csv").write_text("a,b,y\n1,2,3\n2,3,4\n4,5,6\n")
    (root / "Test-0.csv").write_text("a,b,y\n9,9,9\n")
    got = files.corpus_tree(spark, str(tmp_path))
    assert {(r._dims, r._names, r._train, r._test, r._part, r._number) for r in got.collect()} == {(2, "a--b", 3, 1, "train", 0), (2, "a--b", 3, 1, "test", 0)}
