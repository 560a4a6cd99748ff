"""Golden cases of the table operators."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import association, encoding, joins, mining, reshape, sampling
from tessella.operators.frame import RID, Frame, FrameError, differs, equals


@pytest.fixture(scope="module")
def base(spark):
    return Frame.from_rows(spark, [[1, "a", 1.2], [2, "b", 3.0], [3, "c", 2.4], [1, "2", 3.0], [-1, None, None]], types=["bigint", "string", "double"])


def values(frame, name):
    return [r[name] for r in frame.df.orderBy(*frame.order).collect()]


def test_lookup(base):
    assert base.lookup([1, "2", 3.0]).first()[0] == 3
    assert base.lookup([-1, None, None]).first()[0] == 4
    assert base.lookup([77, None, None]).first()[0] is None
    assert base.holds([None, "b", None]) and not base.holds([9, "b", None])


def test_union_and_slices(base):
    both = base.rows(0, -2).union(base.rows(1, -2))
    assert values(both, "0") == [1, 2, 3, 2, 3]
    assert values(base.rows(2, None, 1), "1") == ["c", "2", None]
    assert values(base.rows(step=-1), "0") == [-1, 1, 3, 2, 1]
    wide = base.with_column("3", F.lit(1))
    assert values(base.union(wide), "3") == [None] * 5 + [1] * 5
    with pytest.raises(FrameError):
        base.select("0", "1").union(wide.select("1", "3"))


def test_filters(base):
    assert values(base.filter(equals(F.col("0"), 1)), "0") == [1, 1]
    assert values(base.filter(equals(F.col("1"), {"a", "b", "2"})), "1") == ["a", "b", "2"]
    assert values(base.filter(differs(F.col("1"), "a")), "0") == [2, 3, 1, -1]


def test_reorder_and_unique(base):
    f = base.reorder("2", "0")
    assert f.names == ["2", "0", "1"] and f.types == ["double", "bigint", "string"]
    assert base.union(base).unique().shape() == (5, 3)
    assert values(base.sort("0"), "0") == [-1, 1, 1, 2, 3]
    assert values(base.take([3, 0, 0]), "0") == [1, 1, 1]


def test_add_columns_needs_one_length(base):
    other = Frame.from_rows(base.df.sparkSession, [[1], [2]], ["x"])
    with pytest.raises(Exception, match="one length"):
        base.add_columns(other).df.collect()
    with pytest.raises(FrameError):
        base.add_columns(base)


def test_full_outer_merge(spark):
    a = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b"), (7, "d")], "index long, letter string")
    b = spark.createDataFrame([(3, "a"), (4, "b"), (5, "c"), (6, "b")], "index long, letter string").withColumn("none", F.lit(None).cast("string"))
    got = joins.merge_on_column(a, b, "letter", "hoorah", "loopy").orderBy("letter", "index_hoorah", "index_loopy")
    assert got.columns == ["letter", "index_hoorah", "index_loopy", "none"]
    assert [(r[0], r[1], r[2]) for r in got.collect()] == [("a", 0, 3), ("b", 1, 4), ("b", 1, 6), ("b", 2, 4), ("b", 2, 6), ("c", None, 5), ("d", 7, None)]


def test_full_outer_merge_of_hot_keys(spark, monkeypatch):
    """Rows of one key are dealt to tasks; blocks of a side, nulls and rows without a match come out as by a full join."""
    a = spark.createDataFrame([(i, None if i % 3 == 0 else i % 5) for i in range(60)] + [(99, 77)], "x long, k int")
    b = spark.createDataFrame([(i, None if i % 7 == 0 else i % 4) for i in range(40)] + [(98, 55)], "y long, k int")
    want = sorted(map(tuple, a.join(b, a.k.eqNullSafe(b.k), "full").select(F.coalesce(a.k, b.k), "x", "y").collect()), key=repr)
    for rows in (1000, 9):
        monkeypatch.setattr(joins, "BROADCAST_ROWS", rows)
        got = joins.merge_on_column(a, b, "k")
        assert sorted(map(tuple, got.collect()), key=repr) == want
        assert "FullOuter" not in got._jdf.queryExecution().toString()
    sizes = [r["count"] for r in a.groupBy("k").count().collect()]
    assert joins.merge_on_column(a, a.withColumnRenamed("x", "z"), "k").count() == sum(n * n for n in sizes)


def test_stack_unstack_keep_nulls(spark):
    d = spark.createDataFrame([(1, "a", None, 0), (1, "a", 2.0, 1), (2, None, 3.0, 2), (2, None, None, 3)], "k long, s string, v double, o long")
    s = reshape.stack(d, ["v"], ["o"])
    assert {(r.k, tuple(r.v)) for r in s.collect()} == {(1, (None, 2.0)), (2, (3.0, None))}
    assert reshape.unstack(s, ["v"]).count() == 4
    bad = spark.createDataFrame([([1], [1, 2])], "a array<int>, b array<int>")
    with pytest.raises(Exception, match="one length"):
        reshape.unstack(bad, ["a", "b"]).collect()
    empty = spark.createDataFrame([(1, []), (2, None)], "k int, a array<int>")
    assert reshape.unstack(empty, ["a"]).count() == 2


def test_unpack_pack(spark):
    d = spark.createDataFrame([(1, None), (2, []), (3, [0]), (4, [0, 1]), (5, [0, 1, 2])], "k int, iter array<int>")
    wide = reshape.unpack(d, "iter")
    assert wide.columns == ["k", "iter 1", "iter 2", "iter 3"]
    back = {r.k: r.iter for r in reshape.pack(wide, "iter").collect()}
    assert back == {1: None, 2: None, 3: [0], 4: [0, 1], 5: [0, 1, 2]}


def test_categorical_differences(spark):
    def pdf(d):
        return spark.createDataFrame([(k, float(v)) for k, v in d.items()], "value string, p double")
    a, b, c = pdf({"a": .4, "b": .1, "c": .5, "d": 0}), pdf({"a": .1, "b": .3, "c": .5, "d": .1}), pdf({"d": 1})
    assert association.categorical_diff(a, b).first()[0] == pytest.approx(.3)
    assert association.categorical_diff(a, c).first()[0] == pytest.approx(1)
    assert association.categorical_diff(b, c).first()[0] == pytest.approx(.9)
    with pytest.raises(Exception, match="sum to 1"):
        association.categorical_diff(a, pdf({"a": .2})).collect()


def test_effects(spark):
    d = spark.createDataFrame(list(zip("aaaabbbb", "aabbbaab", "aaccbbbb", strict=True)), "a string, b string, c string")
    assert association.effect(d, "a", "b").first()[0] == pytest.approx(0)
    n = spark.range(1000).select(F.col("id").alias("x"), F.col("id").alias("y"))
    assert association.effect(n, "x", "y").first()[0] == pytest.approx(1.0)
    one = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0)], "c string, v double")
    assert {r.difference for r in association.epdf_by_category(one, "c", "v").collect()} == {1.0}


def test_itemsets(spark):
    baskets = [[0, 1, 2, 6], [2, 1, 5, 8], [8, 4, 3, 2], [7, 2, 5, 3], [1, 2, 0, 5], [4, 1, 7, 9], [3, 6, 8, 1], [1, 8, 9, 0], [0, 2, 1, 4], [1, 9, 4, 7]]
    rows = spark.createDataFrame([(t, i) for t, b in enumerate(baskets) for i in b], "t int, i int")
    got = {tuple(r["items"]): r.support for r in mining.frequent_itemsets(rows, "t", "i", 0.3).collect()}
    assert got[("1",)] == pytest.approx(.8) and got[("2",)] == pytest.approx(.6) and got[("1", "2")] == pytest.approx(.4)
    for items, share in got.items():
        assert share == pytest.approx(sum(set(map(int, items)) <= set(b) for b in baskets) / 10)
    fp = {tuple(r["items"]): r.n for r in mining.frequent_itemsets_fp(rows, "t", "i", 0.3).collect()}
    assert {k: round(v * 10) for k, v in got.items()} == {k: v for k, v in fp.items() if len(k) <= 3}


def test_folds(spark):
    d = spark.range(37).withColumnRenamed("id", "k")
    f = sampling.k_fold(d, "k", 11, 1)
    seen = sorted(r.k for b in range(11) for r in sampling.fold_split(f, b)[1].collect())
    assert seen == list(range(37))


def test_samples():
    assert sampling.samples(error=.3, confidence=.95) in range(8, 16)
    assert sampling.samples(size=97, error=.1) > .9
    assert 0 < sampling.samples(size=97, confidence=.95) < .2


def test_latin_gaps(spark):
    xs = sorted(r.x1 for r in sampling.latin(spark, 300, 2).select("x1").collect())
    assert max(b - a for a, b in zip(xs, xs[1:], strict=False)) < 2 / 300


def test_simplex():
    pts = encoding.regular_simplex(6)
    d = [sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for i, p in enumerate(pts) for q in pts[:i]]
    assert all(x == pytest.approx(1) for x in d) and encoding.regular_simplex(1) == [[]] and encoding.regular_simplex(2) == [[0.0], [1.0]]


def test_category_weights_and_nulls(spark):
    codes = encoding.regular_simplex(3)
    d = spark.createDataFrame([(codes[1],)], "v array<double>")
    assert d.select(encoding.category_weights(F.col("v"), codes)).first()[0] == pytest.approx([0, 1, 0])
    t = spark.createDataFrame([("x", 1, 1.5), (None, 2, None), ("y", 3, 2.5), ("x", None, 3.5)], "c string, i long, f double")
    enc = encoding.NumericEncoding.fit(t)
    back = enc.from_matrix(enc.to_matrix(t).select("vector")).select("c", "i", "f").collect()
    assert [r.c for r in back] == ["x", None, "y", "x"] and [r.i for r in back] == [1, 2, 3, 2]


def test_empty_frame(spark):
    e = Frame(spark.createDataFrame([], "a long, b string"), "a")
    assert e.empty() and e.shape() == (0, 2) and e.rid().df.count() == 0 and e.unique().df.count() == 0
    assert RID in e.rid().df.columns


def test_full_outer_merge_is_written_in_short_periods(spark, monkeypatch, tmp_path):
    """A row for each pair of rows of a key takes a fraction of a byte in a file, and lists cut anywhere give the same rows."""
    a = spark.range(600).select((F.col("id") % 2).alias("k"), F.col("id").alias("x"))
    b = spark.range(8001).select((F.col("id") % 3).alias("k"), F.col("id").alias("y"))
    got = joins.merge_on_column(a, b, "k")
    got.write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 600 * 2667 + 2667
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 600 * 2667
    want = a.join(b, "k", "full").select("k", "x", "y")
    monkeypatch.setattr(joins, "LIST_ROWS", 7)
    few = joins.merge_on_column(a.where("x < 40"), b.where("y < 50"), "k").collect()
    assert sorted(map(tuple, few), key=repr) == sorted(map(tuple, want.where("(x < 40 or x is null) and y < 50").collect()), key=repr)
