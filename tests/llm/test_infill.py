"""Fill-in-middle: lists against numpy, cuts against a plain version, SQL, edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import infill, queries

ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "word"), (5, "Tie tie TIE"), (5, "Tie tie TIE"), (6, "é" * 3000 + " x" * 20000), (None, "no id here"), (7, "with <S> inside"),
       (8, "<P <M S> <"), (9, "三語👍🏽 áb ſK")]


def plain(doc_id, text):
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k: k + 8], 16) for k in (0, 8, 16, 24))
    n = len(u)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, bound in ((0, 10), (1, 1), (1, 10**6), (5000, 5000), (3000, 10**5), (700, 10**9)):
        values = np.sort(rng.choice(np.arange(1, bound + 1) if bound <= 10**6 else rng.integers(1, bound, n * 2), n, replace=False))
        packed = infill.EliasFano(values, bound)
        assert [packed.select(k) for k in range(n)] == values.tolist()
    assert infill.EliasFano(np.arange(1, 40001) * 3, 120000).nbytes() < 40001


def rows(df):
    return sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()), key=repr)


def test_against_plain(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab Zé<>PSM.\n三👍") for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["same text, " * 50] * 700
    given = list(enumerate(texts)) + ODD
    docs = spark.createDataFrame([(d, t, "x", 5, 1.0) for d, t in given], "doc_id long, text string, form string, n int, _hash double").repartition(5)
    got = infill.fill_in_middle(docs)
    assert rows(got) == sorted(((d, *plain(d, t)) for d, t in given), key=repr)
    back = got.select("doc_id", infill.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(((r.doc_id, r.t) for r in back), key=repr) == sorted(((d, t or "") for d, t in given), key=repr)
    forms = {r.form for r in got.collect()}
    assert forms == {"plain", "psm", "spm"}


def test_kept_columns_and_empty_table(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"form": F.lit("old"), "lang": F.lit("en"), "k0": F.lit(3)})
    got = infill.fill_in_middle(docs, keep=["doc_id", "lang", "form", "k0"])
    assert got.columns == ["doc_id", "lang", "k0", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert {r.form for r in got.collect()} <= {"plain", "psm", "spm"}
    assert infill.fill_in_middle(docs.where("doc_id < 0")).count() == 0


def test_hot_text_is_dealt_to_tasks(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one hot text").otherwise(F.col("id").cast("string")).alias("_text"))
    dealt = infill._dealt(docs)
    parts = dealt.where("_text = 'one hot text'").groupBy("_deal").count().collect()
    assert len(parts) >= 5 and max(r["count"] for r in parts) < 500
    assert dealt.where("_text <> 'one hot text' and _deal <> 0").count() == 0


@pytest.mark.parametrize("doc_id", [0, 17, None])
def test_seeds(doc_id):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    assert infill.seeds(doc_id, 1) == [int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)]


def test_op12_oracle(spark, sf_dir, duck):
    got = queries.op12_infill(spark, sf_dir)
    want = duck.sql(queries.oracle_sql()["op12_infill"])
    names = sorted(want.columns)
    assert names == sorted(got.columns)
    at = [want.columns.index(c) for c in names]
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
