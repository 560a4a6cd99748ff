"""Substring dedup by longest previous factors against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import queries, suffixes

ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "word"), (5, "Tie tie TIE"), (5, "Tie tie TIE"), (None, "no id here"), (None, None)]


def plain(rows, length, keep_first=False):
    """(id, bytes, removed, spans, kept) by a dictionary of all strings of `length` bytes."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    order = sorted(range(len(texts)), key=lambda k: -2**63 if texts[k][0] is None else texts[k][0])
    seen = Counter()
    for _, t in texts:
        seen.update(t[k: k + length] for k in range(len(t) - length + 1))
    first, out = set(), []
    for k in order:
        i, t = texts[k]
        gone = np.zeros(len(t) + 2, bool)
        for a in range(len(t) - length + 1):
            s = t[a: a + length]
            if seen[s] > 1 and (not keep_first or s in first):
                gone[a + 1: a + 1 + length] = True
            first.add(s)
        step = np.diff(gone.astype(int))
        out.append((i, len(t), int(gone.sum()), int((step == 1).sum()), bytes(b for b, g in zip(t, gone[1:-1], strict=True) if not g)))
    return sorted(out, key=repr)


def got(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("x"), "spans": F.lit(1), "core": F.lit(0)}).repartition(5)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(docs, **kw).collect()), key=repr)


def made(rng, n):
    """Texts of random words with copies, near copies, passages shared at several lengths, repetitions within a text and runs of one letter."""
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(40)[:k] for k in (100, 199, 200, 201, 230)] + [prose(90)]
    texts = []
    for k in range(n):
        t = prose(rng.randint(5, 120))
        for _ in range(rng.randint(0, 3)):
            s, at = rng.choice(shared), rng.randint(0, len(t))
            t = t[:at] + s + t[at:]
        texts.append(t)
    for _ in range(n // 4):
        t = list(rng.choice(texts))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = "#"
        texts.append("".join(t))
    texts += ["=" * 150, "=" * 250, "=" * 900, "ab" * 300, "-" + "ab" * 160 + "-", shared[-1] * 3, prose(30) + "三" * 90]
    return list(enumerate(texts))


@pytest.mark.parametrize("keep_first", [False, True])
def test_against_plain(spark, keep_first):
    rows = made(random.Random(7), 120)
    rng = random.Random(8)
    rng.shuffle(rows)
    rows += ODD
    want = plain(rows, 200, keep_first)
    assert got(spark, rows, keep_first=keep_first) == want
    assert sum(r[2] > 0 for r in want) > 40 and sum(0 < r[2] < r[1] for r in want) > 20


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize(("group", "many"), [(2, 1_000_000), (3, 4), (2048, 1)])
def test_cores_of_many_contexts(spark, monkeypatch, group, many, keep_first):
    """Parts of a core, and fingerprints for cores beyond that, give what one sorted group gives."""
    monkeypatch.setattr(suffixes, "GROUP", group)
    monkeypatch.setattr(suffixes, "MANY", many)
    rng = random.Random(4)
    line = "".join(rng.choice("abcdef ") for _ in range(150))
    rows = [(k, "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 90))) + line + "".join(rng.choice("pq") for _ in range(rng.randint(0, 8))) + line[:90]) for k in range(40)] + made(rng, 20)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    assert got(spark, rows, keep_first=keep_first) == plain(rows, 200, keep_first)


@pytest.mark.parametrize("length", [64, 90])
def test_other_lengths(spark, length):
    rows = made(random.Random(9), 60)
    assert got(spark, rows, length=length) == plain(rows, length)


def test_pieces_of_long_texts(spark, monkeypatch):
    """Texts longer than a piece; small pieces on the driver, where the anchors of all pieces are those of the whole."""
    rng = random.Random(3)
    text = "".join(rng.choice("abcd ") for _ in range(30_000)).encode()
    whole = {(int(c), int(x), int(s), int(n)) for c, x, s, n in zip(*suffixes.contexts(text, np.array([len(text)]), 200), strict=True)}
    covered = sorted((s, s + n) for _, _, s, n in whole)
    assert covered[0][0] == 0 and covered[-1][1] == len(text) - 199 and all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))
    assert len(whole) < len(text) / 50
    monkeypatch.setattr(suffixes, "PIECE", 1500)
    pieces = list(suffixes._pieces([1, 2], [5, 6], [text, b"x" * 100], 200))
    starts = sorted((at, at + len(p) - 199) for g in pieces for _, _, at, p in g)
    assert starts[0][0] == 0 and starts[-1][1] == len(text) - 199 and all(a[1] == b[0] for a, b in zip(starts, starts[1:], strict=False))
    long = text.decode() * 300  # several pieces of the real size
    monkeypatch.undo()
    res = got(spark, [(1, long), (2, long[10_000:10_150]), (3, "end")])
    assert [r[:4] for r in res] == [(1, len(long), len(long), 1), (2, 150, 0, 0), (3, 3, 0, 0)]


def test_hot_classes_are_dealt_to_tasks(spark):
    again = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("core"), F.lit(1).cast("long").alias("x"), "id", F.col("id").alias("h"), F.lit(0).alias("start"), F.lit(5).alias("n"))
    classes = again.groupBy("core", "x").agg(F.count("*").alias("c"), F.min(F.struct("id", "h", "start", "n")).alias("first"))
    got = suffixes._copies(again, classes)
    assert got.count() == 3000 and got.where("core = 7").groupBy("deal").count().count() >= 5 and got.where("core <> 7 and deal <> 0").count() == 0


def test_too_short_a_length_is_refused(spark):
    with pytest.raises(ValueError):
        suffixes.remove_repeats(spark.createDataFrame([(1, "x")], "doc_id long, text string"), length=10)


def test_empty_table(spark):
    assert got(spark, [(1, "x")]) == [(1, 1, 0, 0, b"x")]
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string").where("doc_id > 1")
    assert suffixes.remove_repeats(docs).count() == 0


def test_op13_on_the_table(spark, sf_dir):
    import hashlib

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = [(i, n, g, s, hashlib.sha256(kept).hexdigest()) for i, n, g, s, kept in plain(rows, 200)]
    res = queries.op13_suffixes(spark, sf_dir)
    assert res.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, res.collect()), key=repr) == sorted(want, key=repr) and sum(r[2] for r in want) > 0
