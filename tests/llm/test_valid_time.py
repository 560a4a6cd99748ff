"""Valid-time enrichment against a plain simulation of its batches, SQL and odd rows."""

import datetime as dt
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import queries, valid_time

START = dt.datetime(2024, 1, 1)
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"


def plain(sales, changes, batches, days=152):
    """The contract step by step, a dictionary of lists for each client."""
    day = lambda t: (t.date() - dt.date(1970, 1, 1)).days
    number = lambda d: max(0, min(batches - 1, math.floor((d - 19723) * batches / days)))
    new_sales, new_changes = [[] for _ in range(batches + 1)], [[] for _ in range(batches + 1)]
    for s in sales:
        new_sales[0 if s[5] is None else number(day(s[5]))].append(s)
    for c in set(changes):
        if c[4] is not None:
            new_changes[number(day(c[4]) + (0 if c[0] is None else zlib.crc32(str(c[0]).encode()) % 4))].append(c)
    low = lambda x, least: least if x is None else x
    order = lambda c: (c[4], low(c[2], -2**63), low(c[0], -2**63), low(c[3], ""), low(c[8], -math.inf))
    lag, far = dt.timedelta(hours=36), dt.datetime(9999, 1, 1)
    held, waiting, out, tops = {}, [], [], [None, None]
    for b in range(batches + 1):
        marks = [None if t is None else t - lag for t in tops]
        h = far if b == batches else None if None in marks else min(marks)
        for c in new_changes[b]:
            if marks[1] is not None and c[4] < marks[1]:
                out.append(("late", c[0], b, None, None, None, None))
            elif c[1] is not None:
                held.setdefault(c[1], []).append(c)
        still = []
        for s in waiting + new_sales[b]:
            if b < batches and s[4] is not None and (h is None or s[4] >= h):
                still.append(s)
                continue
            own = held.get(s[1], []) if s[1] is not None else []
            fit = sorted((c for c in own if s[4] is not None and c[4] <= s[4]), key=order)
            v = fit[-1] if fit else None
            out.append(("sale", s[0], b, len(own), v and v[0], v and v[8], v and v[3]))
        waiting = still
        for k, own in held.items():
            past = sorted((c for c in own if h is not None and c[4] <= h), key=order)
            held[k] = past[-1:] + [c for c in own if h is None or c[4] > h]
        for i, times in enumerate(([s[4] for s in new_sales[b]], [c[4] for c in new_changes[b]])):
            tops[i] = max([t for t in [tops[i], *times] if t is not None], default=None)
    return sorted(out, key=repr)


def made(rng, n, clients):
    at = lambda: START + dt.timedelta(hours=rng.randint(0, 152 * 24 - 1))
    changes = []
    for k in range(n):
        c = 1 if rng.random() < 0.35 else rng.choice([None, *range(2, clients)])
        changes.append((k if rng.random() < 0.95 else None, c, rng.choice([None, 0, 1, 2]), rng.choice(["I", "U", "D", None]), at() if rng.random() < 0.97 else None, "web", None, "x", rng.choice([None, 1.5, -2.25, 10.0])))
    changes += rng.sample(changes, n // 10)
    changes += [(*c[:3], "Z", *c[4:]) for c in rng.sample(changes, n // 20)]
    sales = []
    for k in range(n):
        t = at()
        c = 1 if rng.random() < 0.35 else rng.choice([None, *range(2, clients)])
        sales.append((k, c, "done", 1.0, None if rng.random() < 0.03 else t if rng.random() < 0.8 else t - dt.timedelta(days=rng.randint(0, 40)), t + dt.timedelta(hours=rng.randint(0, 60)), 1))
    return sales + rng.sample(sales, n // 20), changes


def rows(df):
    return sorted(((r.rec, r.id, r.batch, r.n_held, r.change_id, r.balance, r.op) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("seed", "each", "parts"), [(1, 1, 2), (2, 10, 40)])
def test_against_plain(spark, monkeypatch, seed, each, parts):
    """With 40 parts the hot client is cut into slices of time, with 2 parts every client is whole."""
    monkeypatch.setattr(valid_time, "SLICES_A_CELL", parts / (4 * each))
    sales, changes = made(random.Random(seed), 600, 25)
    s = spark.createDataFrame(sales, SALES).repartition(3).withColumns({"slice": F.lit("x"), "cell": F.lit(None)})
    c = spark.createDataFrame(changes, CHANGES).repartition(3).withColumn("base", F.lit(1))
    got = valid_time.enrich(s, c, batches=4, each=each)
    assert rows(got) == plain(sales, changes, 4)
    bounds = {r.client: len(r.bounds) for r in valid_time._slice_bounds(s, c, parts).collect()}
    assert (bounds[1] >= 8 if parts == 40 else not bounds) and sum(bounds.values()) <= 2 * parts


def test_stores_are_closed_with_their_tasks(spark):
    """Of eleven starts with a store for each partition none is open when the last has ended."""
    manager = spark._jvm.org.apache.spark.sql.execution.streaming.state.RocksDBMemoryManager
    sales, changes = made(random.Random(6), 60, 5)
    before = manager.getNumRocksDBInstances(True)
    valid_time.enrich(spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES), batches=3)
    assert manager.getNumRocksDBInstances(True) <= before


def test_no_sales_and_no_changes(spark):
    sales, changes = made(random.Random(4), 30, 5)
    s, c = spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES)
    assert rows(valid_time.enrich(s, c.limit(0), batches=2)) == plain(sales, [], 2)
    assert valid_time.enrich(s.limit(0), c.limit(0), batches=1).count() == 0


def test_cells_are_dealt_evenly(spark):
    keys = valid_time.cell_numbers(spark, 3)
    found = keys.repartition(4, "cell").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert [r["count"] for r in found] == [3] * 4 and sorted(r.place for r in keys.collect()) == list(range(12))


def test_micros_are_wall_clock(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    times = [dt.datetime(2024, 3, 10, 2, 30, 0, 5), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(2024, 11, 3, 1, 30)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = [r.m for r in df.select(valid_time.micros("t").alias("m")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [(t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) for t in times]


def test_blocks_bound_the_elements_of_a_list():
    n = valid_time.BLOCK_ROWS * 2 + 5
    v = {c: np.arange(n) for c in ("client", "at", "id")} | {"slice": np.zeros(n, np.int32)}
    found = valid_time._blocks(v, valid_time.WAITING)
    assert len(found) == 3 and max(pa.ipc.open_stream(b).read_all().num_rows for b, in found) == valid_time.BLOCK_ROWS
    assert (valid_time._joined(valid_time._rows(iter(found), valid_time.WAITING), valid_time.WAITING)["id"] == v["id"]).all()


def test_op11_oracle(spark, sf_dir):
    c = duckdb.connect()
    for t in ("sales", "client_changes"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = c.sql(queries.oracle_sql()["op11_valid_time"])
    got = queries.op11_valid_time(spark, sf_dir)
    names = sorted(want.columns)
    assert names == sorted(got.columns)
    at = [want.columns.index(n) for n in names]
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
