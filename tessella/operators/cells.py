"""Points in cells around pivots: exact neighbour searches that visit only cells which can hold an answer.

Pivots are a bounded sample of the points (at most MAX_PIVOTS); every point lies in the cell of its
nearest pivot, and a cell is known by its pivot, its radius and its number of points, a row a cell on the
driver. A search maps each question to the cells that its bound cannot rule out and cogroups questions with
points by cell. Cells of many points are dealt to blocks and cells of many questions to chunks, so no
group grows with the data. Bounds come from the triangle inequality, so results are those of a
comparison with all points.

Defined cases: points and questions whose vector is null or holds a null or a number that is not finite are left out;
all vectors need one length; ties are broken by point id; an empty table of points answers nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.sources.scratch import shared_folder

MAX_PIVOTS = 1024
#: Points of a block and questions of a chunk.
BLOCK, CHUNK = 8192, 8192
#: Pairs of question and cell that a task bounds at a time, and visits of a question from which on cells are visited in groups.
BOUNDED, MANY = 1 << 18, 8
#: Cells are visited in groups where a question has to visit this part of them, one in so many.
SHARE = 4
SLACK = 1e-9


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: what several steps read is computed once."""
    path, schema = shared_folder(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def evenly(df: DataFrame) -> DataFrame:
    """Rows dealt to all tasks: what is done for a row costs as much as there are cells, so a few MB are work for many tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def matrix(column) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(lists)
    return np.asarray(lists.flatten()).reshape(n, -1).astype(float) if n else np.zeros((0, 1))


def usable(vec: str) -> Column:
    """Vectors that have a distance."""
    return F.coalesce(F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))) & (F.size(vec) > 0), F.lit(False))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, summed dimension by dimension as the JVM's expression does."""
    out = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for k in range(a.shape[-1]):
        d = a[..., k] - b[..., k]
        out += d * d
    return out


def rough(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances by one matrix product, with its rounding."""
    out = a @ b.T
    out *= -2
    out += (a * a).sum(1)[:, None]
    out += (b * b).sum(1)[None, :]
    return np.maximum(out, 0, out=out)


@dataclass
class Cells:
    """Points (`_id`, `_x`, `_cell`) and what is known of their cells."""

    placed: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    count: np.ndarray
    id_type: T.DataType

    @property
    def dims(self) -> int:
        return self.pivots.shape[1]


def build(points: DataFrame, p_id: str, vec: str, pivots: int | None = None, seed: int = 0) -> Cells:
    rows = evenly(points.where(usable(vec)).select(F.col(p_id).alias("_id"), F.col(vec).cast("array<double>").alias("_x")))
    n = rows.count()
    m = min(MAX_PIVOTS, pivots or max(1, math.isqrt(n)))
    got = rows.orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(m).collect()  # at most MAX_PIVOTS rows
    if not got:
        return Cells(rows.withColumn("_cell", F.lit(0)), np.zeros((0, 1)), np.zeros(0), np.zeros(0, int), rows.schema["_id"].dataType)
    centres = np.unique(np.array([r["_x"] for r in got], float), axis=0)
    schema = T.StructType([*rows.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_r", T.DoubleType())])

    def place(batches):
        for b in batches:
            x = matrix(b.column("_x"))
            d = rough(x, centres)
            cell = d.argmin(1) if len(x) else np.zeros(0, int)
            r = np.sqrt(squared(x, centres[cell])) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(r, pa.float64())], names=schema.names)

    placed = kept(rows.mapInArrow(place, schema), "cells")
    radius, count = np.zeros(len(centres)), np.zeros(len(centres), int)
    for r in placed.groupBy("_cell").agg(F.max("_r").alias("r"), F.count("*").alias("n")).collect():  # a row a cell
        radius[r["_cell"]], count[r["_cell"]] = r["r"] * (1 + SLACK), r["n"]
    return Cells(placed.drop("_r"), centres, radius, count, rows.schema["_id"].dataType)


Bound = Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
Answer = Callable[[pa.Table, np.ndarray, np.ndarray, pa.Array], list]


def search(cells: Cells, asks: DataFrame, bound: Bound, answer: Answer, schema: T.StructType, tally: dict | None = None, notes: dict | None = None) -> DataFrame:
    """Rows of `schema` that `answer(questions, x, order, ids)` makes of the questions and the points of a block.

    `bound(questions, pivots, radius, count)` says for each question and cell whether the cell has to be visited. Where it rules out
    little, whole groups of cells are visited (`notes` says so), and a question meets points of cells that it need not visit.
    """
    pivots, radius, count = cells.pivots, cells.radius, cells.count
    asks = evenly(asks)
    visits_schema = T.StructType([*asks.schema.fields, T.StructField("_cell", T.IntegerType())])

    spark = asks.sparkSession

    def called(b):
        """(first row, table of questions and cells to visit), some questions at a time."""
        step = max(1, BOUNDED // max(1, len(count)))
        for at in range(0, b.num_rows, step):
            yield at, bound(b.slice(at, step), pivots, radius, count) & (count > 0)

    def number(batches):
        total, rows = np.zeros(len(count), np.int64), 0
        for b in batches:
            rows += b.num_rows
            for _, hit in called(b):
                total += hit.sum(0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(total[some], rows))], names=["_cell", "n"])

    asked = {r["_cell"]: r["n"] for r in asks.mapInArrow(number, "_cell int, n long").groupBy("_cell").agg(F.sum("n").alias("n")).collect()}  # a row a cell
    rows = asked.pop(-1, 0)
    placed, group, block = cells.placed, np.arange(len(count)), BLOCK
    if sum(asked.values()) > max(MANY, len(count) // SHARE) * rows:
        # most cells are visited by most questions: a question goes once to a group of cells, not once to each of them
        group, block = grouped(pivots, count, GROUP), GROUP
        if notes is not None:
            notes["grouped"] = True
        sent = F.broadcast(spark.createDataFrame(list(enumerate(group.tolist())), "_cell int, _group int"))  # a row a cell
        placed = placed.join(sent, "_cell").drop("_cell").withColumnRenamed("_group", "_cell")
    size = np.bincount(group, count, len(count)).astype(int)
    order_of = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.diff(group[order_of], prepend=-1))

    def visit(batches):
        for b in batches:
            for at, hit in called(b):
                q, c = np.nonzero(np.logical_or.reduceat(hit[:, order_of], starts, axis=1))
                c = group[order_of[starts]][c]
                for i in range(0, len(q), 16_384):
                    yield pa.RecordBatch.from_arrays([*[x.take(pa.array(q[i: i + 16_384] + at)) for x in b.columns], pa.array(c[i: i + 16_384], pa.int32())], names=visits_schema.names)

    def met(batches):
        total = np.zeros(len(count), np.int64)
        for b in batches:
            for _, hit in called(b):
                total[group[order_of[starts]]] += np.logical_or.reduceat(hit[:, order_of], starts, axis=1).sum(0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["_cell", "n"])

    if placed is not cells.placed:
        asked = {r["_cell"]: r["n"] for r in asks.mapInArrow(met, "_cell int, n long").groupBy("_cell").agg(F.sum("n").alias("n")).collect()}  # a row a group
    visits = asks.mapInArrow(visit, visits_schema)
    if tally is not None:
        tally["compared"] = tally.get("compared", 0) + sum(n * int(size[c]) for c, n in asked.items())
    plan = spark.createDataFrame([(c, -(-int(size[c]) // block), -(-n // (CHUNK if block == BLOCK else GROUP))) for c, n in asked.items()], "_cell int, _blocks int, _chunks int")  # a row a cell
    plan = F.broadcast(plan)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["_cell", "_block", "_chunk"]
    left = visits.join(plan, "_cell").withColumn("_chunk", F.pmod(F.xxhash64(*[c for c in asks.columns if not isinstance(asks.schema[c].dataType, T.MapType)]), F.col("_chunks")).cast("int")).withColumn("_block", spread("_blocks")).drop("_blocks", "_chunks")
    right = placed.join(plan, "_cell").withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int")).withColumn("_chunk", spread("_chunks")).drop("_blocks", "_chunks")
    kinds = to_arrow_schema(schema)

    def run(q: pa.Table, p: pa.Table) -> pa.Table:
        if not q.num_rows or not p.num_rows:
            return kinds.empty_table()
        ids = p.column("_id").combine_chunks()
        order = pa.compute.rank(ids, "ascending", tiebreaker="first").to_numpy()
        cols = answer(q, matrix(p.column("_x")), order, ids)
        return pa.table([pa.array(c, k.type) if not isinstance(c, (pa.Array, pa.ChunkedArray)) else c.cast(k.type) for c, k in zip(cols, kinds, strict=True)], schema=kinds)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


#: Points and questions that meet in a task where cells are visited in groups.
GROUP = 32_768
#: Rough values that a task holds at a time.
TILE = 1 << 22


def grouped(pivots: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """A group for each cell: halves by the widest dimension until a group has at most so many points, or is one cell."""
    group, todo, n = np.zeros(len(count), int), [np.arange(len(count))], 0
    while todo:
        own = todo.pop()
        if len(own) == 1 or count[own].sum() <= most:
            group[own], n = n, n + 1
            continue
        x = pivots[own]
        by = own[np.argsort(x[:, np.ptp(x, axis=0).argmax()], kind="stable")]
        todo += [by[: len(by) // 2], by[len(by) // 2:]]
    return group


def least_of(rough_: np.ndarray, order: np.ndarray, k: int, limit: np.ndarray, slack: np.ndarray, exact: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, places, exact values) of the k least values of each row up to its limit; rough values only choose what is computed exactly."""
    some = rough_[:, :4096]
    top = limit + slack
    if some.shape[1] > k:
        top = np.minimum(top, np.partition(some, k - 1, axis=1)[:, k - 1] + 2 * slack)
    row, place = np.nonzero(rough_ <= top[:, None])
    got = exact(row, place)
    best = np.lexsort((order[place], got, row))
    first = np.searchsorted(row, np.arange(len(rough_)))  # rows come in order
    best = best[(np.arange(len(best)) - first[row]) < k] if len(row) else best
    best = best[got[best] <= limit[row[best]]]
    return row[best], place[best], got[best]


def closest(cells: Cells, asks: DataFrame, k: int, tally: dict | None = None, vectors: bool = True) -> DataFrame:
    """(ask, _id, _x if `vectors`, value) of the k points with the least value for each question, in order of value and id.

    Questions are (ask, c, far, most): the value is the squared distance from c, or, where `far`, minus the product with c;
    values above `most` (null: none) do not count. A first visit to the most promising cell gives a value that the k-th cannot
    exceed; only cells that can hold less are visited then.
    """
    asks = asks.where(usable("c")).select("ask", F.col("c").cast("array<double>").alias("c"), F.coalesce("far", F.lit(False)).alias("far"), F.coalesce(F.col("most").cast("double"), F.lit(float("inf"))).alias("most"))
    schema = T.StructType([T.StructField("ask", asks.schema["ask"].dataType), T.StructField("_id", cells.id_type), *([T.StructField("_x", T.ArrayType(T.DoubleType()))] if vectors else []), T.StructField("value", T.DoubleType())])
    if not len(cells.pivots):
        return asks.sparkSession.createDataFrame([], schema).withColumn("_rank", F.lit(0))

    def lowest(b, pivots, radius):
        """(least value that a cell can hold, value at its pivot, greatest value that it can hold)."""
        c, far = matrix(b.column("c")), np.asarray(b.column("far"))[:, None]
        away, norm = np.sqrt(rough(c, pivots)), np.sqrt((c * c).sum(1))[:, None]
        line = -(c @ pivots.T)
        slack = SLACK * (1 + norm)
        low = np.where(far, line - norm * radius, np.maximum(away - radius - slack, 0) ** 2)
        high = np.where(far, line + norm * radius, (away + radius + slack) ** 2)
        return low - np.where(far, slack * (1 + np.abs(line)), 0), np.where(far, line, away**2), high + np.where(far, slack * (1 + np.abs(line)), 0)

    def cap(b, pivots, radius, count):
        """What the k-th value cannot exceed, from cells' sizes alone."""
        low, at, high = lowest(b, pivots, radius)
        rank = np.argsort(high, axis=1)
        enough = np.cumsum(count[rank], axis=1) >= k
        first = np.take_along_axis(rank, enough.argmax(1)[:, None], 1)
        top = np.where(enough.any(1), np.take_along_axis(high, first, 1)[:, 0], np.inf)
        return low, at, np.minimum(top, np.asarray(b.column("most")))

    def own(at):
        mine = np.zeros(at.shape, bool)
        mine[np.arange(len(at)), at.argmin(1)] = True
        return mine

    def first(b, pivots, radius, count):
        low, at, top = cap(b, pivots, radius, count)
        return own(at) & (low <= top[:, None])

    def rest(b, pivots, radius, count):
        low, at, top = cap(b, pivots, radius, count)
        known = np.asarray(b.column("known"))
        return (low <= np.minimum(top, known)[:, None]) & ~own(at)

    def answer(q, x, order, ids):
        c, far, most = matrix(q.column("c")), np.asarray(q.column("far")), np.asarray(q.column("most"))
        if "known" in q.column_names:
            most = np.minimum(most, np.asarray(q.column("known")))
        who, what, values = [], [], []
        step = max(16, TILE // max(1, len(x)))
        widest = float((x * x).sum(1).max())
        for at in range(0, len(c), step):
            part = slice(at, at + step)
            some, away = c[part], far[part]
            near = rough(some, x)
            if away.any():
                near[away] = -(some[away] @ x.T)
            exact = lambda i, p, some=some, away=away: np.where(away[i], -_dot(x[p], some[i]), squared(x[p], some[i])) if away.any() else squared(x[p], some[i])
            i, p, value = least_of(near, order, k, most[part], SLACK * (1 + (some * some).sum(1) + widest), exact)
            who.append(i + at), what.append(p), values.append(value)
        who, what = np.concatenate(who), np.concatenate(what)
        return [q.column("ask").combine_chunks().take(pa.array(who)), ids.take(pa.array(what)), *([lists(x[what])] if vectors else []), np.concatenate(values)]

    near = kept(search(cells, asks, first, answer, schema, tally), "first")
    top = near.groupBy("ask").agg(F.when(F.count("*") >= k, F.max("value")).alias("known"))
    again = asks.join(top, "ask", "left").withColumn("known", F.coalesce("known", F.lit(float("inf"))))
    notes: dict = {}
    more = search(cells, again, rest, answer, schema, tally, notes)
    both = near.unionByName(more)
    if notes.get("grouped"):
        both = both.dropDuplicates(["ask", "_id"])  # the first cell lies in a group too
    rank = F.row_number().over(Window.partitionBy("ask").orderBy("value", "_id"))
    return both.withColumn("_rank", rank).where(F.col("_rank") <= k)


def _dot(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * c[..., k]
    return out


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)[: len(x) + 1], x.ravel())


def nearest(queries: DataFrame, points: DataFrame, k: int, q_id: str, p_id: str, q_vec: str, p_vec: str, exclude_self: bool = False,
            cells: Cells | None = None, tally: dict | None = None) -> DataFrame:
    """(q_id, p_id, distance, rank) of the k nearest points of each query; ties by point id.

    Query ids tell queries apart. `tally` gets the numbers of pairs compared and of all pairs.
    """
    q = q_id if q_id != p_id else "query_id"
    cells = cells or build(points, p_id, p_vec)
    asks = queries.select(F.col(q_id).alias("ask"), F.col(q_vec).alias("c"), F.lit(False).alias("far"), F.lit(None).cast("double").alias("most"))
    got = closest(cells, asks, k + 1 if exclude_self else k, tally, vectors=False)
    if tally is not None:
        tally["pairs"] = asks.count() * int(cells.count.sum())
    if exclude_self:
        again = F.row_number().over(Window.partitionBy("ask").orderBy("value", "_id"))
        got = got.where("ask <> _id").withColumn("_rank", again).where(F.col("_rank") <= k)
    return got.select(F.col("ask").alias(q), F.col("_id").alias(p_id), F.sqrt("value").alias("distance"), F.col("_rank").alias("rank"))
