"""Fit and predict: neighbour, distance-weighted, mesh, linear, tree and network models.

Weighted models give a table (query, point, weight) and a prediction is a weighted sum, so they are
plain joins and aggregates over the query set. Queries are a stated set: they are counted and
broadcast, or go block by block (see joins). Models that need a solver fit with numpy, per node where
they are local, on the driver from aggregates or a bounded sample where they are global.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encoding import polynomial_terms
from . import cells, joins, meshes
from .joins import nearest, pairwise_distance

TINY = math.sqrt(2.0 ** -52)
#: Global solvers fit on at most this many rows, those of least hash of their key.
MAX_FIT_ROWS = 20_000


def predict_weighted(weights: DataFrame, points: DataFrame, p_id: str, y: str, query: str = "query_id", name: str = "prediction") -> DataFrame:
    """(query, prediction): sum of weight * y."""
    return weights.join(points.select(p_id, y), p_id).groupBy(query).agg(F.sum(F.col("weight") * F.col(y)).alias(name))


def classify_weighted(weights: DataFrame, points: DataFrame, p_id: str, label: str, query: str = "query_id") -> DataFrame:
    """(query, prediction): the label of the greatest summed weight, ties to the least label."""
    s = weights.join(points.select(p_id, label), p_id).groupBy(query, label).agg(F.sum("weight").alias("w"))
    best = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("w"), label))
    return s.withColumn("_r", best).where("_r = 1").select(query, F.col(label).alias("prediction"))


def knn_weights(queries: DataFrame, points: DataFrame, k: int, q_id: str, p_id: str, vec: str) -> DataFrame:
    """Equal weights on the k nearest points."""
    return nearest(queries.select(F.col(q_id).alias("query_id"), F.col(vec).alias("qv")), points, k, "query_id", p_id, "qv", vec).select("query_id", p_id, F.lit(1.0 / k).alias("weight"))


def best_k(df: DataFrame, p_id: str, vec: str, y: str, sample: int = 100, most: int = 64, seed: int = 0) -> int:
    """The power of two whose running mean of neighbours' responses is nearest to the response, on a sample of queries."""
    q = df.select(F.col(p_id).alias("query_id"), F.col(vec).alias("qv"), F.col(y).alias("qy")).orderBy(F.xxhash64("query_id", F.lit(seed)), "query_id").limit(sample)
    near = nearest(q.select("query_id", "qv"), df, most + 1, "query_id", p_id, "qv", vec).where(F.col("query_id") != F.col(p_id))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    run = near.join(df.select(p_id, F.col(y).cast("double").alias("y")), p_id).select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("k"), F.avg("y").over(w).alias("m"))
    err = run.join(q.select("query_id", "qy"), "query_id").groupBy("k").agg(F.avg(F.abs(F.col("m") - F.col("qy"))).alias("e"))
    rows = [r for r in err.collect() if r.k & (r.k - 1) == 0]  # at most `most` rows
    return min(rows, key=lambda r: (r.e, r.k)).k if rows else 1


def average(df: DataFrame, y: str) -> DataFrame:
    return df.agg(F.avg(y).alias("prediction"))


def shepard_weights(queries: DataFrame, points: DataFrame, q_id: str, p_id: str, vec: str) -> DataFrame:
    """Inverse squared distances, normalised; points nearer than sqrt(eps) share the whole weight."""
    q = queries.select(F.col(q_id).alias("query_id"), F.col(vec).alias("qv"), F.to_json(F.struct(F.col(q_id).alias("id"))).alias("_key"))  # null ids are one query too

    def hits(away):
        return np.sqrt(away) < TINY if (away < 2 * TINY * TINY).any() else np.zeros(away.shape, bool)

    def terms(diff, away, own):
        hit = hits(away)
        return np.where(hit, 0, 1 / away).sum(1), hit.sum(1)

    def weight(away, own):
        hit, total, alike = hits(away), own[:, :1], own[:, 1:]
        got = np.where(alike > 0, hit / alike, np.where(hit, 0, 1 / away) / total)
        return np.ma.masked_array(got, got <= 0)

    sums = joins.pair_sums(q, points, "_key", "qv", vec, [], 2, terms).where("sums[0] is not null")
    known = q.join(sums, "_key").withColumns({"total": F.col("sums")[0], "alike": F.col("sums")[1]})
    return joins.pair_rows(known, points, "query_id", p_id, "qv", vec, weight, ["total", "alike"], "weight", unknown=False)


def shepard_predict(queries: DataFrame, points: DataFrame, q_id: str, p_id: str, vec: str, y: str) -> DataFrame:
    """Prediction from four sums over all points of each query, in tiles of pairs."""
    split = joins.inverse_terms(TINY)

    def terms(diff, away, own):
        inv, both, hits = split(away, own)
        return *(inv @ both).T, *hits

    q = queries.select(F.col(q_id).alias("query_id"), F.col(vec).alias("qv"))
    s = F.col("sums")
    got = joins.pair_sums(q, points, "query_id", "qv", vec, [F.col(y), F.col(y).isNotNull().cast("double")], 4, terms)
    return got.select("query_id", F.when(s[2] > 0, s[3] / F.nullif(s[2], F.lit(0.0))).otherwise(s[1] / F.nullif(s[0], F.lit(0.0))).alias("prediction"))


def modified_shepard_radii(points: DataFrame, p_id: str, vec: str, m: int) -> DataFrame:
    """(point, radius): distance of each point to its (m+1)-th neighbour."""
    q = points.select(F.col(p_id).alias("query_id"), F.col(vec).alias("qv"))
    near = nearest(q, points, m + 2, "query_id", p_id, "qv", vec).where(F.col("query_id") != F.col(p_id))
    return near.groupBy("query_id").agg(F.max("distance").alias("radius")).select(F.col("query_id").alias(p_id), "radius")


def modified_shepard_weights(queries: DataFrame, points: DataFrame, q_id: str, p_id: str, vec: str, m: int = 10, stretch: float = 1.0) -> DataFrame:
    """((r - d)+ / (r d))^2 of each point's own radius, normalised; an exact hit takes all; outside all radii the m+1 nearest by 1/d^2.

    Many pairs are not compared all: a query visits the cells that the greatest radius among their points reaches it from.
    """
    if queries.count() * points.count() > joins.DIRECT_PAIRS:
        return _modified_shepard_in_cells(queries, points, q_id, p_id, vec, m, stretch)
    radii = modified_shepard_radii(points, p_id, vec, m)
    d = pairwise_distance(queries.select(F.col(q_id).alias("query_id"), F.col(vec).alias("qv")), points, "query_id", p_id, "qv", vec).join(radii, p_id)
    w, r, x = Window.partitionBy("query_id"), F.col("radius") * stretch, F.col("distance")
    hit = F.min("distance").over(w) < TINY
    inside = F.when(x < r, F.pow((r - x) / (r * x), F.lit(2.0))).otherwise(0.0)
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", p_id))).withColumn("any", F.max((x < r).cast("int")).over(w))
    raw = F.when(hit, (x < TINY).cast("double")).when(F.col("any") == 1, inside).otherwise(F.when(F.col("rank") <= m + 1, 1 / (x * x)).otherwise(0.0))
    return d.select("query_id", p_id, raw.alias("raw")).withColumn("weight", F.col("raw") / F.sum("raw").over(w)).where("weight > 0").drop("raw")


def _modified_shepard_in_cells(queries: DataFrame, points: DataFrame, q_id: str, p_id: str, vec: str, m: int, stretch: float) -> DataFrame:
    radii = modified_shepard_radii(points, p_id, vec, m).select(F.col(p_id).alias("_id"), (F.col("radius") * stretch).alias("_reach"))
    built = cells.build(points, p_id, vec)
    asks = queries.select(F.col(q_id).alias("ask"), F.col(vec).cast("array<double>").alias("c")).where(cells.usable("c"))
    near = cells.kept(cells.closest(built, asks.withColumns({"far": F.lit(False), "most": F.lit(None).cast("double")}), m + 1, vectors=False), "near")
    # a point's reach travels as one more component of its vector
    placed = cells.kept(built.placed.join(radii, "_id").withColumn("_x", F.concat("_x", F.array("_reach"))), "reach")
    most = np.zeros(len(built.pivots))
    for r in placed.groupBy("_cell").agg(F.max("_reach").alias("r")).collect():  # a row a cell
        most[r["_cell"]] = max(r["r"], TINY) * (1 + cells.SLACK)

    def bound(b, pivots, radius, count):
        return np.sqrt(cells.rough(cells.matrix(b.column("c")), pivots)) * (1 - cells.SLACK) <= radius + most + TINY

    def inside(q, x, order, ids):
        c, who, what, far = cells.matrix(q.column("c")), [], [], []
        step, widest = max(16, cells.TILE // len(x)), float((x[:, :-1] ** 2).sum(1).max())
        most = np.maximum(x[:, -1], TINY) ** 2
        for k in range(0, len(c), step):
            some = c[k: k + step]
            slack = cells.SLACK * (1 + (some * some).sum(1) + widest)
            i, at = np.nonzero(cells.rough(some, x[:, :-1]) <= most[None, :] + slack[:, None])  # what may be inside
            d = np.sqrt(cells.squared(x[at, :-1], some[i]))
            held = (d < x[at, -1]) | (d < TINY)
            i, at, d = i[held], at[held], d[held]
            who.append(i + k), what.append(at), far.append(np.stack([d, x[at, -1]], 1))
        both = np.concatenate(far)
        return [q.column("ask").combine_chunks().take(pa.array(np.concatenate(who))), ids.take(pa.array(np.concatenate(what))), both[:, 0], both[:, 1]]

    schema = T.StructType([T.StructField("ask", asks.schema["ask"].dataType), T.StructField("_id", built.id_type), T.StructField("d", T.DoubleType()), T.StructField("r", T.DoubleType())])
    held = cells.kept(cells.search(cells.Cells(placed, built.pivots, built.radius, built.count, built.id_type), asks, bound, inside, schema), "held")
    rest = near.join(held.select("ask").distinct(), "ask", "left_anti").select("ask", "_id", F.sqrt("value").alias("d"), F.lit(None).cast("double").alias("r"))
    w, r, x = Window.partitionBy("ask"), F.col("r"), F.col("d")
    raw = F.when(F.min("d").over(w) < TINY, (x < TINY).cast("double")).when(r.isNull(), 1 / (x * x)).otherwise(F.pow((r - x) / (r * x), F.lit(2.0)))
    rows = held.unionByName(rest).select("ask", "_id", raw.alias("raw"))
    return rows.select(F.col("ask").alias("query_id"), F.col("_id").alias(p_id), (F.col("raw") / F.sum("raw").over(w)).alias("weight")).where("weight > 0")


def linear_shepard_fit(points: DataFrame, p_id: str, vec: str, y: str, m: int | None = None, robust: bool = False) -> DataFrame:
    """(point, radius, slope): a weighted least-squares plane through each point on its nearest neighbours.

    With `robust`, ten reweighting steps (five with Huber's, five with Tukey's weights) follow.
    """
    dim = len(points.select(vec).first()[0])
    n = points.count()
    m = min(n - 1, m or (3 * dim) // 2 + 1)
    q = points.select(F.col(p_id).alias("query_id"), F.col(vec).alias("qv"), F.col(y).cast("double").alias("qy"))
    near = nearest(q.select("query_id", "qv"), points, m + 2, "query_id", p_id, "qv", vec).where(F.col("query_id") != F.col(p_id))
    rows = near.join(points.select(p_id, F.col(vec).alias("nv"), F.col(y).cast("double").alias("ny")), p_id).join(q, "query_id")
    lists = rows.groupBy("query_id", "qv", "qy").agg(F.collect_list(F.struct("distance", "nv", "ny")).alias("near"))  # m + 1 neighbours

    def run(batches):
        for b in batches:
            ids, rad, slopes = [], [], []
            for i, v, y0, near_ in zip(*(b.column(c).to_pylist() for c in ("query_id", "qv", "qy", "near")), strict=True):
                near_ = sorted(near_, key=lambda x: x["distance"])
                r = max(near_[-1]["distance"], 1e-300)
                a = np.array([x["nv"] for x in near_], float) - np.array(v, float)
                t = np.array([x["ny"] for x in near_], float) - y0
                dist = np.array([max(x["distance"], 1e-300) for x in near_])
                w = np.maximum(r * 1.1 - dist, 0) / (r * 1.1 * dist)
                s = np.linalg.lstsq(a * w[:, None], t * w, rcond=None)[0]
                for step in range(10 if robust else 0):
                    e = np.abs(t - a @ s)
                    c = max(np.median(e) / 0.6745, 1e-12)
                    u = e / c
                    g = np.where(u <= 1.345, 1.0, 1.345 / np.maximum(u, 1e-12)) if step < 5 else np.where(u < 4.685, (1 - (u / 4.685) ** 2) ** 2, 0.0)
                    if not g.any():
                        break
                    s = np.linalg.lstsq(a * (w * np.sqrt(g))[:, None], t * w * np.sqrt(g), rcond=None)[0]
                ids.append(i), rad.append(2 * r), slopes.append(s.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("query_id").type), pa.array(rad, pa.float64()), pa.array(slopes, pa.list_(pa.float64()))], names=[p_id, "radius", "slope"])

    kind = points.schema[p_id].dataType.simpleString()
    return lists.mapInArrow(run, f"{p_id} {kind}, radius double, slope array<double>")


def linear_shepard_predict(queries: DataFrame, points: DataFrame, fitted: DataFrame, q_id: str, p_id: str, vec: str, y: str) -> DataFrame:
    """Planes of the points whose (doubled) radius holds the query, weighted as by modified Shepard.

    All other points have the weight 1e-30 / d**2. Radii are searched for in cells, and their sums are the answer where all other weights
    together cannot reach the last digits; the remaining queries, as a rule those that no radius holds, sum over all points.
    """
    rows = cells.kept(points.select(p_id, F.col(vec).cast("array<double>").alias("pv"), F.col(y).cast("double").alias("y")).join(fitted, p_id), "planes")
    built = cells.build(rows, p_id, "pv")
    asks = queries.select(F.col(q_id).alias("ask"), F.col(vec).cast("array<double>").alias("c"))
    d, n = built.dims, int(built.count.sum())
    # radius, response and slope travel as more components of the vector
    carried = rows.select(F.col(p_id).alias("_id"), F.array("radius", "y").alias("_more"), "slope")
    placed = cells.kept(built.placed.join(carried, "_id").select("_id", F.concat("_x", "_more", "slope").alias("_x"), "_cell"), "planes")
    most = np.zeros(len(built.pivots))
    for r in placed.groupBy("_cell").agg(F.max(F.col("_x")[d]).alias("r")).collect():  # a row a cell
        most[r["_cell"]] = max(r["r"], TINY) * (1 + cells.SLACK)

    def bound(b, pivots, radius, count):
        return np.sqrt(cells.rough(cells.matrix(b.column("c")), pivots)) * (1 - cells.SLACK) <= radius + most + TINY

    def weighed(diff, away, own):
        """Sums of weight times plane and of weights; `own` are radius, response and slope."""
        x, r = np.sqrt(away), own[:, 0]
        w = np.where(x < TINY, 1e30, np.where(x < r, ((r - x) / (r * np.maximum(x, TINY))) ** 2, 1e-30 / np.maximum(away, 1e-300)))
        return (w * (own[:, 1] + sum(diff(k) * own[:, 2 + k] for k in range(d)))).sum(1), w.sum(1)

    def inside(q, x, order, ids):
        c, out = cells.matrix(q.column("c")), []
        for i in range(len(c)):
            away = cells.squared(x[:, :d], c[i])
            at = np.flatnonzero((np.sqrt(away) < x[:, d]) | (np.sqrt(away) < TINY))
            if len(at):
                f, w = weighed(lambda k, i=i, at=at: (c[i, k] - x[at, k])[None], away[None, at], x[at, d:])
                out.append((i, f[0], w[0]))
        who, f, w = (np.array(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0), np.zeros(0))
        return [q.column("ask").combine_chunks().take(pa.array(who.astype(int))), f, w]

    schema = T.StructType([T.StructField("ask", asks.schema["ask"].dataType), T.StructField("f", T.DoubleType()), T.StructField("w", T.DoubleType())])
    fine = asks.where(cells.usable("c"))
    held = cells.search(cells.Cells(placed, built.pivots, built.radius, built.count, built.id_type), fine, bound, inside, schema).groupBy("ask").agg(F.sum("f").alias("f"), F.sum("w").alias("w"))
    near = cells.closest(built, fine.withColumns({"far": F.lit(False), "most": F.lit(None).cast("double")}), 1).select("ask", "value")
    # all others weigh n * 1e-30 / (least squared distance) at most
    sure = F.col("w") * F.greatest("value", F.lit(TINY**2)) > n * 1e-9
    held = cells.kept(held.join(near, "ask").where(sure).select("ask", (F.col("f") / F.col("w")).alias("prediction")), "held")
    rest = asks.join(held.select("ask"), "ask", "left_anti")
    own = [F.col("radius"), F.col("y"), *[F.col("slope")[k] for k in range(d)]]
    left = joins.pair_sums(rest, rows, "ask", "c", "pv", own, 2, weighed).where("sums is not null")
    return held.unionByName(left.select("ask", (F.col("sums")[0] / F.col("sums")[1]).alias("prediction"))).withColumnRenamed("ask", "query_id")


def _local(queries: DataFrame, points: DataFrame, q_id: str, p_id: str, vec: str, weigh, distinct: bool = False) -> DataFrame:
    """(query_id, point, weight) by a numpy function of one query and all points of a bounded model.

    The model's points are what was fitted: at most MAX_FIT_ROWS, checked before they are broadcast. More points take the
    searches of meshes, which give the same weights.
    """
    spark = queries.sparkSession
    got = points.select(p_id, vec).limit(MAX_FIT_ROWS + 1).collect()
    if len(got) > MAX_FIT_ROWS:
        raise ValueError(f"more than {MAX_FIT_ROWS} points")
    if distinct and len({tuple(r[1]) for r in got}) < len(got):
        raise ValueError("this mesh needs distinct points")
    got.sort(key=lambda r: r[0])
    sent = spark.sparkContext.broadcast(([r[0] for r in got], np.array([r[1] for r in got], float)))
    kind = points.schema[p_id].dataType.simpleString()
    qkind = queries.schema[q_id].dataType.simpleString()

    def run(batches):
        ids, x = sent.value
        for b in batches:
            rows = []
            for q, v in zip(b.column("query_id").to_pylist(), b.column("qv").to_pylist(), strict=True):
                w = weigh(x, np.array(v, float))
                rows += [(q, ids[i], float(w[i])) for i in np.flatnonzero(w).tolist()]
            cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("query_id").type), pa.array(cols[1], pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()), pa.array(cols[2], pa.float64())], names=["query_id", p_id, "weight"])

    return queries.select(F.col(q_id).alias("query_id"), F.col(vec).alias("qv")).mapInArrow(run, f"query_id {qkind}, {p_id} {kind}, weight double")


def voronoi_weights_of(x: np.ndarray, q: np.ndarray, few: int = 48) -> np.ndarray:
    """max(0, 1 - greatest over other centres of the query's place on the way to it, twice), normalised.

    A centre is out as soon as one other centre says so. The ones nearest to the query rule out nearly all; only what they
    leave is compared with every centre.
    """
    n = len(x)
    d2 = ((x - q) ** 2).sum(1)
    if d2.min() < 1e-24:
        w = (d2 < 1e-24).astype(float)
        return w / w.sum()

    def farthest(own: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The greatest (q - c) . (o - c) / |o - c|^2 of each centre c over other centres o."""
        c, o = x[own], x[others]
        num = (o @ q)[None, :] - (c @ q)[:, None] - c @ o.T + (c * c).sum(1)[:, None]
        den = (c * c).sum(1)[:, None] + (o * o).sum(1)[None, :] - 2 * c @ o.T
        same = own[:, None] == others[None, :]
        return np.where(same, -np.inf, num / np.where(same | (den == 0), np.inf, den)).max(1)

    near = np.argpartition(d2, few)[:few] if n > few else np.arange(n)
    left = np.flatnonzero(farthest(np.arange(n), near) < 1)
    w = np.zeros(n)
    for at in range(0, len(left), 256):
        own = left[at: at + 256]
        w[own] = np.maximum(0, 1 - np.maximum(farthest(own, np.arange(n)), 0))
    if not w.any():
        w[d2.argmin()] = 1
    return w / w.sum()


def _many(points: DataFrame) -> bool:
    return points.limit(MAX_FIT_ROWS + 1).count() > MAX_FIT_ROWS


def voronoi_weights(queries: DataFrame, points: DataFrame, q_id: str, p_id: str, vec: str) -> DataFrame:
    if _many(points):
        return meshes.voronoi_weights(queries, points, q_id, p_id, vec)
    return _local(queries, points, q_id, p_id, vec, voronoi_weights_of, True)


def box_widths(x: np.ndarray) -> np.ndarray:
    """(n, dims, 2): how far each point's box reaches down and up; infinite where no point bounds it.

    Boxes grow to the nearest point inside by largest coordinate difference, which ends its farthest side. Distances rise, so
    each side is set once: after each the next point inside is looked up at once.
    """
    n, d = x.shape
    out = np.full((n, d, 2), np.inf)
    axes = np.arange(d)
    for i in range(n):
        diff = x - x[i]
        order = np.argsort(np.abs(diff).max(1), kind="stable")
        diff = diff[order[order != i]]
        reach, side = np.abs(diff), (diff > 0).astype(int)
        at = 0
        while at < len(diff):
            inside = (reach[at:] < out[i][axes, side[at:]]).all(1)
            step = int(inside.argmax())
            if not inside[step]:
                break
            at += step
            k = int(reach[at].argmax())
            out[i, k, side[at, k]] = reach[at, k]
            at += 1
    return out


def box_mesh_weights(queries: DataFrame, points: DataFrame, q_id: str, p_id: str, vec: str) -> DataFrame:
    """Products of linear hats over each point's box (an unbounded side counts 1), normalised."""
    if _many(points):
        return meshes.box_mesh_weights(queries, points, q_id, p_id, vec)
    cache: dict[int, np.ndarray] = {}

    def weigh(x, q):
        if id(x) not in cache:
            cache.clear()
            cache[id(x)] = box_widths(x)
        wide = cache[id(x)]
        v = q - x
        side = (v > 0).astype(int)
        reach = np.take_along_axis(wide, side[:, :, None], 2)[:, :, 0]
        w = np.prod(np.where(np.isinf(reach), 1.0, np.maximum(0, 1 - np.abs(v) / reach)), axis=1)
        if not w.any():
            w[((v) ** 2).sum(1).argmin()] = 1
        return w / w.sum()

    return _local(queries, points, q_id, p_id, vec, weigh)


def delaunay_weights_of(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Barycentric weights in the Delaunay simplex that holds the query, by linear programming on the lifted points.

    The simplex minimises sum w |x|^2 subject to sum w x = q, sum w = 1, w >= 0; found with a small
    active-set (primal simplex) method. A query outside the hull takes its nearest point of it.
    """
    n, d = x.shape
    shift, scale = x.mean(0), max(np.abs(x - x.mean(0)).max(), 1e-300)
    y, t = (x - shift) / scale, (q - shift) / scale
    a, c = np.vstack([y.T, np.ones(n)]), (y**2).sum(1)
    big = 1e6 * (1 + np.abs(c).max())
    b = np.append(t, 1.0)
    sign = np.where(b < 0, -1.0, 1.0)
    full, cost = np.hstack([a, np.diag(sign)]), np.append(c, np.full(d + 1, big))  # artificial start
    basis = list(range(n, n + d + 1))
    for _ in range(50 * (d + 2) + n):
        m = full[:, basis]
        try:
            lam = np.linalg.solve(m.T, cost[basis])
        except np.linalg.LinAlgError:
            break
        red = cost[:n] - lam @ full[:, :n]
        j = int(red.argmin())
        if red[j] > -1e-9:
            break
        col, sol = np.linalg.solve(m, full[:, j]), np.linalg.solve(m, b)
        ratios = np.where(col > 1e-12, sol / np.where(col > 1e-12, col, 1), np.inf)
        if not np.isfinite(ratios).any():
            break
        basis[int(ratios.argmin())] = j
    w = np.zeros(n + d + 1)
    w[basis] = np.linalg.lstsq(full[:, basis], b, rcond=None)[0]
    w = np.maximum(w[:n], 0)
    if w.sum() <= 1e-9:
        w = np.zeros(n)
        w[((x - q) ** 2).sum(1).argmin()] = 1
    return np.where(w < 1e-12, 0, w) / w.sum()


def delaunay_weights(queries: DataFrame, points: DataFrame, q_id: str, p_id: str, vec: str) -> DataFrame:
    if _many(points):
        return meshes.delaunay_weights(queries, points, q_id, p_id, vec, delaunay_weights_of)
    return _local(queries, points, q_id, p_id, vec, delaunay_weights_of)


@dataclass
class LinearModel:
    """Coefficients of named terms."""

    terms: list[str]
    coefficients: list[float]
    inputs: list[str]
    degree: int = 1

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        exprs = dict(polynomial_terms(self.inputs, self.degree))
        out = F.lit(0.0)
        for t, c in zip(self.terms, self.coefficients, strict=True):
            out = out + exprs[t] * float(c)
        return df.withColumn(name, out)


def polynomial_fit(df: DataFrame, inputs: list[str], y: str, degree: int = 1, weight: str | None = None) -> LinearModel:
    """Least squares over all monomials from one aggregate: the normal equations, scaled, come to the driver."""
    terms = polynomial_terms(inputs, degree)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    t = df.select(*[e.alias(f"t{i}") for i, (_, e) in enumerate(terms)], F.col(y).cast("double").alias("y"), w.alias("w")).where("y is not null")
    k = len(terms)
    row = t.agg(*[F.sum(F.col("w") * F.col(f"t{i}") * F.col(f"t{j}")).alias(f"a{i}_{j}") for i in range(k) for j in range(i + 1)], *[F.sum(F.col("w") * F.col(f"t{i}") * F.col("y")).alias(f"b{i}") for i in range(k)]).first()
    a = np.array([[row[f"a{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    b = np.array([row[f"b{i}"] or 0.0 for i in range(k)])
    s = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
    c = np.linalg.lstsq(a * np.outer(s, s), b * s, rcond=1e-13)[0] * s
    return LinearModel([n for n, _ in terms], c.tolist(), inputs, degree)


def linear_fit(df: DataFrame, inputs: list[str], y: str, weight: str | None = None) -> LinearModel:
    return polynomial_fit(df, inputs, y, 1, weight)


def simple_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """(slope, intercept, r2) of one input, in the engine."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def decision_tree(df: DataFrame, inputs: list[str], y: str, depth: int = 5):
    """(model, function that adds `prediction`) of a regression tree."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    va = VectorAssembler(inputCols=inputs, outputCol="_features", handleInvalid="skip")
    model = DecisionTreeRegressor(featuresCol="_features", labelCol=y, maxDepth=depth, seed=0).fit(va.transform(df))
    return model, lambda d: model.transform(va.transform(d)).drop("_features")


class Rows:
    """All rows without nulls of a table as matrices (x, t), for solvers that need sums over them.

    Up to `MAX_FIT_ROWS` rows, counted first, are held by the driver; more stay where they are, in order of the inputs inside a
    task, and every sum is a pass over them. Either way each row counts, and solvers take the same steps.
    """

    def __init__(self, df: DataFrame, inputs: list[str], y: str):
        self.inputs, self.held = len(inputs), None
        self.names = [f"x{i}" for i in range(self.inputs)]
        self._take(df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(inputs, self.names, strict=True)], F.col(y).cast("double").alias("t")).dropna())

    def _take(self, df: DataFrame) -> None:
        self.df, self.n = df, df.count()
        self._hold(self.n, lambda: cells.kept(df.sortWithinPartitions(*self.names), "rows"))  # passes read these columns alone

    def _hold(self, rows: int, keep) -> None:
        if not rows:
            raise ValueError("no row without nulls to fit on")
        if rows <= MAX_FIT_ROWS:
            got = self.df.orderBy(*self.df.columns).collect()
            self.held = _split(np.array([tuple(r) for r in got], float).reshape(rows, len(self.df.columns)), self.inputs)
        else:
            self.df = keep()
            self.parts = self.df.rdd.getNumPartitions()

    def sums(self, function) -> list[np.ndarray]:
        """The sums over all rows of the arrays that `function(x, t)` returns for some of them."""
        if self.held is not None:
            return [np.asarray(a, float) for a in function(*self.held)]
        inputs = self.inputs

        def some(batches):
            total = None
            for b in batches:
                if b.num_rows:
                    m = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1)
                    got = [np.asarray(a, float) for a in function(*_split(m, inputs))]
                    total = got if total is None else [u + v for u, v in zip(total, got, strict=True)]
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([[a.tobytes() for a in total]], pa.list_(pa.binary())), pa.array([[list(a.shape) for a in total]], pa.list_(pa.list_(pa.int32())))], names=["a", "s"])

        def add(batches):
            total, shapes = None, None
            for b in batches:
                for cells, dims in zip(b.column("a").to_pylist(), b.column("s").to_pylist(), strict=True):
                    got = [np.frombuffer(c).reshape(d) for c, d in zip(cells, dims, strict=True)]
                    total, shapes = (got if total is None else [u + v for u, v in zip(total, got, strict=True)]), dims
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([[np.ascontiguousarray(a).tobytes() for a in total]], pa.list_(pa.binary())), pa.array([shapes], pa.list_(pa.list_(pa.int32())))], names=["a", "s"])

        kind = "a array<binary>, s array<array<int>>"
        sums = self.df.mapInArrow(some, kind)
        if self.parts > 64:  # two levels, so that the driver adds up the square root of the tasks' sums or so
            sums = sums.repartition(math.isqrt(self.parts)).mapInArrow(add, kind)
        got = sums.collect()
        out = None
        for r in got:
            one = [np.frombuffer(bytes(c)).reshape(d) for c, d in zip(r.a, r.s, strict=True)]
            out = one if out is None else [u + v for u, v in zip(out, one, strict=True)]
        return out

    def moments(self) -> tuple[np.ndarray, np.ndarray, float, float]:
        """(means of x, variances of x, mean of t, variance of t)."""
        sx, st = self.sums(lambda x, t: [x.sum(0), t.sum()])
        mx, mt = sx / self.n, float(st) / self.n
        vx, vt = self.sums(lambda x, t: [((x - mx) ** 2).sum(0), ((t - mt) ** 2).sum()])
        return mx, vx / self.n, mt, float(vt) / self.n

    def quantiles(self, place: int, shares: list[float]) -> np.ndarray:
        """Of an input by its place, or of t for -1; by one rule at every size, to 1 in 10,000 ranks."""
        name = "t" if place < 0 else f"x{place}"
        return np.array(self.df.agg(F.percentile_approx(name, shares, 10_000).alias("q")).first().q)


def _split(m: np.ndarray, inputs: int) -> tuple[np.ndarray, ...]:
    return m[:, :inputs], *m[:, inputs:].T


class Points(Rows):
    """Rows of equal inputs as one (x, mean response t, number n), for solvers that add up squared errors.

    A row's error is that of its point's mean and its own distance from the mean, and no fit changes the sum `within` of these
    distances' squares: sums over points with it are those over all rows. `n` is the number of rows.
    """

    def _take(self, df: DataFrame) -> None:
        n = F.count("*")
        self.df = cells.kept(df.groupBy(*self.names).agg(F.avg("t").alias("t"), n.cast("double").alias("n"), (F.var_pop("t") * n).alias("within")), "points")
        facts = self.df.agg(F.count("*").alias("points"), F.sum("n").alias("n"), F.sum("within").alias("within")).first()
        self.n, self.within, self.df = int(facts.n or 0), facts.within, self.df.drop("within")
        self._hold(facts.points, lambda: self.df)

    def moments(self) -> tuple[np.ndarray, np.ndarray, float, float]:
        sx, st = self.sums(lambda x, t, n: [n @ x, n @ t])
        mx, mt = sx / self.n, float(st) / self.n
        vx, vt = self.sums(lambda x, t, n: [n @ (x - mx) ** 2, n @ (t - mt) ** 2])
        return mx, vx / self.n, mt, (float(vt) + self.within) / self.n

    def quantiles(self, place: int, shares: list[float]) -> np.ndarray:
        raise NotImplementedError("quantiles need rows")


@dataclass
class ArrayModel:
    """A model with numpy parameters and a numpy predict function; scored with Arrow batches."""

    kind: str
    inputs: list[str]
    parameters: dict = field(default_factory=dict)

    def values(self, x: np.ndarray) -> np.ndarray:
        return PREDICT[self.kind](self.parameters, x)

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(self)
        from pyspark.sql import types as T

        schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

        def run(batches):
            own = sent.value
            for b in batches:
                x = np.stack([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in own.inputs], 1) if b.num_rows else np.zeros((0, len(own.inputs)))
                yield b.append_column(name, pa.array(own.values(x).astype(float), pa.float64()))

        return df.mapInArrow(run, schema)

    def to_json(self) -> str:
        return json.dumps({"kind": self.kind, "inputs": self.inputs, "parameters": {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in self.parameters.items()}})

    @classmethod
    def from_json(cls, text: str) -> ArrayModel:
        d = json.loads(text)
        return cls(d["kind"], d["inputs"], {k: np.array(v) if isinstance(v, list) else v for k, v in d["parameters"].items()})


def _svr_values(p, x):
    z = (x - p["mean"]) / p["scale"]
    f = np.sqrt(2.0 / len(p["shift"])) * np.cos(z @ p["freq"] + p["shift"]) if p["basis"] == "rbf" else np.hstack([np.ones((len(z), 1)), z, z**2, z**3])
    return f @ p["weights"] + p["bias"]


def _hinges(p, x):
    cols = [np.ones(len(x))]
    for terms in p["terms"]:
        col = np.ones(len(x))
        for j, knot, sign in terms:
            col = col * np.maximum(0, sign * (x[:, int(j)] - knot))
        cols.append(col)
    return np.stack(cols, 1)


def _mars_values(p, x):
    return _hinges(p, x) @ p["weights"]


def _network_layers(p, x):
    h = (x - p["mean"]) / p["scale"]
    out = [h]
    i = 0
    while f"w{i}" in p:
        h = h @ p[f"w{i}"] + p[f"b{i}"]
        if f"w{i + 1}" in p:
            h = np.maximum(h, 0)
        out.append(h)
        i += 1
    return out


def _network_values(p, x):
    return _network_layers(p, x)[-1][:, 0] * p["y_scale"] + p["y_mean"]


PREDICT = {"svr": _svr_values, "mars": _mars_values, "network": _network_values, "plrm": _network_values}


def svr_fit(df: DataFrame, inputs: list[str], y: str, basis: str = "rbf", features: int = 200, epsilon: float = 0.01, l2: float = 1e-4, seed: int = 0) -> ArrayModel:
    """Support-vector regression in random Fourier (rbf) or cubic features: the epsilon-insensitive loss by reweighted least squares."""
    rows, rng = Rows(df, inputs, y), np.random.default_rng(seed)
    mean, var, _, spread = rows.moments()
    d, bias, spread = rows.inputs, float(rows.quantiles(-1, [0.5])[0]), max(math.sqrt(spread), 1e-12)
    p = {"basis": basis, "mean": mean, "scale": np.where(var == 0, 1, np.sqrt(var)), "freq": rng.standard_normal((d, features)) / math.sqrt(d), "shift": rng.uniform(0, 2 * math.pi, features), "bias": bias}
    size = features if basis == "rbf" else 1 + 3 * d
    own = p | {"weights": np.eye(size), "bias": 0.0}

    def step(w):
        """Normal equations of squares without weights `w`, else of the loss about them, by reweighted squares."""
        def part(x, t):
            # rows of equal inputs in a row have one vector of features: their weights are added up first
            heads = np.flatnonzero(np.append(True, (x[1:] != x[:-1]).any(1)))
            f, g = _svr_values(own, x[heads]), (t - bias) / spread
            if w is None:
                u, v = np.ones(len(g)), g
            else:
                e = g - np.repeat(f @ w, np.diff(np.append(heads, len(x))))
                over = np.maximum(np.abs(e) - epsilon, 0)
                u = np.where(over > 0, 1 / np.maximum(np.abs(e), 1e-6), 1e-3)
                v = u * (g - epsilon * np.sign(e) * (over > 0))
            return [(f * np.add.reduceat(u, heads)[:, None]).T @ f, f.T @ np.add.reduceat(v, heads)]
        a, b = rows.sums(part)
        return np.linalg.solve(a / rows.n + l2 * np.eye(size), b / rows.n)

    w = step(None)
    for _ in range(20):
        w = step(w)
    p["weights"] = w * spread
    return ArrayModel("svr", inputs, p)


def mars_fit(df: DataFrame, inputs: list[str], y: str, max_bases: int = 15, interaction: int = 1, knots: int = 20) -> ArrayModel:
    """Adaptive regression splines: hinge pairs added greedily, then dropped by generalised cross-validation."""
    rows = Rows(df, inputs, y)
    _, _, middle, var = rows.moments()
    knot_list = [np.unique(rows.quantiles(j, np.linspace(0, 1, knots + 2)[1:-1].tolist())) for j in range(rows.inputs)]

    def solved(gram: np.ndarray, cross: np.ndarray, total: float) -> tuple[np.ndarray, float]:
        """Weights and the sum of squared errors from the normal equations."""
        s = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
        w = np.linalg.lstsq(gram * np.outer(s, s), cross * s, rcond=1e-12)[0] * s
        return w, max(0.0, float(total - cross @ w))

    terms: list[list[list[float]]] = []
    total, best = var * rows.n, var * rows.n
    while len(terms) + 2 <= max_bases:
        pairs = [[[*parent, [j, k, 1.0]], [*parent, [j, k, -1.0]]] for parent in [[], *[tm for tm in terms if len(tm) < interaction]]
                 for j, ks in enumerate(knot_list) if not any(int(h[0]) == j for h in parent) for k in ks.tolist()]
        if not pairs:
            break

        def part(x, t, terms=terms, pairs=pairs):
            b, c = _hinges({"terms": terms}, x), _hinges({"terms": [tm for two in pairs for tm in two]}, x)[:, 1:]
            t = t - middle
            two = c.reshape(len(x), -1, 2)
            return [b.T @ b, b.T @ c, np.einsum("npi,npj->pij", two, two), b.T @ t, c.T @ t]

        bb, bc, cc, bt, ct = rows.sums(part)  # one pass tries all pairs of hinges
        top = None
        for i, two in enumerate(pairs):
            at = slice(2 * i, 2 * i + 2)
            err = solved(np.block([[bb, bc[:, at]], [bc[:, at].T, cc[i]]]), np.concatenate([bt, ct[at]]), total)[1]
            if top is None or err < top[0]:
                top = (err, [*terms, *two])
        if top[0] > best * 0.999:
            break
        best, terms = top

    def whole(x, t):
        h = _hinges({"terms": terms}, x)
        return [h.T @ h, h.T @ (t - middle)]

    gram, cross = rows.sums(whole)
    held = list(range(len(terms)))

    def gcv(places):
        at = [0, *(i + 1 for i in places)]
        return solved(gram[np.ix_(at, at)], cross[at], total)[1] / max(1e-9, (1 - (1 + 2.5 * len(places)) / rows.n)) ** 2

    keep = gcv(held)
    while held:
        tries = [held[:i] + held[i + 1:] for i in range(len(held))]
        scores = [gcv(h) for h in tries]
        if min(scores) > keep:
            break
        keep, held = min(scores), tries[int(np.argmin(scores))]
    at = [0, *(i + 1 for i in held)]
    weights = solved(gram[np.ix_(at, at)], cross[at], total)[0]
    weights[0] += middle
    return ArrayModel("mars", inputs, {"terms": [[[float(v) for v in h] for h in terms[i]] for i in held], "weights": weights})


def network_fit(df: DataFrame, inputs: list[str], y: str, layers: tuple[int, ...] = (32, 32), steps: int = 1000, rate: float = 0.01, seed: int = 0, by_variance: bool = False, kind: str = "network") -> ArrayModel:
    """A network of ramps fitted by Adam steps on the gradient over all rows, the best step kept; stops when 200 steps bring nothing.

    `by_variance` divides inputs and outputs by their variance instead of their deviation.
    """
    rows, rng = Points(df, inputs, y), np.random.default_rng(seed)
    mean, var, y_mean, y_var = rows.moments()
    size = (lambda v: np.where(v == 0, 1, v)) if by_variance else (lambda v: np.where(v == 0, 1, np.sqrt(v)))
    p = {"mean": mean, "scale": size(var), "y_mean": y_mean, "y_scale": float(size(np.array(y_var)))}
    widths = [rows.inputs, *layers, 1]
    names = []
    for i, (a, b) in enumerate(zip(widths, widths[1:], strict=False)):
        p[f"w{i}"], p[f"b{i}"] = rng.standard_normal((a, b)) * math.sqrt(2 / a), np.zeros(b)
        names += [f"w{i}", f"b{i}"]
    m, v = {k: 0.0 for k in names}, {k: 0.0 for k in names}
    best, kept, since = np.inf, None, 0
    for step in range(1, steps + 1):
        def part(x, t, n, p=p):
            h = _network_layers(p, x)
            e = h[-1][:, 0] - (t - p["y_mean"]) / p["y_scale"]
            g, out = (2 * n * e)[:, None], [n @ (e * e)]
            for i in reversed(range(len(widths) - 1)):
                out += [h[i].T @ g, g.sum(0)]
                g = (g @ p[f"w{i}"].T) * (h[i] > 0) if i else g
            return out

        loss, *slopes = (a / rows.n for a in rows.sums(part))
        loss += rows.within / p["y_scale"] ** 2 / rows.n
        if loss < best - 1e-9:
            best, kept, since = float(loss), {k: p[k].copy() for k in names}, 0
        else:
            since += 1
            if since > 200:
                break
        for j, i in enumerate(reversed(range(len(widths) - 1))):
            for k, d in ((f"w{i}", slopes[2 * j]), (f"b{i}", slopes[2 * j + 1])):
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    p |= kept or {}
    return ArrayModel(kind, inputs, p)


def plrm_fit(df: DataFrame, inputs: list[str], y: str, **kw) -> ArrayModel:
    """Piecewise-linear regression model: the network above with variance scaling and small steps."""
    return network_fit(df, inputs, y, **({"layers": (20, 20), "by_variance": True, "kind": "plrm"} | kw))


def network_embedding(model: ArrayModel, df: DataFrame, name: str = "embedding") -> DataFrame:
    """Add the last hidden state of a network: the coordinates that it learned."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    from pyspark.sql import types as T

    def run(batches):
        own = sent.value
        for b in batches:
            x = np.stack([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in own.inputs], 1) if b.num_rows else np.zeros((0, len(own.inputs)))
            yield b.append_column(name, pa.array(_network_layers(own.parameters, x)[-2].tolist(), pa.list_(pa.float64())))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def embedding_interpolator(train: DataFrame, queries: DataFrame, inputs: list[str], y: str, p_id: str, q_id: str, k: int = 3, **kw) -> DataFrame:
    """A network's embedding, then the mean response of the k nearest points in it."""
    model = plrm_fit(train, inputs, y, **kw)
    a, b = network_embedding(model, train), network_embedding(model, queries)
    return predict_weighted(knn_weights(b, a, k, q_id, p_id, "embedding"), train, p_id, y)


def split_fit(df: DataFrame, queries: DataFrame, key: str, shards: int, fit, seed: int = 0):
    """Mean prediction of one model per hashed shard; `fit(shard)` returns something with predict(df)."""
    parts = [fit(df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(shards)) == s)) for s in range(shards)]
    out = queries
    for i, p in enumerate(parts):
        out = p.predict(out, f"_p{i}")
    mean = sum((F.col(f"_p{i}") for i in range(1, shards)), F.col("_p0")) / shards
    return out.withColumn("prediction", mean).drop(*[f"_p{i}" for i in range(shards)])


def unique_points(df: DataFrame, inputs: list[str], y: str) -> DataFrame:
    """Distinct points with their mean response."""
    return df.groupBy(*inputs).agg(F.avg(y).alias(y))


def subset_averages(df: DataFrame, inputs: list[str], y: str) -> DataFrame:
    """Mean response of the distinct points of every subset of the inputs; `subset` has a bit for each input left out."""
    return df.cube(*inputs).agg(F.avg(y).alias(y), F.grouping_id().alias("subset"))


def timed(fit, predict, sizes: list[int], table) -> list[tuple[int, float, float]]:
    """(size, seconds to fit, seconds to predict) of a model on tables of growing size; `table(n)` makes one."""
    import time

    out = []
    for n in sizes:
        df = table(n)
        began = time.perf_counter()
        model = fit(df)
        fitted = time.perf_counter()
        predict(model, df).write.format("noop").mode("overwrite").save()
        out.append((n, fitted - began, time.perf_counter() - fitted))
    return out


def fit_errors(fits: dict, folded: DataFrame, y: str, folds: int) -> list[tuple[str, int, float]]:
    """(model, fold, mean squared error on the fold) of models fitted on the other folds."""
    from .sampling import fold_split

    out = []
    for name, fit in fits.items():
        for b in range(folds):
            train, test = fold_split(folded, b)
            err = fit(train).predict(test).agg(F.avg(F.pow(F.col("prediction") - F.col(y), F.lit(2.0)))).first()[0]
            out.append((name, b, err))
    return out
