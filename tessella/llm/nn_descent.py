"""Embedding near-dedup by NN-descent.

Equal vectors are one node with a weight. Every node starts with neighbours that lie next to it in
the order of a few random projections; then neighbours of neighbours are compared, round by round:
each node's list and a bounded, hashed choice of the lists it is on meet in one local join, where a
pair counts if it improves a list. A round that improves few lists is the last.

A list whose last entry is still a link is saturated: there are more links than it can hold. It is
enlarged to its whole component: vectors within half the link angle of a pivot all link with one
another (angles obey the triangle inequality), so they are counted, not paired; each of the others
is compared with every member, in blocks. Cosines that decide a link are always double precision.

Recall is then audited against brute force, for a fixed number of vectors of all and the same number
of those with links: a true link counts as found only if it is in the result. While it is short of
the target, lists grow and rounds go on; after the last growth, all distinct vectors are compared in
blocks, however many there are (`EXACT_ROWS` set to a number makes the call fail beyond it).

Defined cases: null and zero vectors and those with null or non-finite components are nodes without
links; vectors link only with others of their length, and every length is searched (those of at most
`FEW_ROWS` vectors, but for the commonest one, exactly and all in one step); equal vectors link with one another; different
vectors with equal ids are one node with the partners of any, rows with a null id keep a null component; ties between
neighbours go to the lesser id; other columns are not carried, whatever their names; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema, discard, task_count, written
from .components import components

THRESHOLD = 0.9
LIST = 8
REVERSE = 8
PROJECTIONS = 4
ROUNDS = 6
AUDIT = 64
RECALL = 0.95
GROWTHS = 2
BLOCK = 512
FEW_ROWS = 1024
#: More vectors than this are refused where lists fall short, for callers that want a bound on the comparison in blocks; None: all are compared.
EXACT_ROWS: int | None = None
EXACT_BLOCK = 4096


def _unit(vectors: DataFrame) -> DataFrame:
    """Add `v`, the vector as packed unit-length doubles."""
    def run(batches):
        for b in batches:
            out = []
            for x in b.column("e").to_pylist():
                a = np.array(x, np.float64)
                out.append((a / np.abs(a).max() / np.linalg.norm(a / np.abs(a).max())).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("weight"), b.column("d"), pa.array(out, pa.binary())], names=["node", "weight", "d", "v"])

    return vectors.mapInArrow(run, "node long, weight long, d int, v binary")


def _matrix(cells, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(cells), kind).reshape(len(cells), -1)


def _start(units: DataFrame, tasks: int, seed: int) -> DataFrame:
    """Pairs (a, b) of nodes that are near in the order of a random projection."""
    def run(batches):
        planes = None
        for b in batches:
            x = _matrix(b.column("v").to_pylist()) if b.num_rows else np.zeros((0, 1))
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((x.shape[1], PROJECTIONS * 9))
            p = x @ planes
            for t in range(PROJECTIONS):
                own = p[:, 9 * t: 9 * t + 9]
                code = ((own[:, :8] > 0) * (1 << np.arange(8))).sum(1) + 256 * t
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(code.astype(np.int32)), pa.array(own[:, 8])], names=["node", "code", "p"])

    def beside(batches):
        """Each node with those next to it under its code; rows come in order."""
        held = None
        for b in batches:
            node, code = b.column("node").to_numpy(), b.column("code").to_numpy()
            if held is not None:
                node, code = np.concatenate([held[0], node]), np.concatenate([held[1], code])
            pairs = [(node[:-k][same], node[k:][same]) for k in range(1, LIST // 2 + 1) if len(node) > k for same in [code[:-k] == code[k:]]]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*pairs, strict=True)], names=["a", "b"])
            held = node[-(LIST // 2):], code[-(LIST // 2):]

    codes = units.mapInArrow(run, "node long, code int, p double")
    # ranges of (code, place in the projection) hold nearly equal numbers of rows however many share a code
    ranged = codes.repartitionByRange(tasks, "code", "p", "node").sortWithinPartitions("code", "p", "node")
    return ranged.select("node", "code").mapInArrow(beside, "a long, b long").distinct()


def _scored(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """(a, b, s) of pairs, cosines in double precision."""
    def run(batches):
        for b in batches:
            s = np.einsum("ij,ij->i", _matrix(b.column("va").to_pylist()), _matrix(b.column("vb").to_pylist())) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(s)], names=["a", "b", "s"])

    full = pairs.join(units.select(F.col("node").alias("a"), F.col("v").alias("va")), "a").join(units.select(F.col("node").alias("b"), F.col("v").alias("vb")), "b")
    return full.select("a", "b", "va", "vb").mapInArrow(run, "a long, b long, s double")


def _top(both: DataFrame, size: int) -> DataFrame:
    """The best `size` neighbours of each node, of directed edges (a, b, s, fresh)."""
    one = both.groupBy("a", "b").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    return one.withColumn("r", rank).where(F.col("r") <= size)


def _directed(pairs: DataFrame, fresh: int) -> DataFrame:
    return pairs.select("a", "b", "s", F.lit(fresh).alias("fresh")).union(pairs.select("b", "a", "s", F.lit(fresh)))


def _local_join(graph: DataFrame, units: DataFrame, size: int) -> DataFrame:
    """Pairs of neighbours of a common node that would improve a list of either, scored."""
    # the worst entry of each full list is the bar that a new neighbour has to pass
    bars = graph.groupBy("a").agg(F.when(F.count("*") >= size, F.min("s")).otherwise(F.lit(-1.0)).alias("bar"))
    choice = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("fresh"), F.xxhash64("a", "b")))
    back = graph.withColumn("k", choice).where(F.col("k") <= REVERSE).select(F.col("b").alias("u"), F.col("a").alias("x"), "fresh")
    members = graph.select(F.col("a").alias("u"), F.col("b").alias("x"), "fresh").union(back).groupBy("u", "x").agg(F.max("fresh").alias("fresh"))
    sent = members.join(units.join(bars, units.node == bars.a, "left").select(F.col("node").alias("x"), F.coalesce("bar", F.lit(-1.0)).alias("bar"), "v"), "x")
    lists = sent.groupBy("u").agg(F.collect_list(F.struct("x", "bar", "fresh", "v")).alias("m"))  # list and choice are bounded
    kinds = arrow_schema(graph.sparkSession, "a long, b long, s double")

    def run(batches):
        for batch in batches:
            out = []
            for m in batch.column("m"):
                f = m.values
                x, bar, fresh = (f.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                v = _matrix(f.field(3).to_pylist())
                s = v @ v.T
                good = np.triu((s > np.minimum.outer(bar, bar)) & (np.maximum.outer(fresh, fresh) > 0), 1)
                i, j = np.nonzero(good)
                out.append((np.minimum(x[i], x[j]), np.maximum(x[i], x[j]), s[i, j]))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=kinds)

    return lists.select("m").mapInArrow(run, "a long, b long, s double").distinct()


def _audit(units: DataFrame, links: DataFrame, whole: DataFrame, threshold: float, seed: int) -> float:
    """Share of the true links of up to 2 x `AUDIT` vectors that the result has: as `links` or inside a component counted `whole`.

    Half of the vectors are any, half have a link among their neighbours in projections that the search has not used, so
    whether the search found a link has no part in the choice.
    """
    def some(nodes):
        return nodes.orderBy(F.xxhash64("node"), "node").limit(AUDIT)

    fresh = _scored(_start(units, task_count(units.sparkSession), seed), units).where(F.col("s") >= threshold)
    linked = fresh.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = {r.node for r in some(units.select("node")).union(some(linked)).collect()}  # a fixed number of vectors
    if not ids:
        return 1.0
    picked = units.where(F.col("node").isin(sorted(ids))).select("node", "v").collect()
    ids, q = np.array([r.node for r in picked]), _matrix([bytes(r.v) for r in picked])

    def run(batches):
        for b in batches:
            if b.num_rows:
                s = _matrix(b.column("v").to_pylist()) @ q.T
                i, j = np.nonzero(s >= threshold)
                yield pa.RecordBatch.from_arrays([pa.array(ids[j]), b.column("node").take(pa.array(i))], names=["a", "b"])

    true = units.select("node", "v").mapInArrow(run, "a long, b long").where("a <> b")
    held = links.select("a", "b").union(links.select("b", "a")).distinct().withColumn("hit", F.lit(1))
    found = (true.join(held, ["a", "b"], "left").join(whole.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
             .join(whole.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left"))
    n, got = found.agg(F.count("*"), F.count_if(F.col("hit").isNotNull() | F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)))).first()
    return 1.0 if not n else got / n


def refined(units: DataFrame, graph: DataFrame, size: int, n: int, rounds: int) -> DataFrame:
    """The lists (a, b, s) after rounds of local joins."""
    for _ in range(rounds):
        new = _local_join(graph, units, size)
        old, last = graph.select("a", "b", "s", F.lit(0).alias("fresh")), graph
        graph = written(_top(old.union(_directed(new, 1)), size), "graph")
        discard(last)
        if graph.where("fresh = 1").count() < 0.02 * n * size:
            break
    return graph


def _linked(units: DataFrame, graph: DataFrame, size: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, links counted of each node of a component counted whole, nodes of these components) of a graph of lists."""
    links = written(graph.where(F.col("s") >= threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    comps = written(components(links), "components")
    full = graph.groupBy("a").agg(F.count("*").alias("c"), F.min("s").alias("least")).where((F.col("c") >= size) & (F.col("least") >= threshold)).select(F.col("a").alias("node"))
    whole = written(comps.join(comps.join(full, "node").select("component").distinct(), "component").select("node", "component"), "whole")
    counted, more = _enlarged(units, whole, threshold)
    return links.union(more), counted, whole


def linked_vectors(units: DataFrame, threshold: float = THRESHOLD, size: int = LIST, recall: float = RECALL, rounds: int = ROUNDS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(links a, b that keep components, n_links by weight of each node) of unit vectors of one length."""
    tasks, n = task_count(units.sparkSession), units.count()
    graph, got = None, 0.0
    for growth in range(GROWTHS + 1):
        size <<= bool(growth)
        start = _directed(_scored(_start(units, tasks, seed + growth), units), 1)
        start = start if graph is None else start.union(graph.select("a", "b", "s", F.lit(1)))
        graph = refined(units, written(_top(start, size), "graph"), size, n, rounds)
        links, counted, whole = _linked(units, graph, size, threshold)
        got = _audit(units, links, whole, threshold, seed + 1000 + growth)
        if got >= recall:
            break
    else:
        if EXACT_ROWS is not None and n > EXACT_ROWS:
            raise RuntimeError(f"audited recall {got:.3f} is below {recall} with lists of {size}, and {n} vectors are too many to compare in blocks")
        counted, links = _enlarged(units, units.select("node", F.lit(0).cast("bigint").alias("component")), threshold, EXACT_BLOCK)
    listed = graph.where(F.col("s") >= threshold).select("a", "b").union(graph.where(F.col("s") >= threshold).select("b", "a")).distinct()
    listed = listed.toDF("node", "x").join(units.select(F.col("node").alias("x"), "weight"), "x").groupBy("node").agg(F.sum("weight").alias("n"))
    counts = (units.select("node", "weight").join(listed, "node", "left").join(counted, "node", "left")
              .select("node", F.coalesce("n_links", F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    return links, written(counts, "counts")


def _few_linked(units: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """As linked_vectors(), exactly, for lengths `d` that at most `FEW_ROWS` vectors have."""
    kinds = arrow_schema(units.sparkSession, "node long, n long, other array<long>")

    def block(table: pa.Table) -> pa.Table:
        node, weight, v = table.column("node").to_numpy(), table.column("weight").to_numpy(), _matrix(table.column("v").to_pylist())
        hit = v @ v.T >= threshold
        np.fill_diagonal(hit, False)
        return pa.Table.from_batches([arrow_batch([(n, c, node[h & (node > n)].tolist()) for n, c, h in zip(node.tolist(), (hit @ weight + weight - 1).tolist(), hit, strict=True)], kinds)])

    found = written(units.groupBy("d").applyInArrow(block, "node long, n long, other array<long>"), "few")
    return found.select(F.col("node").alias("a"), F.explode("other").alias("b")), found.select("node", F.col("n").alias("n_links"))


def _least(hit: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least node that each row and each column of a table of links reaches."""
    top = np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(a, np.where(hit, b[None], top).min(1))
        new_b = np.minimum(b, np.where(hit, new_a[:, None], top).min(0))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def _enlarged(units: DataFrame, comps: DataFrame, threshold: float, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """All links inside the given components (node, component): (node, n_links by weight, pivot or null) and links (a, b) that keep them connected."""
    spark = units.sparkSession
    all_ = written(units.join(comps, "node"), "members")
    half = math.sqrt((1 + threshold) / 2) + 1e-12
    pivot = all_.groupBy("component").agg(F.min_by("v", "node").alias("pv"), F.min("node").alias("pivot"))

    def inside(batches):
        for b in batches:
            s = np.einsum("ij,ij->i", _matrix(b.column("v").to_pylist()), _matrix(b.column("pv").to_pylist())) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "component", "pivot", "weight", "v")), pa.array(s >= half)], names=["node", "component", "pivot", "weight", "v", "ball"])

    all_ = written(all_.join(pivot, "component").select("node", "component", "pivot", "weight", "v", "pv").mapInArrow(inside, "node long, component long, pivot long, weight long, v binary, ball boolean"), "members")
    balls = all_.where("ball").groupBy("component").agg(F.sum("weight").alias("ball_weight"))
    from_ball = all_.where("ball").join(balls, "component").select("node", (F.col("ball_weight") - 1).alias("n"))
    # those outside the ball against all members: blocks of either side, each row of a block sent once for a block of the other
    sizes = all_.groupBy("component").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"), F.ceil(F.count_if(~F.col("ball")) / size).cast("int").alias("outs")).where("outs > 0")
    spread = all_.join(sizes, "component")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    out_part = F.pmod(F.xxhash64("node"), F.col("outs")).cast("int")
    left = spread.where("not ball").select("component", out_part.alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), "node", "weight", "v", F.lit(0).alias("side"))
    right = spread.select("component", F.explode(F.sequence(F.lit(0), F.col("outs") - 1)).alias("i"), part.alias("j"), "node", "weight", "v", F.when(F.col("ball"), 1).otherwise(2).alias("side"))
    kinds = arrow_schema(spark, "node long, n long, other long")

    def block(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        node, weight, v = table.column("node").to_numpy(), table.column("weight").to_numpy(), _matrix(table.column("v").to_pylist())
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side > 0)
        out = []
        if len(a) and len(b):
            hit = (v[a] @ v[b].T >= threshold) & (node[a][:, None] != node[b][None])
            out += [(n, c, None) for n, c in zip(node[a].tolist(), (hit @ weight[b]).tolist(), strict=True) if c]
            out += [(n, 0, o) for nodes, least in zip((node[a], node[b]), _least(hit, node[a], node[b]), strict=True) for n, o in zip(nodes.tolist(), least.tolist(), strict=True) if n != o]
            ball = side[b] == 1  # a ball member's links to those outside
            out += [(n, c, None) for n, c in zip(node[b][ball].tolist(), (hit[:, ball].T * weight[a]).sum(1).tolist(), strict=True) if c]
        return pa.Table.from_batches([arrow_batch(out, kinds)])

    found = written(left.union(right).groupBy("component", "i", "j").applyInArrow(block, "node long, n long, other long"), "blocks")
    own = all_.where("not ball").select("node", (F.col("weight") - 1).alias("n"))
    counts = from_ball.union(own).union(found.select("node", "n")).groupBy("node").agg(F.sum("n").alias("n_links"))
    links = all_.where("ball and node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).union(found.where("other is not null").select("node", "other"))
    return counts, links


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) of each row; `kept` marks the least id of a component."""
    e = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    raw = df.select(F.col(id_col).cast("bigint").alias("id"), e.alias("e"))
    fine = F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0) & F.col("id").isNotNull()
    rows = written(raw.withColumn("e", F.when(fine, F.col("e"))).withColumn("k1", F.xxhash64("e")).withColumn("k2", F.xxhash64(F.lit(1), "e")), "vectors")
    good = rows.where("e is not null")
    nodes = written(good.groupBy("k1", "k2").agg(F.min("id").alias("node"), F.count("*").alias("weight"), F.first("e").alias("e")).withColumn("d", F.size("e")), "nodes")
    units = written(_unit(nodes.select("node", "weight", "d", "e")), "units")
    lengths = nodes.groupBy("d").count()
    # the commonest length and all that are not rare; lengths in use are few as a rule
    common = lengths.orderBy(F.desc("count"), "d").limit(1).select("d")
    many = sorted({r.d for r in lengths.where(F.col("count") > FEW_ROWS).select("d").union(common).collect()})
    parts = [linked_vectors(units.where(F.col("d") == d), threshold) for d in many]
    if not lengths.where(~F.col("d").isin(many)).isEmpty():
        parts.append(_few_linked(units.where(~F.col("d").isin(many)), threshold))
    if not parts:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    links, counts = (reduce(DataFrame.unionByName, x) for x in zip(*parts, strict=True))
    counts = counts.groupBy("node").agg(F.max("n_links").alias("n_links"))  # vectors that share an id
    final = written(components(links), "components")
    keyed = nodes.select("k1", "k2", "node")
    out = rows.select("id", "k1", "k2", F.col("e").isNotNull().alias("good")).join(keyed, ["k1", "k2"], "left").join(counts, "node", "left").join(final, "node", "left")
    comp = F.coalesce("component", "node", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))
