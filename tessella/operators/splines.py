"""Splines of any continuity from local fits, cubic splines from one banded system, and places where polynomials take a value.

Nodes are numbered over ranges. Local fits see a bounded number of neighbours by number, which one shuffle brings together;
their derivatives at both ends of a piece make its polynomial. The cubic spline with continuous second derivatives solves a
three-band system over all nodes: numbers are cut into blocks of BLOCK nodes, each block is eliminated by itself down to its first and
last unknown, the reduced system of two unknowns a block is solved, and the blocks substitute back.

Pieces are (low, high, c): coefficients of powers of x - low, the constant first.

Defined cases: nodes with a null are left out; nodes need distinct places; one node gives no piece; values outside the nodes take
the nearest piece; null values stay null.
"""

from __future__ import annotations

from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import kept, lists as rows_of, matrix
from .ordered import scan

#: Nodes that are solved together.
BLOCK = 65_536
PIECES = "low double, high double, c array<double>"


def _dealt(df: DataFrame, by: str) -> DataFrame:
    """Rows dealt to as many tasks as the session shuffles to: small rows that cost much are not joined into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def numbered(nodes: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(k, x, y): nodes in order, counted from 0."""
    plain = nodes.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    return scan(plain, ["x"], sums={"k": F.lit(1)}).select((F.col("k") - 1).alias("k"), "x", "y")


def neighbours(nodes: DataFrame, reach: int) -> DataFrame:
    """(k, near): each node's number with the nodes up to `reach` numbers away, in order, itself among them."""
    to = F.explode(F.sequence(F.col("k") - reach, F.col("k") + reach)).alias("at")
    lists = _dealt(nodes.select(to, F.struct("k", "x", "y").alias("n")), "at").groupBy("at").agg(F.array_sort(F.collect_list("n")).alias("near"))  # 2 * reach + 1 nodes at most
    return lists.where(F.exists("near", lambda n: n["k"] == F.col("at"))).withColumnRenamed("at", "k")


def divided(x: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Newton coefficients, places), row by row, of polynomials with the given value and derivatives (last axis) at each place."""
    n, k = values.shape[1:]
    places, whose = np.repeat(x, k, 1), np.repeat(np.arange(n), k)
    row = values[:, whose, 0]
    out = [row[:, 0]]
    for d in range(1, n * k):
        gap = places[:, d:] - places[:, :-d]
        level = gap == 0
        if d >= k and level.any():
            raise ValueError("nodes need distinct places")
        row = (row[:, 1:] - row[:, :-1]) / np.where(level, 1, gap)
        if d < k:
            row = np.where(level, values[:, whose[:-d], d] / factorial(d), row)
        out.append(row[:, 0])
    return np.stack(out, 1), places


def powers(newton: np.ndarray, places: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Coefficients of powers of x - at of polynomials in Newton's form, row by row."""
    c, none = newton[:, -1:], np.zeros((len(newton), 1))
    for j in range(newton.shape[1] - 2, -1, -1):
        c = np.hstack([none, c]) - (places[:, j] - at)[:, None] * np.hstack([c, none])
        c[:, 0] += newton[:, j]
    return c


def local_polynomials(x: np.ndarray, y: np.ndarray, i: int, order: int) -> np.ndarray:
    """Derivatives at node i of each row, of the polynomial through the `order` nodes nearest by number, then by closeness of place and value."""
    n, u = x.shape[1], x[:, i]
    by_number = np.broadcast_to(np.abs(np.arange(n) - i), x.shape)
    rank = np.lexsort((np.abs(x - u[:, None]) * np.abs(y - y[:, i:i + 1]), by_number))
    out = np.zeros((len(x), order + 1))
    far = np.abs(np.take_along_axis(x, rank, 1) - u[:, None])
    more = far[:, order] == far[:, order - 1] if n > order > 1 else np.zeros(len(x), bool)  # the next one is just as near
    for rows, size in ((np.flatnonzero(~more), min(n, order)), (np.flatnonzero(more), order + 1)):
        if len(rows):
            use = np.sort(rank[rows, :size], 1)
            c = powers(*divided(np.take_along_axis(x[rows], use, 1), np.take_along_axis(y[rows], use, 1)[:, :, None]), u[rows])
            out[rows, :size] = c * np.array([factorial(d) for d in range(size)])
    return out


def local_quadratics(x: np.ndarray, y: np.ndarray, i: int) -> np.ndarray:
    """Derivatives at node i of each row, of a parabola through it: mean slopes on both sides, then the squares weighted by inverse squared distance."""
    n = x.shape[1]
    if n < 2:
        return np.hstack([y, np.zeros((len(y), 2))])
    other = np.arange(n) != i
    sx, sy = x[:, other] - x[:, i:i + 1], y[:, other] - y[:, i:i + 1]
    away = np.abs(sx)
    slope = sy / away
    left, right = slope[:, :i].mean(1) if i else None, slope[:, i:].mean(1) if i < n - 1 else None
    b = -left if right is None else right if left is None else (right - left) / 2
    a = ((slope - np.sign(sx) * b[:, None]) * away).sum(1) / (away * away).sum(1)
    return np.stack([y[:, i], b, 2 * a], 1)


def local_facets(x: np.ndarray, y: np.ndarray, i: int, size: int = 3) -> np.ndarray:
    """Slope at node i of each row, of the line through `size` neighbours in a row that comes nearest to the node."""
    n = x.shape[1]
    size = min(max(3, 2 * (size // 2) + 1), n)
    half, offs, slopes = size // 2, [], []
    for centre in range(max(0, i - half), min(n, i + half + 1)):
        low, high = max(0, centre - half), min(n, centre + half + 1)
        if high - low < size:
            continue
        u, v = x[:, low:high], y[:, low:high]
        um, vm = u.mean(1), v.mean(1)
        du = u - um[:, None]
        s = (du * (v - vm[:, None])).sum(1) / (du * du).sum(1)
        offs.append(np.abs(vm + s * (x[:, i] - um) - y[:, i])), slopes.append(s)
    if not offs:
        return np.stack([y[:, i], np.zeros(len(y))], 1)
    best = np.stack(offs, 1).argmin(1)
    return np.stack([y[:, i], np.stack(slopes, 1)[np.arange(len(y)), best]], 1)


def local_polynomial(x: np.ndarray, y: np.ndarray, i: int, order: int) -> np.ndarray:
    return local_polynomials(x[None], y[None], i, order)[0]


def local_quadratic(x: np.ndarray, y: np.ndarray, i: int) -> np.ndarray:
    return local_quadratics(x[None], y[None], i)[0]


def local_facet(x: np.ndarray, y: np.ndarray, i: int, size: int = 3) -> np.ndarray:
    return local_facets(x[None], y[None], i, size)[0]


def fit(nodes: DataFrame, continuity: int = 1, local: str = "polynomial", reach: int | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """Pieces of a spline through all nodes with `continuity` continuous derivatives, taken from local fits.

    `local` is polynomial, quadratic (two derivatives at most) or facet (one); higher derivatives of those are zero. `reach` is how
    many neighbours on each side a quadratic sees.
    """
    if local not in ("polynomial", "quadratic", "facet"):
        raise ValueError(f"no such local fit: {local}")
    reach = reach or {"polynomial": continuity + 1, "quadratic": 8, "facet": 2}[local]
    near = neighbours(numbered(nodes, x, y), reach)

    def derive(batches):
        for b in batches:
            k, lists = b.column("k").to_numpy(), b.column("near")
            start = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            number, u, v = (flat.field(i).to_numpy() for i in range(3))
            long = np.diff(start)
            at = np.flatnonzero(number == np.repeat(k, long)) - start[:-1]
            x, d = np.zeros(len(k)), np.zeros((len(k), continuity + 1))
            for n, i in {*zip(long.tolist(), at.tolist(), strict=True)}:  # only nodes near the ends have other lists than the rest
                rows = np.flatnonzero((long == n) & (at == i))
                cells = start[rows, None] + np.arange(n)
                near_x, near_y = u[cells], v[cells]
                got = local_polynomials(near_x, near_y, i, continuity + 1) if local == "polynomial" else local_quadratics(near_x, near_y, i) if local == "quadratic" else local_facets(near_x, near_y, i)
                size = min(continuity + 1, got.shape[1])
                d[rows, :size] = got[:, :size]
                d[rows, 0], x[rows] = near_y[:, i], near_x[:, i]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(x), rows_of(d)], names=["k", "x", "d"])

    known = near.mapInArrow(derive, "k long, x double, d array<double>")
    ends = known.select(F.explode(F.array("k", F.col("k") - 1)).alias("piece"), F.struct("k", "x", "d").alias("n"))
    ends = _dealt(ends, "piece").groupBy("piece").agg(F.min("n").alias("a"), F.max("n").alias("b")).where("a.k < b.k")

    def join(batches):
        for b in batches:
            low, high = b.column("a").field("x").to_numpy(), b.column("b").field("x").to_numpy()
            d = np.stack([matrix(b.column(c).field("d")) for c in ("a", "b")], 1) if b.num_rows else np.zeros((0, 2, continuity + 1))
            c = powers(*divided(np.stack([low, high], 1), d), low)
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), rows_of(c)], names=["low", "high", "c"])

    return ends.mapInArrow(join, PIECES)


def three_bands(a: np.ndarray, b: np.ndarray, c: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solve a[i] u[i-1] + b[i] u[i] + c[i] u[i+1] = right[i] for several right sides (columns)."""
    n = len(b)
    b, right = b.copy(), right.copy()
    for i in range(1, n):
        w = a[i] / b[i - 1]
        b[i] -= w * c[i - 1]
        right[i] -= w * right[i - 1]
    right[n - 1] /= b[n - 1]
    for i in range(n - 2, -1, -1):
        right[i] = (right[i] - c[i] * right[i + 1]) / b[i]
    return right


def _bands(x: np.ndarray, y: np.ndarray):
    """Rows of the system for second derivatives at all of these nodes but the first and the last."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    a, c = h[:-1] / (h[:-1] + h[1:]), h[1:] / (h[:-1] + h[1:])
    return a, np.full(len(a), 2.0), c, 6 * (d[1:] - d[:-1]) / (h[:-1] + h[1:])


def cubic(nodes: DataFrame, x: str = "x", y: str = "y", block: int = BLOCK) -> DataFrame:
    """Pieces of the natural cubic spline: value, slope and second derivative are continuous, the latter zero at both ends."""
    table = kept(numbered(nodes, x, y), "nodes")
    last = table.agg(F.max("k")).first()[0]
    if last is None or last < 1:
        return table.sparkSession.createDataFrame([], PIECES)
    inner = last - 1  # unknowns belong to nodes 1 .. last - 1
    blocks = -(-inner // block)
    if not inner:
        ends = table.groupBy().agg(F.min(F.struct("x", "y")).alias("a"), F.max(F.struct("x", "y")).alias("b"))
        return ends.select(F.col("a.x").alias("low"), F.col("b.x").alias("high"), F.array(F.col("a.y"), (F.col("b.y") - F.col("a.y")) / (F.col("b.x") - F.col("a.x"))).alias("c"))
    # a block of unknowns needs the nodes on both sides of it
    own = lambda n: F.floor((F.greatest(F.lit(1), F.least(n, F.lit(inner))) - 1) / block).cast("int")
    k = F.col("k")
    dealt = table.select(F.explode(F.array_distinct(F.array(own(k - 1), own(k), own(k + 1)))).alias("b"), "k", "x", "y")

    def parts(t: pa.Table):
        order = np.argsort(t.column("k").to_numpy())
        u, v = (t.column(c).to_numpy()[order] for c in ("x", "y"))
        a, b, c, r = _bands(u, v)
        right = np.zeros((len(b), 3))
        right[:, 0], right[0, 1], right[-1, 2] = r, -a[0], -c[-1]
        return u, v, three_bands(a, b, c, right)

    def eliminate(t: pa.Table) -> pa.Table:
        """The block's first and last unknown as sums of a constant and its two neighbours."""
        s = parts(t)[2]
        return pa.table({"b": pa.array([t.column("b")[0].as_py()], pa.int32()), "first": [s[0].tolist()], "last": [s[-1].tolist()]})

    reduced = sorted(dealt.groupBy("b").applyInArrow(eliminate, "b int, first array<double>, last array<double>").collect())  # a row a block
    value = _reduced(reduced)
    sides = {b: (value[2 * b - 1] if b else 0.0, value[2 * b + 2] if b + 1 < blocks else 0.0) for b in range(blocks)}
    sent = table.sparkSession.sparkContext.broadcast(sides)  # two numbers a block

    def finish(t: pa.Table) -> pa.Table:
        u, v, s = parts(t)
        b = t.column("b")[0].as_py()
        left, right = sent.value[b]
        m = np.concatenate([[left], s[:, 0] + s[:, 1] * left + s[:, 2] * right, [right]])
        h, rise = np.diff(u), np.diff(v) / np.diff(u)
        c = np.stack([v[:-1], rise - h * (2 * m[:-1] + m[1:]) / 6, m[:-1] / 2, (m[1:] - m[:-1]) / (6 * h)], 1)
        # a piece at the border of two blocks comes from the first of them
        mine = np.arange(len(h)) >= (1 if b else 0)
        return pa.table({"low": u[:-1][mine], "high": u[1:][mine], "c": pa.array(list(c[mine]), pa.list_(pa.float64()))})

    return dealt.groupBy("b").applyInArrow(finish, PIECES)


def _reduced(rows: list) -> np.ndarray:
    """First and last unknowns of all blocks, by elimination from the first block to the last and back."""
    n = len(rows)
    value = np.zeros(2 * n)
    # l of each block as e + g * f of the next block
    e, g = np.zeros(n), np.zeros(n)
    f0, f1 = np.zeros(n), np.zeros(n)
    for b, r in enumerate(rows):
        (p, q, s), (p2, q2, s2) = r.first, r.last
        before_e, before_g = (e[b - 1], g[b - 1]) if b else (0.0, 0.0)
        # f = p + q (before_e + before_g f) + s next, l = p2 + q2 (before_e + before_g f) + s2 next
        down = 1 - q * before_g
        f0[b], f1[b] = (p + q * before_e) / down, s / down
        e[b] = p2 + q2 * before_e + q2 * before_g * f0[b]
        g[b] = s2 + q2 * before_g * f1[b]
    following = 0.0
    for b in range(n - 1, -1, -1):
        value[2 * b + 1] = e[b] + g[b] * following
        value[2 * b] = following = f0[b] + f1[b] * following
    return value


def evaluate(at: DataFrame, pieces: DataFrame, column: str, name: str = "value", derivative: int = 0) -> DataFrame:
    """Add the spline's value, or a derivative of it, at a column."""
    p = pieces.select(F.col("low").alias("_x"), F.lit(0).alias("_k"), F.struct("low", "c").alias("_p"))
    q = at.select(F.col(column).cast("double").alias("_x")).distinct().where("_x is not null").select("_x", F.lit(1).alias("_k"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"))
    got = scan(p.unionByName(q), ["_x", "_k"], lasts={"_a": F.col("_p")}, nexts={"_b": F.col("_p")}).where("_k = 1").withColumn("_u", F.coalesce("_a", "_b"))
    t, c = F.col("_x") - F.col("_u.low"), F.col("_u.c")
    for _ in range(derivative):
        c = F.slice(F.transform(c, lambda v, i: v * i), 2, 1_000_000)
    done = got.select("_x", F.aggregate(F.reverse(c), F.lit(0.0), lambda s, v: s * t + v).alias(name))
    return at.join(done, at[column].cast("double").eqNullSafe(done["_x"]), "left").drop("_x")


def roots(c: np.ndarray, low: float, high: float) -> list[float]:
    """Places in [low, high] where a polynomial is zero: between places where its derivative is, one at most, by halving."""
    c = np.trim_zeros(np.asarray(c, float), "b")
    if len(c) < 2:
        return []
    f = lambda t: float(np.polyval(c[::-1], t))
    turns = roots(c[1:] * np.arange(1, len(c)), low, high)
    marks, found = [low, *turns, high], []
    size = float(np.abs(c) @ np.maximum(1, max(abs(low), abs(high))) ** np.arange(len(c))) * 1e-15
    for a, b in zip(marks, marks[1:], strict=False):
        fa, fb = f(a), f(b)
        if abs(fa) <= size:
            found.append(a)
        elif fa * fb < 0 and abs(fb) > size:
            for _ in range(200):
                m = (a + b) / 2
                if m in (a, b):
                    break
                fm = f(m)
                a, b, fa = (m, b, fm) if fa * fm > 0 else (a, m, fa)
            found.append((a + b) / 2)
    if abs(f(high)) <= size:
        found.append(high)
    return sorted(set(found))


def crossings(at: DataFrame, pieces: DataFrame, key: str, value: str) -> DataFrame:
    """(key, x): all places where the spline takes each row's value; values and pieces meet by the ranges that pieces cover.

    Bounds of a piece are found from its turning points; a stretch that is level at the value counts with its ends.
    """
    def bounds(batches):
        for b in batches:
            low, high = [], []
            for a, e, c in zip(b.column("low").to_pylist(), b.column("high").to_pylist(), b.column("c").to_pylist(), strict=True):
                c = np.array(c)
                turns = [0.0, *roots(c[1:] * np.arange(1, len(c)), 0.0, e - a), e - a]
                seen = [float(np.polyval(c[::-1], t)) for t in turns]
                low.append(min(seen)), high.append(max(seen))
            yield b.append_column("least", pa.array(low, pa.float64())).append_column("most", pa.array(high, pa.float64()))

    from .intervals import covering

    ranged = pieces.mapInArrow(bounds, f"{PIECES}, least double, most double")
    both = covering(at.select(F.col(key).alias("key"), F.col(value).cast("double").alias("at")).where("at is not null"), ranged, "at", "least", "most")

    def solve(batches):
        for b in batches:
            out = []
            for k, v, a, e, c in zip(*(b.column(n).to_pylist() for n in ("key", "at", "low", "high", "c")), strict=True):
                out += [(k, a + r) for r in roots(np.array([c[0] - v, *c[1:]]), 0.0, e - a)]
            cols = list(zip(*out, strict=True)) if out else [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("key").type), pa.array(cols[1], pa.float64())], names=["key", "x"])

    kind = at.schema[key].dataType.simpleString()
    found = both.select("key", "at", "low", "high", "c").mapInArrow(solve, f"key {kind}, x double")
    return found.groupBy("key", "x").agg(F.lit(1)).select(F.col("key").alias(key), "x")
