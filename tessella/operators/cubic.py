"""Monotone cubic curves through nodes in order: built, evaluated, differentiated and inverted as plans.

Slopes at inner nodes are weighted harmonic means of the slopes on both sides, zero where those differ in sign or one is
zero; end slopes come from three nodes, limited so that the curve keeps its direction (Fritsch and Carlson, Fritsch
and Butland). The curve passes through all nodes and rises where they rise. Nodes are numbered over ranges, and one
shuffle brings the four nodes of a piece together; values find their piece by an ordered scan.

Defined cases: nodes with a null are left out; nodes need distinct places; one node gives no piece and null values;
null values stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import scan

#: Halvings of the inverse: as many as a double has digits.
HALVINGS = 52


def pieces(nodes: DataFrame, x: str = "x", y: str = "p") -> DataFrame:
    """(low, high, y0, y1, m0, m1): ends, values and slopes of the pieces between nodes."""
    plain = nodes.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    numbered = scan(plain, ["x"], sums={"k": F.lit(1)})
    # piece k lies between nodes k and k + 1, and its slopes take a node more on each side
    roles = F.explode(F.array(*[F.struct((F.col("k") + 1 - r).alias("piece"), F.lit(r).alias("role")) for r in range(4)]))
    near = numbered.select("x", "y", roles.alias("at")).groupBy("at.piece").agg(*[F.max(F.when(F.col("at.role") == r, F.struct("x", "y"))).alias(f"n{r}") for r in range(4)])
    near = near.where("n1 is not null and n2 is not null")
    gap = lambda a, b: F.col(f"n{b}.x") - F.col(f"n{a}.x")
    rise = lambda a, b: (F.col(f"n{b}.y") - F.col(f"n{a}.y")) / gap(a, b)
    h, d = gap(1, 2), rise(1, 2)

    def inner(h0: Column, d0: Column, h1: Column, d1: Column) -> Column:
        w0, w1 = 2 * h1 + h0, h1 + 2 * h0
        return F.when(d0 * d1 <= 0, 0.0).otherwise((w0 + w1) / (w0 / F.nullif(d0, F.lit(0.0)) + w1 / F.nullif(d1, F.lit(0.0))))

    def end(h0: Column, d0: Column, h1: Column, d1: Column) -> Column:
        m = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        return F.when(F.signum(m) != F.signum(d0), 0.0).when((F.signum(d0) != F.signum(d1)) & (F.abs(m) > 3 * F.abs(d0)), 3 * d0).otherwise(m)

    before, after = F.col("n0").isNotNull(), F.col("n3").isNotNull()
    m0 = F.when(before, inner(gap(0, 1), rise(0, 1), h, d)).when(after, end(h, d, gap(2, 3), rise(2, 3))).otherwise(d)
    m1 = F.when(after, inner(h, d, gap(2, 3), rise(2, 3))).when(before, end(h, d, gap(0, 1), rise(0, 1))).otherwise(d)
    return near.select(F.col("n1.x").alias("low"), F.col("n2.x").alias("high"), F.col("n1.y").alias("y0"), F.col("n2.y").alias("y1"), m0.alias("m0"), m1.alias("m1"))


def value_at(p: Column, t: Column) -> Column:
    """The value of a piece at a share t of its width."""
    h = p["high"] - p["low"]
    s = 1 - t
    return p["y0"] * (1 + 2 * t) * s * s + p["m0"] * h * t * s * s + p["y1"] * t * t * (3 - 2 * t) - p["m1"] * h * t * t * s


def slope_at(p: Column, t: Column) -> Column:
    h = p["high"] - p["low"]
    return 6 * t * (1 - t) * (p["y1"] - p["y0"]) / h + p["m0"] * (1 - t) * (1 - 3 * t) - p["m1"] * t * (2 - 3 * t)


def _with_piece(at: DataFrame, found: DataFrame, column: str, start: str, before: bool = False) -> DataFrame:
    """(_v, _p): the distinct values with the last piece that starts at or before them, or only before them."""
    piece = F.struct(*found.columns)
    starts = found.select(F.col(start).alias("_v"), F.lit(2 if before else 0).alias("_k"), piece.alias("_piece"))
    values = at.select(F.col(column).cast("double").alias("_v")).distinct().where("_v is not null").select("_v", F.lit(1).alias("_k"), F.lit(None).cast(starts.schema["_piece"].dataType).alias("_piece"))
    return scan(starts.unionByName(values), ["_v", "_k"], lasts={"_p": F.col("_piece")}).where("_k = 1").select("_v", "_p")


def _joined(at: DataFrame, done: DataFrame, column: str, name: str) -> DataFrame:
    return at.join(done, at[column].cast("double").eqNullSafe(done["_v"]), "left").select(*at.columns, F.col("_y").alias(name))


def evaluate(at: DataFrame, found: DataFrame, column: str, name: str = "value", slope: bool = False, below: float | None = 0.0, above: float | None = 1.0) -> DataFrame:
    """Add the curve's value (or slope) at a column; outside the nodes `below` and `above`, slopes are 0 there."""
    p = F.col("_p")
    t = (F.col("_v") - p["low"]) / (p["high"] - p["low"])
    low, high = (F.lit(0.0), F.lit(0.0)) if slope else (F.lit(below), F.lit(above))
    y = F.when(p.isNull(), low).when(F.col("_v") > p["high"], high).otherwise(slope_at(p, t) if slope else value_at(p, t))
    return _joined(at, _with_piece(at, found, column, "low").select("_v", y.alias("_y")), column, name)


def invert(at: DataFrame, found: DataFrame, column: str, name: str = "x") -> DataFrame:
    """Add the place where a rising curve has a column's value, by halving inside the piece; null outside its range.

    Of a stretch where the curve is level the first place counts.
    """
    # a value at which two pieces meet belongs to the first of them, and the least value to the first piece
    least = F.broadcast(found.where("y1 > y0").agg(F.min("y0").alias("_least")))  # one row
    rising = found.where("y1 > y0").join(least, F.lit(True)).withColumn("_from", F.when(F.col("y0") == F.col("_least"), float("-inf")).otherwise(F.col("y0"))).drop("_least")
    p, v = F.col("_p"), F.col("_v")
    steps = F.transform(F.sequence(F.lit(1), F.lit(HALVINGS)), lambda i: F.pow(F.lit(0.5), i))
    t = F.aggregate(steps, F.lit(0.0), lambda t, s: F.when(value_at(p, t + s) <= v, t + s).otherwise(t))
    # the last halving brings t to within 2**-52 of the width below the place
    x = F.when(p.isNull() | (v < p["y0"]) | (v > p["y1"]), None).when(v == p["y0"], p["low"]).when(v == p["y1"], p["high"]).otherwise(p["low"] + (t + F.pow(F.lit(0.5), F.lit(HALVINGS + 1))) * (p["high"] - p["low"]))
    return _joined(at, _with_piece(at, rising, column, "_from", True).select("_v", x.alias("_y")), column, name)
