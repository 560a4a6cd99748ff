"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


#: Any number: x -> x ^ MARK is one to one.
MARK = 0x5DEECE66D


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least v of each u. Grouped by another number for u, so that the result is not dealt by u and a join has to deal it."""
    mark = F.lit(MARK).cast("bigint")
    return edges.groupBy(F.col("u").bitwiseXOR(mark).alias("h")).agg(F.min("v").alias("m")).select(F.col("h").bitwiseXOR(mark).alias("u"), "m")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Each step is two aggregates and two joins over the edges, whose number never grows beyond that of
    the input plus the nodes; steps grow with the logarithm of the components' size. Each step's
    edges are written to the shared folder, so lineage stays short. Nothing comes to the driver but
    two numbers a step. A node with very many edges: its minimum combines before the shuffle, and the
    join of edges and minima has an exchange of its own on either side (`_least`), so that adaptive
    execution may split the node's edges over tasks.

    Defined cases: an edge of a node with itself and repeated edges count for nothing; edges with a
    null end are left out; no edges give no rows.
    """
    spark = edges.sparkSession
    cur = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    seen = None
    while True:
        # large star: every larger neighbour of a node goes to the least of the neighbourhood
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        least = _least(large)
        joined = large.join(least, "u")
        last = cur
        cur = written(joined.select("u", F.col("m").alias("v")).unionByName(joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        discard(last)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    own = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return own.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
