"""Sharding by global byte-size prefix sums, cut at equal targets: contiguous, balanced shards.

Documents are put in order of their id. Quantiles of the ids (one aggregate) cut the table into
blocks; each block's totals, a few rows for all input, give every block the bytes and rows before
it. Inside a block a window adds up sizes, so no task sees more than a block and no global sort is
needed. A document belongs to shard floor(shards * middle byte / total bytes): neighbours stay
together and a shard's bytes differ from the target by less than the size of its two border documents.

Defined cases: a null text has no bytes; documents with equal ids are ordered by checksum and size
(identical rows are interchangeable) and each gets a slot; null ids come first; an empty table gives
no rows; columns of the input other than id and text are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import task_count, written

OVERHEAD = 16


def shard_by_bytes(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
                   overhead: int = OVERHEAD) -> DataFrame:
    """Return (id, size, text_crc32, shard, slot) for each row of `df`."""
    if shards < 1:
        raise ValueError("shards has to be 1 at least")
    spark = df.sparkSession
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    small = df.select(F.col(id_col).alias("id"), (F.length(raw).cast("bigint") + overhead).alias("size"), F.crc32(raw).alias("crc"))
    small = written(small, "shard-sizes")
    blocks = max(2, 2 * task_count(spark))
    cuts = small.select(F.percentile_approx("id", F.array(*[F.lit(i / blocks) for i in range(1, blocks)]), 10 * blocks).alias("c"))
    cuts = sorted(set((cuts.first() or [None])[0] or []))  # at most `blocks` numbers, whatever the input
    # the number of cuts that lie below the id
    block = F.lit(0)
    if cuts:
        places = F.array(*[F.lit(c).cast("bigint") for c in cuts])
        block = F.coalesce(F.size(F.filter(places, lambda c: c < F.col("id"))), F.lit(0))
    placed = small.withColumn("block", block)
    totals = placed.groupBy("block").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    totals = totals.select("block", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.sum("b").over(whole).alias("total"))
    inside = Window.partitionBy("block").orderBy(F.col("id").asc_nulls_first(), "crc", "size")
    rows = (placed.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .withColumn("rn", F.row_number().over(inside))
            .join(F.broadcast(totals), "block"))  # a row for each block: at most 2 x the shuffle partitions
    # the middle of the document in bytes; twice it, to stay with whole numbers
    rows = rows.withColumn("shard", F.expr(f"least({shards - 1}, ((2 * (b0 + upto) - size) * {shards}) div (2 * total))").cast("int"))
    rows = rows.withColumn("at", F.col("n0") + F.col("rn") - 1)
    firsts = rows.groupBy("shard").agg(F.min("at").alias("first"))  # a row for each shard
    return (rows.join(F.broadcast(firsts), "shard")
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("at") - F.col("first")).cast("bigint").alias("slot")))


def write_shards(df: DataFrame, sharded: DataFrame, folder: str, id_col: str = "doc_id") -> None:
    """Write the rows of `df` as one Parquet folder for each shard, in slot order; ids have to be unique."""
    (df.join(sharded.select(id_col, "shard", "slot"), id_col)
     .repartition("shard", (F.col("slot") % 8)).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(folder))
