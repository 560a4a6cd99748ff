"""The queries op1 .. op13: operators of this subpackage over the whole of their tables."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, decontam, html_extract, infill, jaccard, nn_descent, passages, pii, records, shards, sql, suffixes, toxicity, valid_time
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]
SHARDS = 40


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digests(coder, ids, decoded):
        return len(ids), _hex(coder.decimals(ids)), _hex(decoded)

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return bpe.encode_decode(read_table(spark, sf_dir, "documents"), vocabulary(), digests, added, keep=["doc_id"])


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract(read_table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return pages.withColumn("n_chars", F.length("text").cast("bigint"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with a passage of 50 words or more that repeats in another one; others have no row."""
    return passages.repeated_passages(read_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.fit(docs))


def op6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    def crc(ids):
        return (zlib.crc32(ids.astype("<u4").tobytes()),)

    files = records.write_records(read_table(spark, sf_dir, "documents"), vocabulary())
    return records.read_records(spark, files, crc, "ids_crc32 long")


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = shards.shard_by_bytes(read_table(spark, sf_dir, "documents"), SHARDS)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), allowed=toxicity.may_train(F.col("doc_id")))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (~toxicity.may_train(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that a benchmark item leaks into; documents without a leak have no row."""
    return decontam.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_valid_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = valid_time.enrich(read_table(spark, sf_dir, "sales"), read_table(spark, sf_dir, "client_changes"))
    return done.select("rec", "id", "batch", "n_held", "change_id", F.floor(F.col("balance") * 100 + 0.5).alias("balance_cents"), "op")


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = infill.fill_in_middle(read_table(spark, sf_dir, "documents"))
    again = infill.restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixes.remove_repeats(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Query]:
    return {"op1_bpe": op1_bpe, "op2_html": op2_html, "op3_jaccard": op3_jaccard, "op4_passages": op4_passages, "op5_pii": op5_pii, "op6_records": op6_records, "op7_neardup": op7_neardup, "op8_shards": op8_shards, "op9_toxicity": op9_toxicity, "op10_decontam": op10_decontam,
            "op11_valid_time": op11_valid_time, "op12_infill": op12_infill, "op13_suffixes": op13_suffixes}


def oracle_sql() -> dict[str, str]:
    return sql.ORACLES
