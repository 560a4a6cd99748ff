"""The corpus pipeline: five stages of the training-data operators, each over all that the one before kept.

Stages take (spark, docs, sf_dir); all but the last return the columns of documents. Toxic documents
go, one document of each near-duplicate group stays, documents with a leaked benchmark item go,
personal data are replaced in the texts, and the texts become token ids.

Defined cases: null and empty texts pass every stage (they score as clean, resemble nothing, hold no item) and have no token ids;
rows with equal ids and texts stay or go together, except that one of two equal texts with different ids is enough for the
Jaccard stage, which keeps the least id; a null id is kept; very long texts are taken whole; empty tables give
an empty result; other columns pass through the stages, whatever their names, up to the last one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessella.llm import bpe, decontam, jaccard, pii, toxicity
from tessella.llm.common import read_table, written
from tessella.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_leaking(docs, read_table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.fit(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the digest of the decoded text."""
    def finish(coder, ids, decoded):
        return len(ids), ids, hashlib.sha256(decoded.encode("utf-8")).hexdigest()

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType())]
    return bpe.encode_decode(docs, vocabulary(), finish, added, keep=["doc_id", "lang", "source"], limits=REMEMBERED)


#: Chunks and words that a worker of the last stage remembers: its memory comes on top of what the stages before have left.
REMEMBERED = (30_000, 20_000)

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", redact_personal_data),
    ("bpe", tokenize),
]

#: The trees, the field and the vocabulary are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, f"stage-{name}")
    return docs
