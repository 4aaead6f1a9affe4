"""A training corpus from ``documents``: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a table that is written and read again before
the next. All but the last return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evitrace.llm import bpe, grammar, mixing, simhash, toxicity
from evitrace.llm.common import fold_of, table
from evitrace.session import cut_lineage


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the rejecting score; learned from labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, fold_of(F.col("doc_id"), 3) != 1)
    return toxicity.reject(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of linked fingerprints."""
    return simhash.dedup(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced, lengths as they are then."""
    return grammar.redact(docs).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or drawn to the sources' targets."""
    return mixing.sample(docs, mixing.quality_weights(table(spark, sf_dir, "labels")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with digests of the ids and of the decoded text."""
    coded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", toxic),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scans", secrets),
    ("mixing", mix),
    ("bpe", tokens),
]

#: Learned models and hashes that DuckDB lacks: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
