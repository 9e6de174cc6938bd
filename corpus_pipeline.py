"""The training-data pipeline over ``documents``, built of operators of ``parcelspark.llm``.

Each stage takes what its predecessor kept.  All but the last return the
columns of ``documents``; the last returns each document's tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelspark.llm import decontam, minhash, quality, rank_bpe, secrets
from parcelspark.llm.common import mark, release, shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go (operator 1)."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (operator 7, five words, 0.8)."""
    return minhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row with a benchmark item go (operator 3)."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in place; the document stays (operator 8)."""
    return secrets.masked(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text (operator 9)."""
    return rank_bpe.round_trip(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mask_secrets", mask_secrets),
    ("encode", encode),
]

#: SQL cannot express the boosted trees, so the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again.

    Once a stage is written, what its operators had written on the way is deleted,
    and so is its input, the rows of the stage before.
    """
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        rows = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/{name}"
        rows.write.parquet(path)
        release(spark, since, keep=1)
        docs = spark.read.parquet(path)
    return docs
