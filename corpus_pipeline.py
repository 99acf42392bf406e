"""The corpus pipeline: five stages from documents to shards, each on all rows that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in
the shared folder and reads it again as the next one's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, langid, mixing, sharding, simhash
from tidemark.llm.registry import MIX_WEIGHTS
from tidemark.llm.shared import dropped, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones have taught.

    Those without a letter go, and those most of whose letters are in a script or language that was never
    taught. Null and empty texts go; repeated rows share a verdict; an empty table stays empty.
    """
    return langid.in_known_language(docs, langid.trained(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by doc_id, of each group that a similarity of 0.8 or more in shingles of five words links.

    Texts without words are one group; rows equal in doc_id and text are one document; a null doc_id is last.
    """
    return simhash.one_of_each(docs, shingle=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none. Repeated rows stay repeated."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; equal doc_ids share a decision, a null source is one like others, and documents without words go by rate too."""
    return mixing.mix(docs, MIX_WEIGHTS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, shard and slot of each document in the mix, with its size and checksum; equal texts share a shard."""
    return sharding.shard(docs, 8).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]
#: Language identification, near-dedup and decontamination can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            dropped(before)
    result = STAGES[-1][1](spark, docs, sf_dir)
    dropped(docs)  # the shards read tables of their own
    return result
