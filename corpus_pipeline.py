"""A corpus pipeline: language, near duplicates, benchmark leaks, source mix, shards.

Each stage takes ``(spark, docs, sf_dir)`` and is written as Parquet to the shared folder before the next one reads
it. All but the last return the columns of documents; a stage copes with empty input, nulls
and repeated rows as its operator does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from linetrawl.llm import decontaminate as leaks, langid, mixing, neardup, sharding
from linetrawl.llm.common import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; out go those without letters or mostly unlike any language."""
    found = langid.identify(docs, langid.train(docs))
    return found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("known") >= 0.5)).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the least id."""
    return neardup.keep_one(docs, neardup.near_duplicates(docs, keys=True)).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return leaks.find_leaks(docs, table(spark, sf_dir, "benchmark")).filter(F.size("leaks") == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them; a take of less than half a document is none."""
    return mixing.schedule(mixing.place(docs)).filter(F.col("take.words") * 2 >= F.col("size")).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its place in it."""
    return sharding.shard(docs).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [("language", language), ("deduplicate", deduplicate), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]
#: Trigram mixtures, MinHash and medians of a k-d tree are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
