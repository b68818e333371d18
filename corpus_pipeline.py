"""The corpus pipeline: five stages, each over all that its predecessor kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  A caller may write each result as
Parquet and pass what it reads back to the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import decontam, langid, minhash, mixing, sharding
from tracewell.llm.store import stored

#: Share of a text's words, in bytes, that learned languages must explain.
LANGUAGE_SHARE = 0.35
SHARDS = 40


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of which learned languages explain less than the least share, go.  The model learns from the stage's own input."""
    return langid.in_a_language(docs, langid.fit_languages(docs), LANGUAGE_SHARE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity of 0.8 or more."""
    return minhash.drop_near_duplicates(docs, shingle=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with an item of the benchmark go."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them; those that it doesn't take go."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard and place in it."""
    return sharding.shard_records(docs, SHARDS)


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Sketches, language models and checksums aren't expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again, so none is computed twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
