"""A corpus from raw documents: quality rules, near duplicates, decontamination, mixing, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chromill.llm import decontam, mixing, near_dedup, quality_rules, sharding
from chromill.llm.common import release, remove, scratch

SHARDS = 16


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or that lines frequent in their source leave depleted, go; the others lose these lines."""
    return quality_rules.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8, the document with the smallest id stays."""
    return near_dedup.dedup(docs, k=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or 13 tokens in a row of one, go; so do re-parameterised ones."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, so rows repeat or go."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in shards of near equal bytes: docs' columns, size, shard and slot."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("quality rules", reject_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Neither links over shingle sets nor templates have a form in SQL that whole tables bear; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table.

    Each stage's rows are written to the shared checkpoint folder and read as the next one's documents, so no
    scan repeats an earlier stage; a folder goes once the next is written. The last one stays, as the result reads it.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = scratch(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        release(spark)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
