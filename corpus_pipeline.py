"""A training corpus from raw documents: quality, near copies, benchmark leaks, mix, shards.

Each stage gives the defined cases of the operator that it calls. In short: a null or empty
text breaks the quality rules and goes there; repeated rows are one group of near copies, so
one of them stays; null sources are a source of their own; other columns, whatever their
names, are carried; an empty table gives an empty table of the same columns at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomtext.llm import decontaminate, fertility, mixing, near_dups, sharding
from fathomtext.llm._spark import keep


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their script's fertility bands."""
    return fertility.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, Jaccard 0.8 or more)."""
    return near_dups.keep_one(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No contaminated documents; lesser benchmark spans are cut out of the others."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix, each as often as it is taken."""
    return mixing.mixed_rows(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their columns, and size, text_crc32, law, shard, slot, grown_shard beside them."""
    return sharding.sharded_rows(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]

ORACLE_SQL = None  # signatures and vocabularies aren't within SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
