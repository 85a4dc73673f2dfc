"""The corpus pipeline: recognised languages, one of each near-duplicate group, no benchmark leaks, mixed sources, shards.

Each stage reads the documents that the stage before kept, from a written
table, and returns the columns of ``documents``; the last adds the shard.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrybook.llm import decontamination, language, mixing, near_dedup, sharding
from quarrybook.plans.staging import Staging


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; null texts and texts without a letter go."""
    return language.with_language(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least doc_id."""
    return near_dedup.one_of_each_group(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard, 0 to 23."""
    return sharding.shard_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", recognised),
    ("near_dedup", distinct),
    ("decontamination", uncontaminated),
    ("source_mix", mixed),
    ("sharding", sharded),
]

#: Near-duplicate groups, trained languages and the rounding have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    staging = Staging(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = staging.table(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
