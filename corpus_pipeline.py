"""From raw documents to sharded training data, in five stages.

Each stage is (name, function of (spark, docs, sf_dir)); what it returns is written
as Parquet and read again as the next one's documents. Stages keep null and empty texts, repeated rows and columns of any
name as their operators say; of an empty table they make an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import decontaminate, toxicity
from marlstone.llm.common import Scratch
from marlstone.llm.mixing import mix
from marlstone.llm.near_dedup import one_of_each
from marlstone.llm.queries import CATEGORIES, category_labels, table
from marlstone.llm.sharding import sharded


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain doesn't reject; null texts count as empty, and stay if the chain says so."""
    return toxicity.clean_documents(docs, category_labels(table(spark, sf_dir, "labels")), CATEGORIES)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; all null texts and texts without words."""
    return one_of_each(docs, width=5)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; null texts contain none."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; sources without words aren't taken."""
    return mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents with their shard and their slot in it; a document that the mix repeats has a row for each copy."""
    return sharded(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontaminate", drop_benchmark_leaks), ("mix", mix_sources), ("shard", shard)]

#: A trained model, MinHash candidates and the ring's hash have no SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's result written and read again; what an earlier stage kept is let go once the next is written."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, last = scratch.keep(stage(spark, docs, sf_dir)), before
        if last is not None:
            scratch.drop(last)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
