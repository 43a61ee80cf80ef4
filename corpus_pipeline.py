"""The corpus pipeline: stages that each read what the one before kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run` writes each
result as Parquet to the shared scratch folder and hands the file to the next stage.  All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tributary.llm import decontamination, mixing, sharding, simhash, toxicity
from tributary.llm.common import prepare, stored, table
from tributary.session import apply_settings


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go."""
    return toxicity.drop_toxic(docs, table(ready(spark), sf_dir, "labels"), threshold=0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    ready(spark)
    return simhash.drop_near_duplicates(docs, words=3, max_bits=3)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, table(ready(spark), sf_dir, "benchmark"), similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; those of small sources repeat up to twice."""
    ready(spark)
    mixture = mixing.plan(docs, entropy=0.98, repetition=2.0)
    return mixing.mixed(docs, mixture).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row that is left."""
    ready(spark)
    return sharding.shard_law(docs, shards=40)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL can express neither the fingerprints nor the fitted scores; tests use brute force.
ORACLE_SQL = None


def ready(spark: SparkSession) -> SparkSession:
    return prepare(apply_settings(spark))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
