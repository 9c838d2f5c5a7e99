"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Every stage takes rows with null ids or texts, empty and very long texts,
repeated rows, further columns and empty tables: texts under 50 words, null and
empty ones with them, fail the quality rules; of rows with equal words one stays;
further columns pass unchanged (the last stage replaces columns named size,
text_crc32, shard or slot); an empty table gives an empty result.

A stage begins when the stage before is written, so it deletes the tables that
the one before needed in between; run one pipeline at a time in an application.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm.common import application_folder, table, tables_apart
from loomspark.llm.contamination import decontaminated
from loomspark.llm.mixing import mixed_rows
from loomspark.llm.quality import good
from loomspark.llm.sharding import shard
from loomspark.llm.simhash import deduplicated


def _stage(f: Callable) -> Callable:
    @wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with tables_apart(spark, "stage"):
            return f(spark, docs, sf_dir)

    return stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return good(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return deduplicated(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document comes as often as the mix takes it: not at all, once or twice."""
    return mixed_rows(docs)


@_stage
def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of the mix, with all its columns, and its size, checksum, shard and slot."""
    return shard(docs, whole=True).drop("curve")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

#: SQL can't express suffix arrays with their thresholds, fingerprint groups and the knapsack; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{application_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
