"""The training-data pipeline over ``documents``: each stage works on all that the one before it kept.

Rows are told apart by ``doc_id``, which is unique in ``documents``. Extra columns of the input pass through all stages; an
empty table gives an empty result with the last stage's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweave.llm import leaks, mixing, pii, quality, simhash
from docweave.llm.scratch import materialise

#: target shares of tokens; junk has gone by then
TARGETS = {"good": 0.95, "toxic": 0.05, "junk": 0.0}


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.with_rates(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TARGETS)


STAGES = [
    ("quality", drop_low_quality),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("mixing", mix_to_targets),
]

#: classifiers, fingerprints and latent retrieval are not expressible in SQL; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
