"""The registered queries of this subpackage; each reads its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from docweave.llm import ann, hmm, html, leaks, mixing, oracles, passages, pii, quality, rollup, scratch, simhash


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"))


def op4_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove(_read(spark, sf_dir, "documents")).drop("kept")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op8_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.place(spark, "rollup")
    return rollup.history(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), path, rollup.Tokenizer())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_html": op2_html,
    "op3_ann": op3_ann,
    "op4_leaks": op4_leaks,
    "op5_passages": op5_passages,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_rollup": op8_rollup,
    "op9_mixing": op9_mixing,
    "op10_hmm": op10_hmm,
    "pipeline": pipeline,
}

#: the others learn, approximate, or hash in ways that SQL lacks; tests/llm hold them against brute force
ORACLE: dict[str, str] = {"op1_pii": oracles.PII, "op5_passages": oracles.PASSAGES}
