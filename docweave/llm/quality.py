"""Quality classifier: hashed word n-gram logistic regression (see ``linear``).

Labels are learned only from rows whose crc32(doc_id) modulo 5 is not 0; the rest is for held-out accuracy. Inputs of a
score are the text's n-grams alone. Cases: null text counts as empty and gets the bias's score; a table without usable
labels gives 0.5 to every document, which keeps it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm import linear

FOLDS, KEEP_AT = 5, 0.3


def fit(docs: DataFrame, labels: DataFrame, sample: int = linear.SAMPLE):
    learn = labels.where(linear.bucket_of("doc_id", FOLDS) != 0)
    return linear.fit(docs, learn, ["quality"], sample)[0]


def score(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    p = linear.scores(docs, [fit(docs, labels)])
    return p.select(
        "doc_id",
        F.coalesce(linear.bucket_of("doc_id", FOLDS) == 0, F.lit(False)).alias("held_out"),
        F.col("p")[0].alias("score"),
        F.when(F.col("p")[0] >= keep_at, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """The documents that are predicted to be good; columns stay."""
    return linear.keep(docs, fit(docs, labels), keep_at)
