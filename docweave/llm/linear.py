"""Hashed word n-gram logistic regression, trained with follow-the-regularised-leader (FTRL-proximal) updates.

A text's tokens are its maximal runs of letters and digits (with all non-ASCII) and its runs of other ASCII
signs, case kept. Unigrams and bigrams are hashed into ``2**BITS`` buckets, all bigrams that repeat one token into the
same one; a feature's value is ``1 + ln(count)``, divided by the fourth root of the text's number of features. A score is the logistic of a sparse dot product and a bias. An empty or null text has only the bias.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from docweave.llm import kernel
from docweave.llm.scratch import tune

BITS = 18
#: the hash of every bigram whose tokens are equal
AGAIN = np.uint64(0x5851F42D4C957F2D)
#: most labelled rows used for fitting, taken in the order of a hash of their id
SAMPLE = 8192


def features(data: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of texts: the owner, bucket and value of each feature, and each text's number of white-space words."""
    t = kernel.Tokens(data, offs, kernel.CLASS)
    n, owner = len(offs) - 1, t.owner()
    shift = np.uint64(64 - bits)
    pair, first = kernel.windows(t, 2)
    pair[t.hash[first] == t.hash[first + 1]] = AGAIN
    key = np.concatenate((owner << bits | (t.hash >> shift).astype(np.int64), owner[first] << bits | (pair >> shift).astype(np.int64)))
    key.sort()
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate((new, [len(key)])))
    key = key[new]
    owner, bucket = key >> bits, key & ((1 << bits) - 1)
    value = 1 + np.log(count)
    value *= np.bincount(owner, minlength=n)[owner] ** -0.25
    words = kernel.Tokens(data, offs, kernel.WORDS).offs
    return owner, bucket, value, np.diff(words)


def ftrl(rows: list[tuple[float, np.ndarray, np.ndarray]], epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.3, l2: float = 0.01, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Weights and bias from rows of (label 0 to 1, buckets, values), in the order given."""
    size = 1 << bits
    z, g2, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)

    def weight(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(g2[i])) / alpha + l2))

    for _ in range(epochs):
        for y, i, x in rows:
            i, x = np.append(i, size), np.append(x, 1.0)
            w[i] = weight(i)
            p = 1 / (1 + np.exp(-np.clip(w[i] @ x, -35, 35)))
            g = (p - y) * x
            s = (np.sqrt(g2[i] + g * g) - np.sqrt(g2[i])) / alpha
            z[i] += g - s * w[i]
            g2[i] += g * g
    every = np.arange(size + 1)
    w = weight(every)
    return w[:size].astype(np.float32), float(w[size])


def bucket_of(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def _labelled(docs: DataFrame, labels: DataFrame, label_cols: list[str], sample: int) -> DataFrame:
    """At most ``sample`` rows of an order, labels, buckets and values: the bound is on rows, a row holds at most a text's
    distinct n-grams. Rows without a label, without a document, or with null labels don't count; several labels
    of one document are averaged, and of documents that share an id one counts, that of the smallest text."""
    tune(docs.sparkSession)
    known = labels.where(" and ".join(f"{c} is not null" for c in ["doc_id", *label_cols]))
    known = known.groupBy("doc_id").agg(*[F.avg(F.col(c).cast("double")).alias(f"_y{k}") for k, c in enumerate(label_cols)])
    known = known.withColumn("_order", F.xxhash64("doc_id")).orderBy("_order", "doc_id").limit(sample)
    ys = [f"_y{k}" for k in range(len(label_cols))]
    # the sample's size is bounded by its parameter, so it may be broadcast
    rows = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id", "_order", *ys).agg(F.min("text").alias("text")).select("_order", F.array(*ys).alias("y"), "text")

    def run(batches):
        for b in batches:
            data, offs = kernel.column_bytes(b.column(2))
            for i, j in kernel.blocks(offs):
                owner, bucket, value, _ = features(data, offs[i : j + 1])
                cut = np.searchsorted(owner, np.arange(j - i + 1)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j], b.column(1)[i:j], pa.array([bucket[p:q].astype(np.int32).tobytes() for p, q in zip(cut, cut[1:])], pa.binary()), pa.array([value[p:q].astype(np.float32).tobytes() for p, q in zip(cut, cut[1:])], pa.binary())],
                    ["o", "y", "i", "x"],
                )

    return rows.mapInArrow(run, "o long, y array<double>, i binary, x binary")


def _in_order(got: list[tuple]) -> list[tuple]:
    """Rows of (labels, buckets, values) as views of rows of ``_labelled``; wider numbers are made a row at a time."""
    return [(y, np.frombuffer(i, np.int32), np.frombuffer(x, np.float32)) for _, y, i, x in sorted(got, key=lambda r: (r[0], bytes(r[2])))]


def labelled_features(docs: DataFrame, labels: DataFrame, label_cols: list[str], sample: int = SAMPLE) -> list[tuple]:
    """The rows of (labels, buckets, values) that models are fitted on, collected."""
    return _in_order(_labelled(docs, labels, label_cols, sample).collect())


def fit(docs: DataFrame, labels: DataFrame, label_cols: list[str], sample: int = SAMPLE) -> list[tuple[np.ndarray, float]]:
    """Weights and bias for each label. One task holds the bounded sample and fits them; the driver gets the weights alone."""

    def run(batches):
        got = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        if got:
            rows = _in_order(got)
            for k in range(len(label_cols)):
                w, bias = ftrl([(y[k], i, x) for y, i, x in rows])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([w.tobytes()], pa.binary()), pa.array([bias])], ["k", "w", "bias"])

    found = _labelled(docs, labels, label_cols, sample).repartition(1).mapInArrow(run, "k int, w binary, bias double").collect()
    models = {r["k"]: (np.frombuffer(bytes(r["w"]), np.float32), r["bias"]) for r in found}
    return [models[k] if models else ftrl([]) for k in range(len(label_cols))]


def scores(docs: DataFrame, models: list[tuple[np.ndarray, float]], text_col: str = "text", whole: bool = False) -> DataFrame:
    """``doc_id, p`` (each model's probability) and ``n_words`` of every document's whole text; with ``whole`` all columns, and ``p`` and ``n_words``."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    docs = docs if whole else docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col)
    at = docs.columns.index(text_col)
    kept = [k for k in range(len(docs.columns)) if whole or k != at]

    def run(batches):
        for b in batches:
            data, offs = kernel.column_bytes(b.column(at))
            for i, j in kernel.blocks(offs):
                owner, bucket, value, words = features(data, offs[i : j + 1])
                p = np.empty((j - i, len(shared.value)))
                for k, (w, bias) in enumerate(shared.value):
                    p[:, k] = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[bucket] * value, j - i) + bias, -35, 35)))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(k)[i:j] for k in kept), flat, pa.array(words.astype(np.int64))], [*(b.schema.names[k] for k in kept), "p", "n_words"])

    fields = [StructField(f.name, f.dataType) for f in (docs.schema.fields[k] for k in kept)]
    return docs.mapInArrow(run, StructType([*fields, StructField("p", ArrayType(DoubleType())), StructField("n_words", LongType())]))


def keep(docs: DataFrame, model: tuple[np.ndarray, float], least: float) -> DataFrame:
    """The rows whose text scores ``least`` or more, whole and without a shuffle."""
    tune(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for b in batches:
            data, offs = kernel.column_bytes(b.column(at))
            w, bias = shared.value
            good = np.zeros(b.num_rows, bool)
            for i, j in kernel.blocks(offs):
                owner, bucket, value, _ = features(data, offs[i : j + 1])
                good[i:j] = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[bucket] * value, j - i) + bias, -35, 35))) >= least
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
