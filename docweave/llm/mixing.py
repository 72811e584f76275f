"""Soft-membership mixing of documents to target domain weights.

A classifier fitted on the labelled table gives each document posteriors over domains. Nonnegative rates ``r`` are then
fitted so that the expected token totals ``sum(r * n_tokens * posterior)`` match the targets in least squares, starting at
rate 1. A step is a projected gradient step, scaled by the inverse of the domains' Gram matrix over documents
whose rate isn't held at zero: ``r = max(0, r - posterior . v)``. As ``v`` has one number a domain, a document's rate
is a fold over the short list of steps: each round is one distributed aggregation of the compact posterior table,
and the driver holds only domain by domain matrices.

Domains: ``good`` (quality 1, not toxic), ``toxic``, ``junk`` (the rest). Cases: null text has no tokens and keeps the rate
that its posterior gives; without labels or without tokens, all posteriors are equal and rates are 1. Targets are shares
of the token budget, by default all tokens of the input.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm import linear
from docweave.llm.scratch import materialise

DOMAINS = ("good", "toxic", "junk")
TARGETS = {"good": 0.88, "toxic": 0.06, "junk": 0.06}
ROUNDS, TOLERANCE = 25, 1e-6


def _models(docs: DataFrame, labels: DataFrame, sample: int) -> list:
    known = labels.where("quality is not null and toxic is not null").select(
        "doc_id",
        F.when(F.expr("quality = 1 and toxic = 0"), 1).otherwise(0).alias("good"),
        F.when(F.expr("toxic = 1"), 1).otherwise(0).alias("toxic"),
        F.when(F.expr("quality = 0 and toxic = 0"), 1).otherwise(0).alias("junk"),
    )
    return linear.fit(docs, known, list(DOMAINS), sample)


def _shares() -> list:
    total = sum(F.col("p")[k] for k in range(len(DOMAINS)))
    return [F.col("n_words").alias("n_tokens"), *[(F.col("p")[k] / total).alias(f"p_{d}") for k, d in enumerate(DOMAINS)]]


def posteriors(docs: DataFrame, labels: DataFrame, sample: int = linear.SAMPLE) -> DataFrame:
    """``doc_id, n_tokens, p_good, p_toxic, p_junk``: one-against-rest models, scaled to sum to 1."""
    return linear.scores(docs, _models(docs, labels, sample)).select("doc_id", *_shares())


def _rate(steps: list[np.ndarray]):
    r = F.lit(1.0)
    for v in steps:
        r = F.greatest(F.lit(0.0), r - sum(F.col(f"p_{d}") * F.lit(float(v[k])) for k, d in enumerate(DOMAINS)))
    return r


def fit_rates(table: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None) -> tuple[list[np.ndarray], float]:
    """The steps whose fold is every document's rate, and the largest miss of a target as a share of the budget."""
    share = np.array([(targets or TARGETS)[d] for d in DOMAINS])
    share = share / share.sum()
    steps: list[np.ndarray] = []
    k = len(DOMAINS)
    best, best_steps, damp = np.inf, [], 1.0
    total = None
    for _ in range(ROUNDS):
        # rates are expanded from a few literals; a plain column keeps each aggregate's expression short
        t = table.withColumn("_r", _rate(steps))
        sums = [F.sum(F.col("_r") * F.col("n_tokens") * F.col(f"p_{d}")) for d in DOMAINS]
        pairs = [(a, b) for a in range(k) for b in range(a, k)]
        gram = [F.sum(F.when(F.col("_r") > 0, F.col("n_tokens") * F.col(f"p_{DOMAINS[a]}") * F.col(f"p_{DOMAINS[b]}")).otherwise(0.0)) for a, b in pairs]
        got = [float(x or 0) for x in t.agg(F.sum("n_tokens"), *sums, *gram).first()]
        total = got[0] if budget is None else float(budget)
        if not got[0] or not total:
            return [], 0.0
        error = (np.array(got[1 : 1 + k]) - share * total) / total
        miss = float(np.abs(error).max())
        if miss < best:
            best, best_steps = miss, list(steps)
        elif steps:
            # a step that overshot is taken back and halved
            damp, steps = damp / 2, list(best_steps)
            steps.append(last * damp)  # noqa: F821  set with the first step
            continue
        if miss < TOLERANCE:
            break
        g = np.zeros((k, k))
        for (a, b), x in zip(pairs, got[1 + k :]):
            g[a, b] = g[b, a] = x / total
        last = np.linalg.solve(g + 1e-9 * np.eye(k), error)
        damp = 1.0
        steps.append(last)
    if best > TOLERANCE:
        warnings.warn(f"mixing misses a target by {best:.2g} of the token budget", stacklevel=2)
    return best_steps, best


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None) -> DataFrame:
    """``doc_id, n_tokens``, the posteriors and ``rate``: how often each document is to be read."""
    table = materialise(posteriors(docs, labels), "posteriors")
    return table.withColumn("rate", _rate(fit_rates(table, targets, budget)[0]))


def with_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Documents with a rate above zero, their columns, and ``rate``, ``domain`` and ``n_tokens``, which replace columns of these names."""
    own = [f"_{k}" for k in range(len(docs.columns))]
    scored = linear.scores(docs.toDF(*own), _models(docs, labels, linear.SAMPLE), own[docs.columns.index("text")], whole=True)
    table = materialise(scored.select(*own, *_shares()), "posteriors")
    best = F.greatest(*[f"p_{d}" for d in DOMAINS])
    domain = F.coalesce(*[F.when(F.col(f"p_{d}") == best, F.lit(d)) for d in DOMAINS])
    table = table.withColumn("rate", _rate(fit_rates(table, targets)[0])).where("rate > 0").withColumn("domain", domain)
    added = ("rate", "domain", "n_tokens")
    return table.select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns) if c not in added], *added)
