"""Connected components of a distributed edge list, by alternating large-star and small-star steps, or of a short one in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.scratch import materialise


#: edges that one task may hold: two longs each, and some more of that size while it links them
FEW = 1 << 20


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges, and each one's smallest reachable node; edges from a node to itself don't count."""
    apart = a != b
    a, b = a[apart], b[apart]
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    comp = np.arange(len(nodes))
    while True:
        x, y = comp[i], comp[j]
        apart = x != y
        if not apart.any():
            return nodes, nodes[comp]
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(comp, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = comp[comp]
            if (up == comp).all():
                break
            comp = up


def _at_once(edges: DataFrame) -> DataFrame:
    def run(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in roots_of(*(np.concatenate(x) for x in zip(*got)))], ["node", "root"])

    return materialise(edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long"), "roots")


def components(edges: DataFrame, few: int = 0) -> DataFrame:
    """``edges``: longs ``a``, ``b``. Returns ``node, root`` for every node of an edge, root being the smallest
    node of its component. Self loops and repeated edges are allowed; an empty list gives no rows.

    Each round is two joins on aggregated minima; a node of huge degree is only ever pre-aggregated, or
    joined in a way that adaptive execution can split. Rounds grow with the logarithm of the longest chain.

    A round has some ten stages, whose tasks the driver has to keep account of whatever their size. ``few`` is for edges that
    are written already: if there are no more than that, one task links them all, without a shuffle.
    """
    if few and edges.count() <= few:
        return _at_once(edges)

    def both(e):
        return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def hashed(e):
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        return row["n"], row["h"]

    e = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = hashed(e)
    while state[0]:
        two = both(e)
        low = two.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = two.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        mins = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(mins, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(mins.select("a", F.col("m").alias("b")))
        e = materialise(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
        now = hashed(e)
        if now == state:
            break
        state = now
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
