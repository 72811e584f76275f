"""Near copies by exact similarity of word shingles.

A text is the set of its runs of ``WIDTH`` words; two texts are linked if the Jaccard similarity of their sets is at
least ``UP / DOWN``. Candidates come from prefix filtering, which loses no pair: with one order of shingles for all texts, two
sets of that similarity share a shingle among the first ``n - ceil(n * UP / DOWN) + 1`` of each. Candidates are then
confirmed by their whole sets.

Equal sets are one to begin with. Pairs that a caller has found by other means (``near``) are confirmed first, and texts that they join aren't
compared again. Each shingle's texts are first compared with the smallest of them, which
joins large groups of copies at a row a text; only texts still apart are then compared pair by pair. The order puts
shingles that a sample of texts has often at the end; it decides speed, never results.

Cases: words are lower-cased in A-Z and split at ASCII white space. A text of fewer than ``WIDTH`` words is one shingle; null and
wordless texts have the empty set and equal each other. Rows without an id are in no group. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm import kernel
from docweave.llm.components import FEW, components
from docweave.llm.scratch import discard, materialise, tune

WIDTH, UP, DOWN = 5, 4, 5
#: the sample for the order: one text in so many, shingles that so many of them have, and at most so many shingles
SHARE, OFTEN, LATE = 64, 4, 1 << 16
#: parities kept of a set, which drop most false candidates (and no true one) before whole sets are sent
BITS = 4096


def sets(data: np.ndarray, offs: np.ndarray, late: np.ndarray | None = None, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles in the common order, one text after the other, and where each text's begin."""
    t = kernel.Tokens(data, offs, lower=True)
    n, words = len(t.offs) - 1, np.diff(t.offs)
    h, first = kernel.windows(t, width)
    owner = np.searchsorted(t.offs, first, "right") - 1
    short = np.flatnonzero((words > 0) & (words < width))
    if len(short):
        whole = [xxhash.xxh64_intdigest(t.hash[t.offs[i] : t.offs[i + 1]].tobytes()) for i in short]
        h, owner = np.concatenate((h, np.array(whole, np.uint64))), np.concatenate((owner, short))
    last = np.zeros(len(h), bool)
    if late is not None and len(late):
        last = late[np.minimum(np.searchsorted(late, h), len(late) - 1)] == h
    order = np.lexsort((h, last, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(n + 1))


def _each(batches, late=None):
    """Ids, shingles and bounds, block by block."""
    for b in batches:
        data, offs = kernel.column_bytes(b.column(1))
        for i, j in kernel.blocks(offs):
            yield b.column(0)[i:j], *sets(data, offs[i : j + 1], late)


def _late(docs: DataFrame) -> np.ndarray:
    def run(batches):
        for _, h, _ in _each(batches):
            yield pa.RecordBatch.from_arrays([pa.array(kernel.signed(h))], ["h"])

    some = docs.where(F.pmod(F.xxhash64("id"), F.lit(SHARE)) == 0).mapInArrow(run, "h long")
    often = some.groupBy("h").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(LATE).select("h").toPandas()
    return np.sort(often["h"].to_numpy(np.int64).view(np.uint64))


def _prefixes(docs: DataFrame) -> DataFrame:
    """``id, digest, size, prefix`` of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(_late(docs))

    def run(batches):
        for ids, h, cut in _each(batches, shared.value):
            size = np.diff(cut)
            # no prefix for the empty set
            length = np.where(size > 0, size - (UP * size + DOWN - 1) // DOWN + 1, 0)
            digest = [xxhash.xxh3_128_digest(h[a:z].tobytes()) for a, z in zip(cut, cut[1:])]
            inside = np.arange(len(h)) - np.repeat(cut[:-1], size) < np.repeat(length, size)
            bounds = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(bounds), pa.array(kernel.signed(h[inside])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(digest, pa.binary()), pa.array(size.astype(np.int32)), prefix], ["id", "digest", "size", "prefix"])

    return docs.mapInArrow(run, "id long, digest binary, size int, prefix array<long>")


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` of ids whose whole sets are similar enough."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()

    def whole(batches):
        for ids, h, cut in _each(batches):
            own = [h[a:z] for a, z in zip(cut, cut[1:])]
            marks = [np.packbits((np.bincount((x % BITS).astype(np.int64), minlength=BITS) & 1).astype(bool)).tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(cut)), pa.array(marks, pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())], ["id", "size", "mark", "set"])

    own = materialise(docs.join(named, docs.id == F.col("_id"), "left_semi").select("id", "text").mapInArrow(whole, "id long, size long, mark binary, set binary"), "sets")

    def near(batches):
        for b in batches:
            x, y = (data[offs[0] : offs[-1]].reshape(-1, BITS // 8) for data, offs in map(kernel.column_bytes, b.columns[4:]))
            # each differing parity is a shingle that one set has alone
            differ = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            keep = differ * (UP + DOWN) <= (DOWN - UP) * (b.column(2).to_numpy() + b.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(DOWN * both >= UP * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def side(name, *cols):
        return own.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in cols])

    few = pairs.join(side("a", "size", "mark"), "a").join(side("b", "size", "mark"), "b").select("a", "b", "a_size", "b_size", "a_mark", "b_mark")
    few = materialise(few.mapInArrow(near, "a long, b long"), "near")
    whole_pairs = few.join(side("a", "set"), "a").join(side("b", "set"), "b").select("a", "b", "a_set", "b_set")
    similar = materialise(whole_pairs.mapInArrow(run, "a long, b long"), "similar")
    discard(own, few)
    return similar


def _alike(a_size, b_size):
    return F.least(a_size, b_size) * DOWN >= F.greatest(a_size, b_size) * UP


def _may(a_size, a_pos, b_size, b_pos):
    """Whether sets of these sizes, whose first common shingle may be at these places, can be similar enough."""
    most = F.least(a_size - a_pos, b_size - b_pos)
    return _alike(a_size, b_size) & (most * (UP + DOWN) >= (a_size + b_size) * UP)


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """``id, root`` for every row with an id: the smallest id reachable over links of similar texts. ``near`` makes pairs ``a, b`` from ``id, text`` and
    the ``id`` of each distinct set."""
    tune(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    each = materialise(_prefixes(docs), "prefixes")
    reps = materialise(each.groupBy("digest").agg(F.min("id").alias("rep")), "reps")
    named = reps.select(F.col("rep").alias("id")).distinct()
    first = None
    if near is not None:
        asked = near(docs, named)
        first = _confirmed(asked, docs)
        discard(asked)
    one = each.join(named, "id", "left_semi").dropDuplicates(["id", "digest"])
    # narrow rows, as these are all first shingles of all texts: size and place share a number
    every = one.select("id", "size", F.posexplode("prefix").alias("pos", "h")).select("h", "id", F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("at"))
    # only shingles that two texts have
    two = every.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("h")
    rows = shared = materialise(every.join(two, "h", "left_semi").select("h", "id", F.shiftright("at", 32).cast("int").alias("size"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos")), "shared")
    known = rows.withColumn("root", F.col("id"))
    if first is not None:
        known = rows.join(components(first, FEW).select(F.col("node").alias("id"), "root"), "id", "left").select("h", "id", "size", "pos", F.coalesce("root", "id").alias("root"))
    lead = known.groupBy("h").agg(F.min(F.struct("id", "size", "pos", "root")).alias("lead"))
    star = known.join(lead, "h").where(F.col("root") != F.col("lead.root")).where(_may(F.col("lead.size"), F.col("lead.pos"), F.col("size"), F.col("pos")))
    star = materialise(star.select(F.col("lead.id").alias("a"), F.col("id").alias("b")).distinct(), "star")
    edges = _confirmed(star, docs) if first is None else first.union(_confirmed(star, docs))
    roots = components(edges, FEW).select(F.col("node").alias("id"), "root")
    rows = rows.join(roots, "id", "left").select("h", "id", "size", "pos", F.coalesce("root", "id").alias("root"))
    apart = rows.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
    left = materialise(rows.join(apart, "h", "left_semi"), "apart")
    discard(shared, star)
    x, y = (left.select("h", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "size", "pos", "root")]) for s in "xy")
    rest = x.join(y, "h").where("x_id < y_id and x_root <> y_root").where(_alike(F.col("x_size"), F.col("y_size")))
    # up to the last common shingle of both prefixes all common ones are known; after it at most the rest of the smaller set is common
    rest = rest.groupBy("x_id", "y_id", "x_size", "y_size").agg(F.count("*").alias("both"), F.max("x_pos").alias("x_pos"), F.max("y_pos").alias("y_pos"))
    most = F.col("both") + F.least(F.col("x_size") - F.col("x_pos"), F.col("y_size") - F.col("y_pos")) - 1
    rest = rest.where(most * (UP + DOWN) >= (F.col("x_size") + F.col("y_size")) * UP)
    rest = materialise(rest.select(F.col("x_id").alias("a"), F.col("y_id").alias("b")), "rest")
    discard(left)
    roots = components(edges.union(_confirmed(rest, docs)), FEW).select(F.col("node").alias("rep"), "root")
    return each.select("id", "digest").join(reps, "digest").join(roots, "rep", "left").select("id", F.coalesce("root", "rep").alias("root"))
