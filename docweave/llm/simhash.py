"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are exact XXH64 SimHashes. Distinct fingerprints go into binary tries, and pairs of trie nodes are
walked down together: each differing bit costs one unit of the error budget and a pair without budget is dropped.

To spread the walk, every fingerprint enters one trie per choice of bit blocks: with ``b`` blocks and at most
``r`` differing bits some ``b - r`` blocks agree, so a trie whose top bits are those blocks starts its walk at
nodes with equal tops (``fp & mask``), and tops are dealt over the cluster. A top that holds more than ``HOT``
fingerprints is split anew by the same argument on its remaining bits, so no link is lost. Each task links
with union-find and returns a spanning forest, never all pairs of a group.

The pipeline's stage (``keep_one``) walks the tries with ``NEAR`` bits of budget and confirms each link by the exact similarity of
shingle sets. Similar texts may differ in more bits than tries can carry, so ``shingles`` completes the links: those of
the tries join groups before, and only texts still apart are compared there.

Cases: null or empty text has fingerprint 0 and is linked like any other; a row with null doc_id has a fingerprint and a null component. Repeated documents keep a row each.
Other input columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm import kernel, shingles
from docweave.llm.components import components
from docweave.llm.scratch import discard, materialise, tune

RADIUS, SEED, HOT = 3, 42, 1 << 16
#: bits of the pipeline's stage, whose links are confirmed
NEAR = 4
_LOWER = bytes(kernel.LOWER)


def simhash(text: bytes, width: int = 3) -> int:
    """The fingerprint of one UTF-8 text."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= width:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) for each document."""
    tune(docs.sparkSession)

    def run(batches):
        for b in batches:
            data, offs = kernel.column_bytes(b.column(1))
            fps = [simhash(data[offs[i] : offs[i + 1]].tobytes()) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _block_masks(bits: list[int], parts: int, chosen: int) -> list[int]:
    edges = [len(bits) * i // parts for i in range(parts + 1)]
    cut = [sum(1 << b for b in bits[edges[i] : edges[i + 1]]) for i in range(parts)]
    return [sum(c) for c in combinations(cut, chosen)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def trie_forest(fp: np.ndarray, mask: int, radius: int = RADIUS, block: int = 1 << 18, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Links among distinct uint64 ``fp`` that agree on ``mask`` and differ in at most ``radius`` bits, as a
    forest: positions ``i`` and their root's position, or with ``pairs`` the positions of linked fingerprints themselves."""
    n = len(fp)
    high = [b for b in range(63, -1, -1) if mask >> b & 1]
    low = [b for b in range(63, -1, -1) if not mask >> b & 1]
    perm = np.zeros(n, np.uint64)
    for place, b in enumerate(high + low):
        perm |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(63 - place)
    order = np.argsort(perm, kind="stable")
    key = perm[order]
    depth = len(high)
    comp = np.arange(n)
    top = key >> np.uint64(64 - depth) if depth else np.zeros(n, np.uint64)
    lo = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1]))) if n else np.zeros(0, np.int64)
    hi = np.concatenate((lo[1:], [n])).astype(np.int64)
    some = hi - lo > 1
    lo, hi = lo[some], hi[some]
    ones: dict[int, np.ndarray] = {}
    used = [(comp[:0], comp[:0])]

    def link(i, j):
        """Hook larger roots to smaller ones until every linked pair shares a root."""
        while True:
            a, b = comp[i], comp[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if pairs:  # the link by which each larger root is hooked
                by = np.lexsort((np.minimum(a, b), np.maximum(a, b)))
                by = by[np.unique(np.maximum(a, b)[by], return_index=True)[1]]
                used.append((i[by], j[by]))
            np.minimum.at(comp, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = comp[comp]
                if (up == comp).all():
                    break
                comp[:] = up

    stack = [(depth, lo, hi, lo, hi, np.full(len(lo), radius, np.int8))] if len(lo) else []
    while stack:
        d, al, ah, bl, bh, left = stack.pop()
        if len(al) > block:
            for k in range(0, len(al), block):
                stack.append((d, *(x[k : k + block] for x in (al, ah, bl, bh, left))))
            continue
        change = np.concatenate(([0], np.cumsum(comp[1:] != comp[:-1]))) if n else np.zeros(0, np.int64)
        done = (comp[al] == comp[bl]) & (change[ah - 1] == change[al]) & (change[bh - 1] == change[bl])
        leaf = (ah - al == 1) & (bh - bl == 1) & ~done
        if leaf.any():
            i, j = al[leaf], bl[leaf]
            near = np.bitwise_count(key[i] ^ key[j]) <= radius
            if near.any():
                link(i[near], j[near])
        go = ~(done | leaf)
        if d == 64 or not go.any():
            continue
        al, ah, bl, bh, left = al[go], ah[go], bl[go], bh[go], left[go]
        if d not in ones:
            ones[d] = np.concatenate(([0], np.cumsum((key >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)))
        c = ones[d]
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        self_pair = al == bl
        cross = [(al, am, bm, bh, left - 1, left > 0), (am, ah, bl, bm, left - 1, (left > 0) & ~self_pair)]
        same = [(al, am, bl, bm, left, np.ones(len(al), bool)), (am, ah, bm, bh, left, np.ones(len(al), bool))]
        for group in (cross, same):
            parts = []
            for x0, x1, y0, y1, budget, ok in group:
                ok = ok & (x1 > x0) & (y1 > y0) & ~((x0 == y0) & (x1 - x0 == 1))
                parts.append([x[ok] for x in (x0, x1, y0, y1, budget)])
            merged = [np.concatenate(p) for p in zip(*parts)]
            if len(merged[0]):
                stack.append((d + 1, *merged))
    if pairs:
        i, j = (np.concatenate(x) for x in zip(*used))
        return order[i], order[j]
    child = np.flatnonzero(comp != np.arange(n))
    return order[child], order[comp[child]]


def links(distinct: DataFrame, radius: int = RADIUS, hot: int = HOT, pairs: bool = False, chosen: int = 1) -> DataFrame:
    """Forest edges ``a, b`` among the ``rep`` longs of distinct ``fp`` within ``radius`` bits; with ``pairs`` each edge is itself within them.
    Tops are of ``chosen`` blocks, or more for many rows."""
    total = distinct.count()
    parts = radius + max(chosen, 1 if total <= 1 << 22 else 2 if total <= 1 << 32 else 3)
    masks = _block_masks(list(range(64)), parts, parts - radius)

    def dealt(df, choice):
        return df.select("fp", "rep", F.explode(choice).alias("mask")).withColumn("top", F.col("fp").bitwiseAND(F.col("mask")))

    rows, calm = dealt(distinct, F.array(*[F.lit(_signed(m)) for m in masks])), []
    for _ in range(2):
        size = rows.groupBy("mask", "top").count().where(F.col("count") > hot).select("mask", "top")
        if size.isEmpty():
            break
        finer = {m: [m | x for x in _block_masks([b for b in range(64) if not m >> b & 1], radius + 1, 1)] for m in masks}
        choice = F.element_at(F.create_map(*[x for m, f in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(y)) for y in f]))]), F.col("mask"))
        calm.append(rows.join(size, ["mask", "top"], "left_anti").select("fp", "rep", "mask", "top"))
        rows = dealt(rows.join(size, ["mask", "top"], "left_semi"), choice)
        masks = [y for f in finer.values() for y in f]
    for df in calm:
        rows = rows.select("fp", "rep", "mask", "top").union(df)

    def run(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches]
        if not got:
            return
        fp, rep, mask = (np.concatenate(x) for x in zip(*got))
        for m in np.unique(mask):
            own = np.flatnonzero(mask == m)
            i, root = trie_forest(fp[own].astype(np.int64).view(np.uint64), int(m) & (2**64 - 1), radius, pairs=pairs)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(rep[own][i]), pa.array(rep[own][root])], ["a", "b"])

    return rows.repartition("mask", "top").select("fp", "rep", "mask").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``: the smallest doc_id reachable over links of ``radius`` bits or fewer."""
    fps = materialise(fingerprints(docs, id_col, text_col), "fps")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "distinct")
    roots = components(links(distinct, radius))
    named = distinct.join(roots, distinct.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_pairs(docs: DataFrame, ids: DataFrame, radius: int = NEAR) -> DataFrame:
    """Pairs ``a, b`` within ``radius`` bits that span each group, among the rows of ``id, text`` whose id is in ``ids``."""
    fps = materialise(fingerprints(docs, "id", "text").join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), "fps")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    equal = fps.join(distinct, "fp").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    found = materialise(equal.union(links(distinct, radius, pairs=True, chosen=2)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "found")
    discard(fps, distinct)
    return found


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that are the smallest doc_id of their group of near copies: links of the tries, confirmed by the similarity of whole sets of
    word shingles, and all further links of that similarity; columns stay, whatever their names. Needs unique doc_id; rows without one stay."""
    gone = shingles.copies(docs, near=near_pairs).where("id <> root").select(F.col("id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
