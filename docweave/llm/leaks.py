"""Benchmark decontamination by latent semantic retrieval.

Texts become hashed words (lower case, runs of letters and digits, punctuation left out). Passages of ``2 * STEP`` words make a TF-IDF matrix whose leading right
singular vectors come from a single-pass randomised SVD: tasks sum ``Z = X'X W`` for a random ``W``, and the driver gets the
vectors of ``X'X`` from its Nystrom form ``Z (W'Z)^-1 Z'``. Windows of every text, three sizes at a stride of ``STEP`` words, are compared with the benchmark's passages by cosine in that latent space; what reaches ``COSINE``
is confirmed by the longest common subsequence of words (``COVER`` of the item's words) and by the answer check (half of the
item's ``ANSWERS`` rarest words occur near by).

Benchmark items are taken in blocks of at most ``ITEMS`` passages, so what tasks receive is bounded whatever the
benchmark's size. Cases: null or empty texts match nothing, nor do items of fewer than ``LEAST`` words; repeated rows
match each; an item that occurs twice in a document gives one row, with its best cover.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm import kernel
from docweave.llm.scratch import materialise, tune

BUCKETS, RANK, EXTRA, STEP, SIZES = 4096, 32, 8, 12, (24, 36, 48)
COSINE, SHARE, COVER, ANSWERS, LEAST, ITEMS = 0.6, 0.35, 0.6, 5, 5, 4096
#: words are told apart by 32 bits of their hash; 12 others of them pick the word's row in the matrix
WORD, HIGH, MASK = np.uint32, np.uint32(16), np.uint32(BUCKETS - 1)
LETTERS = (kernel.CLASS == 1).astype(np.uint8)


def _ids(batches):
    for b in batches:
        data, offs = kernel.column_bytes(b.column(1))
        for i, j in kernel.blocks(offs):
            t = kernel.Tokens(data, offs[i : j + 1], LETTERS)
            ids = (t.hash >> np.uint64(32)).astype(WORD)
            cut = t.offs.tolist()
            yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array([ids[p:q].tobytes() for p, q in zip(cut, cut[1:])], pa.binary())], ["doc_id", "ids"])


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = kernel.column_bytes(column)
    return data[offs[0] : offs[-1]].view(WORD), (offs - offs[0]) // WORD().itemsize


def _rows(words: np.ndarray) -> np.ndarray:
    return (words >> HIGH & MASK).astype(np.uint16)


def _pieces(offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of consecutive pieces of ``size`` words, cut at text starts, and each piece's text."""
    n = -(-np.diff(offs) // size)
    owner = np.repeat(np.arange(len(n)), n)
    return offs[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * size, owner


def _blocks(batches, limit: int = 1 << 20):
    for b in batches:
        words, offs = _words(b.column(b.num_columns - 1))
        for i, j in kernel.blocks(offs, limit):
            yield b, i, j, words[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def _sum_up(rows: DataFrame, kind=np.float64) -> np.ndarray | None:
    """The sum of binary rows of equal length; a tree of tasks, the driver adds at most 16."""

    def add(batches):
        total = None
        for b in batches:
            for x in b.column(0):
                part = np.frombuffer(x.as_buffer(), kind)
                total = part.copy() if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["x"])

    for n in (256, 16):
        rows = rows.repartition(n).mapInArrow(add, "x binary")
    parts = [np.frombuffer(r["x"], kind) for r in rows.collect()]
    return np.sum(parts, 0) if parts else None


def _spectrum(ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Inverse document frequencies, and the idf-weighted latent basis, over all passages of the corpus."""
    spark, size = ids.sparkSession, 2 * STEP

    def frequencies(batches):
        total = np.zeros(BUCKETS + 1)
        for _, _, _, words, offs in _blocks(batches):
            start, _ = _pieces(offs, size)
            if len(start):
                piece = np.repeat(np.arange(len(start)), np.diff(np.concatenate((start, [len(words)]))))
                key = piece.astype(np.int32) << 12 | _rows(words)
                key.sort()
                key = key[np.concatenate(([True], key[1:] != key[:-1]))]
                total[:-1] += np.bincount(key & (BUCKETS - 1), minlength=BUCKETS)
                total[-1] += len(start)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["x"])

    got = _sum_up(ids.select("ids").mapInArrow(frequencies, "x binary"))
    got = np.zeros(BUCKETS + 1) if got is None else got
    idf = np.log((got[-1] + 1) / (got[:-1] + 1)) + 1e-3
    width = RANK + EXTRA
    start = np.random.default_rng(17).normal(size=(BUCKETS, width))
    shared = spark.sparkContext.broadcast(np.vstack((idf[:, None] * start, np.zeros((1, width)))).astype(np.float32))

    def sweep(batches):
        total = np.zeros((BUCKETS, width))
        for _, _, _, words, offs in _blocks(batches, 1 << 18):
            first, _ = _pieces(offs, size)
            if not len(first):
                continue
            w = _rows(words)
            y = _sums(shared.value, w, first, size)
            piece = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(w)]))))
            order = np.argsort(w, kind="stable")
            ranked = w[order]
            new = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            total[ranked[new]] += np.add.reduceat(y[piece[order]], new, 0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["x"])

    z = _sum_up(ids.select("ids").mapInArrow(sweep, "x binary"))
    z = start if z is None or not z.any() else idf[:, None] * z.reshape(BUCKETS, width)
    core = start.T @ z
    core = (core + core.T) / 2
    low = max(np.linalg.eigvalsh(core).max(), 1e-12) * 1e-7
    vector, value, _ = np.linalg.svd(np.linalg.solve(np.linalg.cholesky(core + low * np.eye(width)), z.T).T, full_matrices=False)
    # singular values are flattened, so that common words don't decide alone
    scale = 1 / np.maximum(value[:RANK], 1e-6 * max(value.max(), 1e-12))
    return idf, (idf[:, None] * vector[:, :RANK] * scale).astype(np.float32)


def _sums(table: np.ndarray, words: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """For each piece of at most ``size`` words the sum of its words' rows of ``table``, whose last row is zero."""
    n = np.diff(np.concatenate((first, [len(words)])))
    padded = np.concatenate((words, np.zeros(size, words.dtype))).astype(np.int32)
    total = np.zeros((len(first), table.shape[1]), np.float32)
    for k in range(size):
        total += table[np.where(k < n, padded[first + k], len(table) - 1)]
    return total


class Items:
    """A block of benchmark items: passages' unit vectors by window size, and what the checks need."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], idf: np.ndarray, basis: np.ndarray):
        self.id = [i for i, _ in rows]
        self.words = [w for _, w in rows]
        self.basis = np.vstack((basis, np.zeros((1, basis.shape[1]), np.float32)))
        self.vectors, self.owner = {}, {}
        vectors, owner = {s: [] for s in SIZES}, {s: [] for s in SIZES}
        self.bag = np.zeros((len(rows), BUCKETS), bool)
        self.kinds = np.zeros(len(rows))
        self.answer = []
        for k, w in enumerate(self.words):
            f = _rows(w)
            self.bag[k, f] = True
            self.kinds[k] = self.bag[k].sum()
            rare = np.unique(w)
            self.answer.append(set(rare[np.argsort(-idf[_rows(rare)], kind="stable")][:ANSWERS].tolist()))
            size = next((s for s in SIZES if len(w) <= s + STEP // 2), SIZES[-1])
            for a in range(0, max(len(w) - SIZES[-1] // 2, 1), SIZES[-1]):
                v = basis[f[a : a + SIZES[-1]]].sum(0)
                vectors[size].append(v / max(np.linalg.norm(v), 1e-12))
                owner[size].append(k)
        for s in SIZES:
            self.vectors[s] = np.array(vectors[s], np.float32).reshape(-1, basis.shape[1])
            self.owner[s] = np.array(owner[s], np.int64)

    def passages(self) -> int:
        return sum(map(len, self.owner.values()))


def common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & where.get(y, 0)
        if u:
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def matches(words: np.ndarray, offs: np.ndarray, items: Items, cosine: float = COSINE, cover: float = COVER) -> list[tuple[int, int, float]]:
    """(text, item, cover) of a block of texts."""
    start, owner = _pieces(offs, STEP)
    if not len(start):
        return []
    rows = _rows(words)
    sums = _sums(items.basis, rows, start, STEP)
    found: dict[tuple[int, int], float] = {}
    tried: set[tuple[int, int, int]] = set()
    length = np.array([len(w) for w in items.words])
    for size in SIZES:
        if not len(items.owner[size]):
            continue
        v = sums.copy()
        for k in range(1, size // STEP):
            v[:-k] += sums[k:] * (owner[k:] == owner[:-k])[:, None]
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        for a in range(0, len(v), 16384):
            row, col = np.nonzero(v[a : a + 16384] @ items.vectors[size].T >= cosine)
            row += a
            for p in range(0, len(row), 1 << 15):
                r, k = row[p : p + (1 << 15)], items.owner[size][col[p : p + (1 << 15)]]
                # how many kinds of the item's words the window has
                at = start[r][:, None] + np.arange(size)
                inside = at < offs[owner[r] + 1][:, None]
                f = np.sort(np.where(inside, rows[np.minimum(at, len(words) - 1)], BUCKETS).astype(np.int32), 1)
                fresh = np.ones(f.shape, bool)
                fresh[:, 1:] = f[:, 1:] != f[:, :-1]
                hit = items.bag[k[:, None], np.minimum(f, BUCKETS - 1)] & fresh & (f < BUCKETS)
                good = hit.sum(1) >= SHARE * items.kinds[k] * np.minimum(1, size / np.maximum(length[k], 1))
                for i, j in zip(r[good].tolist(), k[good].tolist()):
                    d, n = int(owner[i]), len(items.words[j])
                    if (d, j, i * STEP // max(n, STEP)) in tried or found.get((d, j), 0) >= 1:
                        continue
                    tried.add((d, j, i * STEP // max(n, STEP)))
                    lo, hi = max(int(offs[d]), int(start[i]) - n), min(int(offs[d + 1]), int(start[i]) + size + n)
                    region = words[lo:hi].tolist()
                    near = set(region)
                    if sum(x in near for x in items.answer[j]) * 2 < len(items.answer[j]):
                        continue
                    share = common(items.words[j].tolist(), region) / n
                    if share >= cover:
                        found[d, j] = max(share, found.get((d, j), 0))
    return [(d, j, c) for (d, j), c in found.items()]


def search(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, cover: float = COVER) -> DataFrame:
    """``doc_id, item_id, cover``: one row for each document and benchmark item found in it."""
    spark = docs.sparkSession
    tune(spark)
    ids = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).mapInArrow(_ids, "doc_id long, ids binary"), "ids")
    idf, basis = _spectrum(ids)
    schema = "doc_id long, item_id long, cover double"
    asked = benchmark.select(F.col("item_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).mapInArrow(_ids, "doc_id long, ids binary").where(F.length("ids") >= WORD().itemsize * LEAST)
    out, block, held = [], [], 0

    def sweep(rows):
        shared = spark.sparkContext.broadcast(Items(rows, idf, basis))

        def run(batches):
            items = shared.value
            for b, i, j, words, offs in _blocks(batches, 1 << 18):
                got = matches(words, offs, items, cosine, cover)
                if got:
                    d, k, c = zip(*got)
                    yield pa.RecordBatch.from_arrays([b.column(0)[i:j].take(pa.array(d)), pa.array([items.id[x] for x in k], pa.int64()), pa.array(c, pa.float64())], ["doc_id", "item_id", "cover"])

        return ids.mapInArrow(run, schema)

    # the benchmark comes in order, a bounded block at a time
    for r in asked.orderBy("doc_id", "ids").toLocalIterator():
        words = np.frombuffer(r["ids"], WORD)
        block.append((r["doc_id"], words))
        held += 1 + len(words) // SIZES[-1]
        if held >= ITEMS:
            out.append(sweep(block))
            block, held = [], 0
    if block:
        out.append(sweep(block))
    if not out:
        return spark.createDataFrame([], schema)
    found = out[0]
    for x in out[1:]:
        found = found.union(x)
    return found.groupBy("doc_id", "item_id").agg(F.max("cover").alias("cover"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item was found; columns stay."""
    found = materialise(search(docs, benchmark), "leaks").select(F.col("doc_id").alias("_found")).distinct()
    return docs.join(found, docs["doc_id"] == found["_found"], "left_anti")
