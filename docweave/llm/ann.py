"""Nearest neighbours by inner product over additively quantised vectors.

A vector is approximated by a sum of one codeword from each of ``BOOKS`` full-dimensional codebooks. Codebooks are learned
on residuals of a bounded sample; codes are found by beam search; each vector's norm is stored, as the ratio that
stretches its approximation to its true length, and so is the length of what the approximation misses. Every row is indexed. The first code is also
the row's cell, of which there are as many as the square root of the number of rows (at most ``CELLS``).

No neighbour is lost, whatever the rows are: a query's ``k``-th best score among sampled rows bounds what its neighbours score. It looks into each block of cells that
may hold such a row (its product with the cell's codeword, and the cell's radius times its length, reach the bound), and there scores by table look-ups; rows whose look-up and miss reach the
bound are scored with the original vectors in double precision. Where vectors lie in clusters that is few blocks and rows; where they don't, it is most of them.

Cells that lie together make blocks of at most ``BLOCK`` rows, larger cells are split, and a block's queries are taken by ``ASKED``, so a hot cell is many tasks. Cases: vectors that
are null, zero, or that hold null or non-finite components take no part; vectors of different lengths are searched apart; equal vectors have equal
codes and ties go to the smaller id; equal rows count once, and rows that share an id are one item, with its best score; with no vectors the result is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.scratch import materialise, tune

BOOKS, WORDS, CELLS, BEAM, SAMPLE = 12, 64, 4096, 4, 16_384
FOUND, BLOCK, ASKED = 0.96, 8192, 32_768
#: sampled numbers that bound the scores; what single precision may be off, as a share of the lengths; pairs scored at once
BOUND, LOOSE, PAIRS = 1 << 20, 1e-5, 1 << 16


class Codebooks:
    def __init__(self, books: list[np.ndarray]):
        self.books = books

    @staticmethod
    def fit(x: np.ndarray, cells: int = WORDS, words: int = WORDS, books: int = BOOKS, rounds: int = 12, seed: int = 3) -> Codebooks:
        rng, rest, made = np.random.default_rng(seed), x.copy(), []
        for m in range(books):
            k = min(cells if m == 0 else words, len(rest))
            c = rest[rng.choice(len(rest), k, replace=False)].copy()
            for _ in range(rounds):
                near = np.argmin((c * c).sum(1) - 2 * rest @ c.T, 1)
                size = np.bincount(near, minlength=k)
                total = np.zeros_like(c)
                np.add.at(total, near, rest)
                some = size > 0
                c[some] = total[some] / size[some, None]
            rest = rest - c[np.argmin((c * c).sum(1) - 2 * rest @ c.T, 1)]
            made.append(c)
        return Codebooks(made)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes by beam search, and for each row the ratio of its norm to its approximation's."""
        n, rows = len(x), np.arange(len(x))[:, None]
        codes, rest = np.zeros((n, 1, 0), np.int16), x[:, None, :]
        for c in self.books:
            # squared residual norm after each codeword, up to what all share
            cost = (rest * rest).sum(2)[:, :, None] - 2 * rest @ c.T + (c * c).sum(1)
            flat = cost.reshape(n, -1)
            width = min(beam, flat.shape[1])
            best = np.argpartition(flat, width - 1, 1)[:, :width]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), 1, kind="stable"), 1)
            parent, word = best // len(c), best % len(c)
            codes = np.concatenate((codes[rows, parent], word[:, :, None].astype(np.int16)), 2)
            rest = rest[rows, parent] - c[word]
        approx = x - rest[:, 0]
        return codes[:, 0], np.linalg.norm(x, axis=1) / np.maximum(np.linalg.norm(approx, axis=1), 1e-12)

    def missed(self, x: np.ndarray, codes: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row at most how far its stretched approximation, and its cell's codeword, are from it."""
        x, length = x.astype(np.float64), 0.0
        approx = np.zeros_like(x)
        for m, c in enumerate(self.books):
            word = c[codes[:, m]].astype(np.float64)
            approx, length = approx + word, length + np.linalg.norm(word, axis=1)
        slack = LOOSE * (np.linalg.norm(x, axis=1) + ratio * length)
        return np.linalg.norm(x - approx * ratio[:, None], axis=1) + slack, np.linalg.norm(x - self.books[0][codes[:, 0]], axis=1) + slack

    def looked_up(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Rows by queries: products with the sums of the rows' codewords."""
        total = np.zeros((len(codes), len(q)), np.float32)
        for m, c in enumerate(self.books):
            own, at = np.unique(codes[:, m], return_inverse=True)
            total += (c[own].astype(np.float64) @ q.T).astype(np.float32)[at]
        return total

    def probes(self, x: np.ndarray, k: int, found: float = FOUND, asked: int = 256) -> int:
        """How far apart the rows are: the least number of cells that hold ``found`` of the ``k`` nearest rows of ``x`` to its own first rows. No search depends on it."""
        q, cells = x[:asked], self.books[0]
        score = q @ x.T
        score[np.arange(len(q)), np.arange(len(q))] = -np.inf
        near = np.argpartition(-score, min(k, len(x) - 1), 1)[:, : min(k, max(len(x) - 1, 1))]
        cell = np.argmin((cells * cells).sum(1) - 2 * x @ cells.T, 1)[near]
        place = np.argsort(np.argsort(-(q @ cells.T), 1, kind="stable"), 1)
        need = np.sort(place[np.arange(len(q))[:, None], cell].ravel())
        return int(need[min(int(np.ceil(found * len(need))), len(need)) - 1]) + 1


def _matrix(column: pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, v`` of the vectors that take part."""
    kind = "array<float>" if dict(vectors.dtypes)[vec_col] == "array<float>" else "array<double>"
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("v"))
    return v.where("id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")


def packed(place: np.ndarray, rows: np.ndarray, most: int) -> list[np.ndarray]:
    """The cells at ``place`` in groups of at most ``most`` rows, or single cells; neighbours stay together."""
    todo, done = [np.arange(len(place))], []
    while todo:
        own = todo.pop()
        if len(own) == 1 or rows[own].sum() <= most:
            done.append(own)
            continue
        x = place[own].astype(np.float64)
        x = x - x.mean(0)
        along = own[np.argsort(x @ np.linalg.eigh(x.T @ x)[1][:, -1], kind="stable")]
        half = np.searchsorted(np.cumsum(rows[along]), rows[along].sum() / 2)
        half = min(max(int(half), 1), len(along) - 1)
        todo += [along[half:], along[:half]]
    return done


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every`` its ``k`` nearest other rows."""
    spark = vectors.sparkSession
    tune(spark)
    v = usable(vectors, id_col, vec_col)
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x).cast("double"))))
    kinds = v.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.col("id") % every == 0).alias("asks"), largest.alias("largest")).where("asks").orderBy("dim").collect()
    found = None
    for r in kinds:
        # codes are in single precision: very large or small numbers are scaled
        scale = 1.0 if 1e-9 < r["largest"] < 1e9 else 1 / max(r["largest"], 1e-300)
        some = _within(v.where(F.size("v") == r["dim"]), r["dim"], r["n"], scale, k, every)
        found = some if found is None else found.union(some)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _within(v: DataFrame, dim: int, n: int, scale: float, k: int, every: int) -> DataFrame:
    """The same among vectors of one length; blocks' best, not ranked yet."""
    spark, kind = v.sparkSession, dict(v.dtypes)["v"]
    sample = v.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "v").toArrow()
    small = (_matrix(sample.column(1).combine_chunks(), dim) * scale).astype(np.float32)
    index = Codebooks.fit(small, min(CELLS, max(1, round(n**0.5))))
    some, at = np.unique(sample.column(0).to_numpy()[: max(BOUND // dim, 16 * k)], return_index=True)
    shared, known = spark.sparkContext.broadcast(index), spark.sparkContext.broadcast((some, small[at]))
    books, cells = len(index.books), len(index.books[0])

    def scaled(column):
        return _matrix(column, dim) * scale

    def encoded(batches):
        for b in batches:
            x = scaled(b.column(1)).astype(np.float32)
            codes, ratio = shared.value.encode(x) if b.num_rows else (np.zeros((0, books), np.int16), np.zeros(0))
            miss, away = shared.value.missed(x, codes, ratio.astype(np.float32))
            flat = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes[:, 0].astype(np.int32)), flat, pa.array(ratio.astype(np.float32)), pa.array(miss), pa.array(away)], ["id", "v", "cell", "code", "ratio", "miss", "away"])

    rows = materialise(v.mapInArrow(encoded, f"id long, v {kind}, cell int, code binary, ratio float, miss double, away double"), "codes")
    size, radius = np.zeros(cells, np.int64), np.full(cells, -np.inf)
    for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect():
        size[r["cell"]], radius[r["cell"]] = r["n"], r["away"]
    # cells of a block, and of each cell its first block and how many it fills
    groups = packed(index.books[0], size, BLOCK)
    fills = [max(1, -(-int(size[g].sum()) // BLOCK)) for g in groups]
    first, many, begin = np.zeros(cells, np.int64), np.ones(cells, np.int64), 0
    for g, m in zip(groups, fills):
        first[g], many[g], begin = begin, m, begin + m

    def probed(batches):
        centre, (ids, x) = shared.value.books[0].astype(np.float64), known.value
        length = np.linalg.norm(x.astype(np.float64), axis=1)
        for b in batches:
            q = scaled(b.column(1))
            norm = np.linalg.norm(q, axis=1)
            least = np.full(len(q), -np.inf)
            if len(ids) > k and len(q):
                score = (q.astype(np.float32) @ x.T).astype(np.float64) - LOOSE * norm[:, None] * length
                score[b.column(0).to_numpy()[:, None] == ids] = -np.inf
                least = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
            reach = q @ centre.T + norm[:, None] * (radius + LOOSE * np.linalg.norm(centre, axis=1)) >= least[:, None]
            into = [np.concatenate([np.arange(first[g[0]], first[g[0]] + many[g[0]]) for g in groups if r[g].any()] or [np.zeros(0, np.int64)]).astype(np.int32) for r in reach & (size > 0)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(least), pa.array(into, pa.list_(pa.int32()))], ["id", "v", "least", "blocks"])

    asked = v.where(F.col("id") % every == 0).mapInArrow(probed, f"id long, v {kind}, least double, blocks array<int>").select("id", "v", "least", F.explode("blocks").alias("block"))
    asked = materialise(asked, "asked")
    hot = asked.groupBy("block").count().where(F.col("count") > ASKED).select("block", F.ceil(F.col("count") / ASKED).cast("int").alias("cuts"))
    hot = [tuple(r) for r in hot.collect()]
    in_cuts = lambda df: df.join(spark.createDataFrame(hot, "block int, cuts int"), "block", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    of = lambda values: F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("cell") + 1)
    rows = rows.withColumn("block", (of(first) + F.pmod(F.xxhash64("id"), of(many))).cast("int"))
    rows = in_cuts(rows).select("id", "v", "code", "ratio", "miss", "block", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("qb"))
    asked = in_cuts(asked).select("id", "v", "least", "block", F.pmod(F.xxhash64("id"), "cuts").cast("int").alias("qb"))

    def single(table):
        """Ids in order, their vectors, and which rows these are; equal rows once."""
        ids, x = table.column("id").to_numpy(), _matrix(table.column("v").combine_chunks(), dim)
        order = np.lexsort((*x.T[::-1], ids))
        new = np.ones(len(ids), bool)
        new[1:] = (ids[order][1:] != ids[order][:-1]) | (x[order][1:] != x[order][:-1]).any(1)
        return ids[order[new]], x[order[new]], order[new]

    def scan(key, left, right):
        out = []
        if left.num_rows and right.num_rows:
            ids, x, at = single(left)
            qid, q, own = single(right)
            codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.int16).reshape(-1, books)[at]
            ratio, miss = left.column("ratio").to_numpy()[at, None], left.column("miss").to_numpy()[at, None].astype(np.float32)
            bound, apart = right.column("least").to_numpy()[own], (ids[1:] != ids[:-1]).all()
            wide, length = (x if scale == 1 else x * scale), np.linalg.norm(x * scale, axis=1)[:, None]
            for a in range(0, len(qid), 256):
                part, asks = q[a : a + 256], qid[a : a + 256]
                least, norm = bound[a : a + 256], np.linalg.norm(part * scale, axis=1)
                may = shared.value.looked_up(part * scale, codes) * ratio + miss * norm.astype(np.float32) * np.float32(1 + LOOSE) >= least - LOOSE * np.abs(least)
                may &= ids[:, None] != asks
                near, want = np.flatnonzero(may.any(1)), may.sum(0) > 4 * k
                if want.any():
                    # many are left: products in double precision, and no more than the block's own best
                    score = np.where(may[near], wide[near] @ (part * scale).T, -np.inf)
                    slack = 1e-9 * norm * length[near]
                    if apart and len(near) > k:
                        least = np.maximum(least, np.partition(score - slack, len(near) - k, axis=0)[len(near) - k])
                    may[near] = score + slack >= least
                    may[near] &= score > -np.inf
                row, col = np.nonzero(may)
                exact = np.concatenate([np.einsum("pd,pd->p", part[col[p : p + PAIRS]], x[row[p : p + PAIRS]]) for p in range(0, len(row), PAIRS)] or [np.zeros(0)])
                if not apart:
                    # an id has its best score
                    order = np.lexsort((-exact, ids[row], col))
                    row, col, exact = row[order], col[order], exact[order]
                    new = np.ones(len(row), bool)
                    new[1:] = (ids[row][1:] != ids[row][:-1]) | (col[1:] != col[:-1])
                    row, col, exact = row[new], col[new], exact[new]
                order = np.lexsort((ids[row], -exact, col))
                row, col, exact = row[order], col[order], exact[order]
                rank = np.arange(len(col)) - np.searchsorted(col, col)
                ok = (rank < k) & (exact > -np.inf)
                out.append((asks[col[ok]], ids[row[ok]], exact[ok]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    by = ["block", "qb"]
    return rows.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(scan, "query_id long, vec_id long, score double")
