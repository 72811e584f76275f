"""A hidden Markov language model over whole documents.

Training texts give exact corpus-wide word counts (words lower-cased in A-Z, split at ASCII white space, one end token a
text). The ``HEAD`` most frequent words are symbols of their own; every other word belongs to one of ``SHAPES`` rest
symbols, picked by its bytes' shape, and has within it an add-one probability from its own count. So a word's
emission is ``b(symbol) * q(word | symbol)``, which sums to one over all words and an unknown one.

Baum-Welch runs over all training texts, each as a whole: partitions emit expected counts of one E-step, aggregated by symbol. Texts
lie in rows of an array that all advance together. A text too long for a row goes on in the next one, which takes over its forward message
and gives back its backward message, and is run again until these no longer move, so every text has the counts of one pass from its start to its
end. Rounds stop when the log probability of the training texts hardly grows. Texts are then scored by the scaled forward recursion, exactly and over
their whole length.

Words are told apart by 64-bit hashes. Counts of the ``LOOKUP`` most frequent words are shipped to every task (a fixed
bound); rarer words, none of which can be hot, are joined by hash.

Cases: null text counts as empty and is one end token. Repeated rows count each time. An empty training set gives the
uniform model over unknown words; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm import kernel
from docweave.llm.linear import bucket_of
from docweave.llm.scratch import materialise, tune

FOLDS, HELD_OUT = 7, 2
STATES, HEAD, LOOKUP = 8, 16_384, 262_144
#: most Baum-Welch rounds, and the gain in log probability, as a share of it, below which they stop
ROUNDS, GAIN = 6, 1e-3
SHAPES, END_HASH = 24, 0x6A09E667F3BCC909
#: tokens in one row of an array and rows in one numpy step, texts that are cut into rows, and tokens sorted by their texts' length at once; messages
#: between rows are exact up to ``SAME``
CHUNK, ROWS, LONG, GROUP, SAME = 512, 512, 4096, 4_000_000, 1e-13
LOG10 = math.log(10)


def shapes(t: kernel.Tokens) -> np.ndarray:
    """A symbol from 0 to ``SHAPES`` - 1 for each word: non-ASCII or not, how its last byte is classed, and its length."""
    high = np.concatenate(([0], np.cumsum(t.data >= 128)))
    foreign = (high[t.end] > high[t.start]).astype(np.int64)
    last = t.data[t.end - 1]
    ending = np.where((last >= 48) & (last <= 57), 1, np.where(kernel.CLASS[last] == 2, 2, 0))
    size = np.minimum((t.end - t.start) // 4, 3)
    return (foreign * 3 + ending) * 4 + size


def _counts(docs: DataFrame) -> DataFrame:
    """``h, c, shape`` of every distinct training word, the end token among them (shape -1)."""

    def run(batches):
        for b in batches:
            data, offs = kernel.column_bytes(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([np.uint64(END_HASH).view(np.int64)]), pa.array([b.num_rows]), pa.array([-1], pa.int32())], ["h", "c", "shape"])
            for i, j in kernel.blocks(offs):
                t = kernel.Tokens(data, offs[i : j + 1], lower=True)
                h, first, c = np.unique(t.hash, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c), pa.array(shapes(t)[first].astype(np.int32))], ["h", "c", "shape"])

    return docs.select("text").mapInArrow(run, "h long, c long, shape int").groupBy("h").agg(F.sum("c").alias("c"), F.min("shape").alias("shape"))


class Lexicon:
    """The bounded part of the counts: totals, and the most frequent words' hashes, counts and symbols."""

    def __init__(self, counts: DataFrame, head: int, lookup: int):
        words = counts.where("shape >= 0")
        # the smallest count, in steps of a 64th of a power of e, that at most ``lookup`` words reach
        level = F.floor(F.log("c") * 64)
        least = None
        for r in words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
            lookup -= r["count"]
            if lookup < 0:
                break
            least = r["level"]
        got = words.where(level >= least if least is not None else F.lit(False)).orderBy(F.desc("c"), "h").toPandas()
        h, c, shape = (got[k].to_numpy(np.int64) for k in ("h", "c", "shape"))
        self.head = min(head, len(h))
        symbol = np.where(np.arange(len(h)) < self.head, np.arange(len(h)), self.head + shape)
        total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.expr("if(shape < 0, c, 0)")).alias("ends")).first()
        self.n, self.v, self.ends = int(total["n"] or 0), int(total["v"]), int(total["ends"] or 0)
        rest_n, rest_v = np.zeros(SHAPES), np.zeros(SHAPES)
        for r in counts.where("shape >= 0").groupBy("shape").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
            rest_n[r["shape"]], rest_v[r["shape"]] = r["n"], r["v"]
        np.subtract.at(rest_n, shape[: self.head], c[: self.head])
        np.subtract.at(rest_v, shape[: self.head], 1)
        self.rest = np.log10(rest_n + rest_v + 1)
        #: head words, shapes, end of text
        self.symbols = self.head + SHAPES + 1
        order = np.argsort(h)
        self.h, self.c, self.symbol = h[order], c[order], symbol[order]
        self.base = math.log10(self.n + (self.v + 1))

    def base_log(self, c: np.ndarray) -> np.ndarray:
        return np.log10(c + 1.0) - self.base


def _encode(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """One row a document: its symbols, what the shipped counts tell of its score, and the words left to join."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches):
        x = shared.value
        for b in batches:
            data, offs = kernel.column_bytes(b.column(2))
            for i, j in kernel.blocks(offs):
                t = kernel.Tokens(data, offs[i : j + 1], lower=True)
                n, owner = j - i, t.owner()
                words = np.diff(t.offs)
                h = t.hash.view(np.int64)
                at = np.minimum(np.searchsorted(x.h, h), max(len(x.h) - 1, 0))
                known = x.h[at] == h if len(x.h) else np.zeros(len(h), bool)
                shape = shapes(t)
                c = np.where(known, x.c[at], 0) if len(x.h) else np.zeros(len(h), np.int64)
                symbol = np.where(known, x.symbol[at], x.head + shape) if len(x.h) else x.head + shape
                base = np.bincount(owner, np.where(known, x.base_log(c), 0.0), n) + x.base_log(np.array([x.ends]))
                rest = known & (symbol >= x.head)
                q = np.bincount(owner, np.where(rest, np.log10(c + 1.0) - x.rest[shape], 0.0), n)
                n_known = np.bincount(owner[known], minlength=n) + (x.ends > 0)
                # the end token follows each text's words
                full = np.empty(len(symbol) + n, np.uint16)
                ends = t.offs[1:] + np.arange(n)
                full[ends] = x.symbols - 1
                full[np.arange(len(symbol)) + owner] = symbol
                cut = np.concatenate(([0], ends + 1)).tolist()
                left = ~known
                lh, ls, lo = h[left], shape[left].astype(np.int8), np.searchsorted(owner[left], np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0)[i:j],
                        b.column(1)[i:j],
                        pa.array(words + 1),
                        pa.array(n_known.astype(np.int64)),
                        pa.array(base, pa.float64()),
                        pa.array(q, pa.float64()),
                        pa.array([full[p:s].tobytes() for p, s in zip(cut, cut[1:])], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(lo), pa.array(lh)),
                        pa.ListArray.from_arrays(pa.array(lo), pa.array(ls)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base", "q", "symbols", "left_h", "left_shape"],
                )

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, q double, symbols binary, left_h array<long>, left_shape array<byte>")


def _binary_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = kernel.column_bytes(column)
    return data[offs[0] : offs[-1]].view(np.uint16), (offs - offs[0]) // 2


def _layouts(symbols: np.ndarray, offs: np.ndarray, fill: int):
    """Tokens in rows that advance together, as (symbol, whether a text starts) by place and row. Texts of up to ``LONG`` tokens of like length lie whole in rows;
    longer ones, one after the other, in rows of ``CHUNK``."""
    size = np.diff(offs)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    n_long = int(np.searchsorted(-size[order], -LONG, "left"))

    def cut(chosen):
        """Groups of at most ``CHUNK * ROWS`` tokens; a longer text is a group of its own."""
        ends = np.concatenate(([0], np.cumsum(size[chosen])))
        for i, j in kernel.blocks(ends, CHUNK * ROWS):
            yield chosen[i:j]

    for group in cut(order[:n_long]):
        seq = np.concatenate([symbols[offs[i] : offs[i + 1]] for i in group])
        n = -(-len(seq) // CHUNK)
        sym, new = np.full(n * CHUNK, fill, np.int32), np.zeros(n * CHUNK, bool)
        sym[: len(seq)] = seq
        new[np.concatenate(([0], np.cumsum(size[group])))[:-1]] = new[len(seq) :] = True
        yield np.ascontiguousarray(sym.reshape(n, CHUNK).T), np.ascontiguousarray(new.reshape(n, CHUNK).T)
    for group in cut(order[n_long:]):
        long = max(int(size[group[0]]), CHUNK)
        rows, at = [], long
        for i in group.tolist():
            if at + size[i] > long:
                rows.append([])
                at = 0
            rows[-1].append((at, i))
            at += size[i]
        sym, new = np.full((long, len(rows)), fill, np.int32), np.zeros((long, len(rows)), bool)
        for r, row in enumerate(rows):
            for at, i in row:
                sym[at : at + size[i], r] = symbols[offs[i] : offs[i + 1]]
                new[at, r] = True
        yield sym, new | (sym == fill)


class Model:
    """Start, transition and emission probabilities; ``emit`` has a row a symbol."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def first(weights: np.ndarray, states: int, seed: int = 11) -> Model:
        rng = np.random.default_rng(seed)
        emit = (weights[:, None] + 1e-3) * np.exp(rng.normal(0, 0.5, (len(weights), states)))
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return Model(np.full(states, 1 / states), move, emit / emit.sum(0))

    def expected(self, symbols: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of starts, transitions and emissions over whole texts, and the texts' log probability."""
        k, size = len(self.start), len(self.emit)
        total = [np.zeros(k), np.zeros((k, k)), np.zeros((size, k)), 0.0]
        # symbol ``size`` fills rows up; every state emits it, and it follows no other token
        table = np.ascontiguousarray(np.vstack((self.emit, np.ones(k))).T)
        for sym, new in _layouts(symbols, offs, size):
            for n, part in enumerate(self._counts(table, sym, new)):
                total[n] = total[n] + part
        return total[0], total[1] * self.move, total[2], total[3]

    def _counts(self, table: np.ndarray, sym: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """The same of tokens in rows that advance together: ``sym`` and whether a text starts, by place and row. A row whose first token starts no text goes on
        where the row before it ended. Transitions aren't multiplied by their probability yet."""
        k, size, (long, n) = len(self.start), table.shape[1] - 1, sym.shape
        back, onward = self.move, np.ascontiguousarray(self.move.T)
        some = frozenset(np.flatnonzero(new.any(1)).tolist())
        seen = np.empty((long, k, n))
        for s in range(k):
            np.take(table[s], sym, out=seen[:, s], mode="clip")
        alpha, scale = np.empty((long, k, n)), np.empty((long, n))

        def forward(rows, entry):
            now = entry
            for t in range(long):
                prior = onward @ now
                if t in some:
                    prior = np.where(new[t] if rows is None else new[t, rows], self.start[:, None], prior)
                if rows is None:
                    now = np.multiply(prior, seen[t], out=alpha[t])
                    c = np.add.reduce(now, 0, out=scale[t])
                    now /= c
                else:
                    now = prior * seen[t][:, rows]
                    c = now.sum(0)
                    now /= c
                    alpha[t][:, rows], scale[t, rows] = now, c

        def messages(rows, beta):
            """What rows tell the row before them."""
            pick = (lambda x: x) if rows is None else (lambda x: x[..., rows])
            for t in range(long - 1, -1, -1):
                beta = back @ (pick(seen[t]) * beta * pick(inverse[t]))
                if t in some:
                    beta = np.where(pick(new[t]), 1.0, beta)
            return beta

        # every row starts from the end of the row before it; rows are run again until no row's start moves
        entry = np.repeat(self.start[:, None], n, 1)
        forward(None, entry)
        while True:
            following = np.concatenate((self.start[:, None], alpha[-1][:, :-1]), 1)
            rows = np.flatnonzero((np.abs(following - entry).max(0) > SAME) & ~new[0])
            entry = following
            if not len(rows):
                break
            forward(rows, entry[:, rows])
        inverse = 1 / scale
        # likewise from the end; a text's last token has nothing after it
        leave = np.ones((k, n))
        if not new[0].all():
            first = messages(None, leave)
            while True:
                before = np.concatenate((first[:, 1:], np.ones((k, 1))), 1)
                rows = np.flatnonzero(np.abs(before - leave).max(0) > SAME * np.maximum(before.max(0), 1))
                leave = before
                if not len(rows):
                    break
                first[:, rows] = messages(rows, leave[:, rows])
        starts, moves, emits, beta = np.zeros(k), np.zeros((k, k)), np.empty((size, k)), leave
        for t in range(long - 1, -1, -1):
            ahead = seen[t] * beta
            ahead *= inverse[t]
            alpha[t] *= beta
            if t in some:
                starts += alpha[t][:, new[t] & (sym[t] < size)].sum(1)
                ahead[:, new[t]] = 0.0
            moves += (alpha[t - 1] if t else entry) @ ahead.T
            beta = back @ ahead
            if t in some:
                beta[:, new[t]] = 1.0
        flat = sym.ravel()
        for s in range(k):
            emits[:, s] = np.bincount(flat, alpha[:, s].ravel(), size + 1)[:size]
        return starts, moves, emits, float(np.log(scale).sum())

    def log10(self, symbols: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Each text's exact log10 probability, by the scaled forward recursion; texts advance together, longest first."""
        size = np.diff(offs)
        order = np.argsort(-size, kind="stable")
        out, at, size = np.zeros(len(size)), offs[:-1][order], size[order]
        active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
        alpha = np.broadcast_to(self.start, (len(size), len(self.start)))
        total = np.zeros(len(size))
        for t, m in enumerate(active.tolist()):
            now = (alpha[:m] if t == 0 else alpha[:m] @ self.move) * self.emit[symbols[at[:m] + t]]
            scale = now.sum(1)
            alpha = now / scale[:, None]
            total[:m] += np.log(scale)
        out[order] = total / LOG10
        return out


def _grouped(batches):
    """The texts of about ``GROUP`` tokens at a time."""
    parts, held = [], 0
    for b in batches:
        symbols, offs = _binary_column(b.column(0))
        if len(symbols):
            parts.append((symbols, offs))
            held += len(symbols)
        if held > GROUP:
            yield _joined(parts)
            parts, held = [], 0
    if parts:
        yield _joined(parts)


def _joined(parts):
    starts = np.cumsum([0] + [len(s) for s, _ in parts])
    return np.concatenate([s for s, _ in parts]), np.concatenate([o[:-1] + a for (_, o), a in zip(parts, starts)] + [starts[-1:]])


def _e_step(encoded: DataFrame, model: Model, states: int) -> tuple[Model, float]:
    """One Baum-Welch round over all training rows of ``encoded``: the new model, and the log probability of the texts by the old one."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    k, size = states, len(model.emit)

    def run(batches):
        starts, moves, emits, logs, any_row = np.zeros(k), np.zeros((k, k)), np.zeros((size, k)), np.zeros(k), False
        for symbols, offs in _grouped(batches):
            any_row = True
            for total, part in zip((starts, moves, emits, logs), shared.value.expected(symbols, offs)):
                total += part
        if any_row:
            # rows 0 to size - 1 are symbols, then come the starts, the transitions and the log probability
            rows = np.vstack((emits, starts[None], moves, logs[None]))
            some = np.flatnonzero(rows.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(rows[some, s]) for s in range(k)]], ["row", *[f"s{s}" for s in range(k)]])

    counts = encoded.where("not held_out").select("symbols").mapInArrow(run, "row int, " + ", ".join(f"s{s} double" for s in range(k)))
    got = counts.groupBy("row").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(k)]).toPandas()
    rows = np.zeros((size + 2 + k, k))
    rows[got["row"].to_numpy(np.int64)] = got[[f"s{s}" for s in range(k)]].to_numpy()
    emit = rows[:size] + 1e-2 * (model.emit.mean(1, keepdims=True) * size) + 1e-6
    start, move = rows[size] + 1e-3, rows[size + 1 : size + 1 + k] + 1e-3
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)), float(rows[-1, 0])


def score(docs: DataFrame, states: int = STATES, head: int = HEAD, lookup: int = LOOKUP, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every document."""
    tune(docs.sparkSession)
    held = F.coalesce(bucket_of("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    counts = materialise(_counts(docs.where("not held_out")), "words")
    lex = Lexicon(counts, head, lookup)
    # rows are told apart by a number of their own, as ids may repeat
    encoded = materialise(_encode(docs, lex).withColumn("row", F.monotonically_increasing_id()), "symbols")
    # the start: each symbol's share of the training tokens
    weights = np.ones(lex.symbols)
    head_words = lex.symbol < lex.head
    weights[lex.symbol[head_words]] = lex.c[head_words]
    weights[lex.head : lex.head + SHAPES] = 10**lex.rest
    weights[-1] = lex.ends
    model = Model.first(weights / weights.sum(), states)
    before = None
    for _ in range(rounds if lex.n else 0):
        model, logs = _e_step(encoded, model, states)
        if before is not None and logs - before < GAIN * abs(before):
            break
        before = logs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            logs = shared.value.log10(*_joined([_binary_column(b.column(0)) for b in held]))
            at = 0
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(logs[at : at + b.num_rows])], [*b.schema.names[1:], "hmm"])
                at += b.num_rows
            held.clear()

        n = 0
        for b in batches:
            held.append(b)
            n += b.column(0).nbytes // 2
            if n > GROUP:
                yield from flush()
                n = 0
        if held:
            yield from flush()

    own = encoded.select("symbols", "row", "doc_id", "held_out", "n_tokens", "n_known", "base", "q")
    scored = own.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, q double, hmm double")
    left = encoded.select("row", F.explode(F.arrays_zip("left_h", "left_shape")).alias("x")).select("row", F.col("x.left_h").alias("h"), F.col("x.left_shape").cast("int").alias("shape"))
    joined = left.join(counts.select(F.col("h").alias("_h"), "c"), F.col("h") == F.col("_h"), "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rest = F.array(*[F.lit(float(x)) for x in lex.rest])
    tail = joined.groupBy("row").agg(
        F.sum(F.log10(F.col("c") + 1.0) - lex.base).alias("base"),
        F.sum(F.log10(F.col("c") + 1.0) - rest[F.col("shape")]).alias("q"),
        F.sum((F.col("c") > 0).cast("long")).alias("n_known"),
    )
    t = tail.select(F.col("row").alias("_row"), F.col("base").alias("_base"), F.col("q").alias("_q"), F.col("n_known").alias("_known"))
    return scored.join(t, scored.row == F.col("_row"), "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(lex.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        (F.col("hmm") + F.col("q") + F.coalesce("_q", F.lit(0.0))).alias("score"),
    )
