"""Removal of passages that recur anywhere in the corpus, by repeated-phrase automata.

A window is ``WIDTH`` consecutive words of one text. Every window picks its phrase: the run of ``PHRASE`` words with the
smallest hash. Equal windows pick equal phrases, so only phrases that recur need a closer look, and neighbouring
windows with one phrase form a segment. The steps:

1. cut all texts into segments and keep those whose phrase recurs (or that repeat a window in themselves);
2. confirm passages by their counts: a segment that recurs as a whole is one, of the others the windows that recur. Of
   each passage one place is kept, from which its words are taken;
3. deal the passages over shards by phrase, and compile each shard's into an Aho-Corasick automaton over words. All texts
   stream through: every segment goes to the shard of its phrase, whose automaton finds all passages in it, wherever in the corpus they
   came from. A passage found at one place only (equal hashes of unequal words) is dropped;
4. remove the words that an occurrence covers.

A shard has about ``SHARD`` segments; a phrase of more than ``HOT`` segments is dealt over several shards, each with all its passages (and there the
count of step 2 decides alone). Counts are aggregated before they are shuffled, so a passage that a third of all texts share is
never gathered in one task. Cases: null text has no words; repeated rows and texts count each time, so a text of ``WIDTH``
words or more that occurs twice loses all words, in every copy; equal rows are cut and streamed once, with their number.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm import kernel
from docweave.llm.scratch import materialise, tune

WIDTH, PHRASE = 35, 8
#: segments a shard, and segments of one phrase in a shard
SHARD, HOT = 20_000, 20_000
#: what a row of text is to a shard: to be streamed, a run of windows that are passages, a passage as a whole, or both stream and passage
STREAM, RUN, WHOLE, BOTH = 0, 1, 2, 3
TOP = np.iinfo(np.uint64).max


def cut(data: np.ndarray, offs: np.ndarray, width: int = WIDTH, phrase: int = PHRASE) -> dict[str, np.ndarray]:
    """The segments of a block of texts: owner, first word, number of windows, hashes of phrase and segment, whether a window
    repeats inside; and ``window``, all windows' hashes, with each segment's first one."""
    t = kernel.Tokens(data, offs)
    window, at = kernel.windows(t, width)
    none = {k: np.zeros(0, np.int64) for k in ("owner", "pos", "n", "phrase", "segment", "from")} | {"inner": np.zeros(0, bool), "window": window}
    if not len(window):
        return none
    low = np.full(len(t.hash), TOP, np.uint64)
    h, first = kernel.windows(t, phrase)
    low[first] = h
    span, want = 1, width - phrase + 1
    while span * 2 <= want:
        low[:-span] = np.minimum(low[:-span], low[span:])
        span *= 2
    if want > span:
        low[: span - want] = np.minimum(low[: span - want], low[want - span :])
    low, owner = low[at], t.owner()[at]
    new = np.concatenate(([True], (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])))
    begin = np.flatnonzero(new)
    n = np.diff(np.concatenate((begin, [len(window)])))
    up, down = kernel._power(len(t.hash) + 1)
    sums = np.zeros(len(t.hash) + 1, np.uint64)
    np.cumsum(t.hash * up[: len(t.hash)], out=sums[1:])
    p = at[begin]
    segment = kernel.mix((sums[p + n + width - 1] - sums[p]) * down[p] + n.astype(np.uint64))
    of = np.repeat(np.arange(len(begin)), n)
    order = np.argsort(window, kind="stable")
    same = (window[order][1:] == window[order][:-1]) & (of[order][1:] == of[order][:-1])
    inner = np.zeros(len(begin), bool)
    inner[of[order][1:][same]] = True
    return {"owner": owner[begin], "pos": p - t.offs[owner[begin]], "n": n, "phrase": low[begin].view(np.int64), "segment": segment.view(np.int64), "inner": inner, "window": window, "from": begin}


def _segments(batches):
    for b in batches:
        data, offs = kernel.column_bytes(b.column(1))
        for i, j in kernel.blocks(offs):
            s = cut(data, offs[i : j + 1])
            key = b.column(0)[i:j].take(pa.array(s["owner"]))
            yield pa.RecordBatch.from_arrays([key, pa.array(s["pos"].astype(np.int32)), pa.array(s["n"].astype(np.int32)), pa.array(s["phrase"]), pa.array(s["segment"]), pa.array(s["inner"])], ["key", "pos", "n", "phrase", "segment", "inner"])


def _single_windows(batches):
    """Windows of the segments asked for: ``ask`` has first words, ``rep`` whether the segment stands for many copies."""
    for b in batches:
        data, offs = kernel.column_bytes(b.column(1))
        for i, j in kernel.blocks(offs):
            s = cut(data, offs[i : j + 1])
            owner = s["owner"] << 32 | s["pos"]
            ask = [(r << 32 | x["pos"], x["rep"]) for r, row in enumerate(b.column(2)[i:j].to_pylist()) for x in row]
            want, rep = np.array([a for a, _ in ask], np.int64), np.array([r for _, r in ask], bool)
            at = np.searchsorted(owner, want)
            n = s["n"][at]
            start = np.repeat(np.cumsum(n) - n, n)
            step = np.arange(int(n.sum())) - start
            w = s["window"][np.repeat(s["from"][at], n) + step]
            key = b.column(0)[i:j].take(pa.array(np.repeat(want >> 32, n)))
            cols = [key, pa.array((np.repeat(want & 0xFFFFFFFF, n) + step).astype(np.int32)), pa.array(np.repeat(s["phrase"][at], n)), pa.array(w.view(np.int64)), pa.array(np.repeat(rep, n))]
            yield pa.RecordBatch.from_arrays(cols, ["key", "pos", "phrase", "window", "rep"])


def _pieces(batches):
    """The words of each place asked for; windows side by side come as one run."""
    names = ["phrase", "key", "pos", "copies", "kind", "text"]
    for b in batches:
        for key, text, copies, ask in zip(*(c.to_pylist() for c in b.columns)):
            words = text.encode().split()
            rows: dict[tuple[int, int, int], int] = {}
            run = None
            for x in sorted(ask, key=lambda x: (x["kind"] != RUN, x["phrase"], x["pos"])):
                place = x["phrase"], x["pos"], x["n"]
                if x["kind"] != RUN:
                    rows[place] = BOTH if place in rows else x["kind"]
                elif run and run[0] == x["phrase"] and run[1] + run[2] == x["pos"]:
                    run[2] += 1
                else:
                    if run:
                        rows[(*run, RUN)] = RUN
                    run = list(place)
            if run:
                rows[(*run, RUN)] = RUN
            cols = list(zip(*((p[0], p[1], kind, b" ".join(words[p[1] : p[1] + p[2] + WIDTH - 1]).decode()) for p, kind in rows.items())))
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array([key] * n, pa.int64()), pa.array(cols[1], pa.int32()), pa.array([copies] * n, pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], names
            )


class Shard:
    """An automaton over the words of passages."""

    def __init__(self, passages: list[tuple[int, str]], width: int = WIDTH):
        self.ids: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        sizes: list[int] = []
        for kind, text in passages:
            seq = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in text.split(" "))
            for one in (seq[i : i + width] for i in range(len(seq) - width + 1)) if kind == RUN else (seq,):
                if not self.automaton.exists(one):
                    self.automaton.add_word(one, len(sizes))
                    sizes.append(len(one))
        self.sizes = np.array(sizes, np.int64)
        if sizes:
            self.automaton.make_automaton()

    def find(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The passages in a text: their numbers, and the places of their last words."""
        get = self.ids.get
        hits = list(self.automaton.iter(tuple([get(w, 0) for w in text.split(" ")])))
        return np.array([i for _, i in hits], np.int64), np.array([e for e, _ in hits], np.int64)


def locate(shard: pa.Table) -> pa.Table:
    """``key, pos, n``: the stretches of words that passages of the shard cover in its segments."""
    kind, key, pos, copies, text = (shard.column(c).to_pylist() for c in ("kind", "key", "pos", "copies", "text"))
    known = Shard([(k, t) for k, t in zip(kind, text) if k != STREAM])
    out: list[tuple[int, int, int]] = []
    if len(known.sizes):
        found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        # a phrase of several shards has its passages everywhere, but only some of its segments here
        times = np.full(len(known.sizes), 2 if any(shard.column("dealt").to_pylist()) else 0, np.int64)
        rows = [r for r, k in enumerate(kind) if k in (STREAM, BOTH)]
        for r in rows:
            hits = found.get(text[r])
            if hits is None:
                hits = found[text[r]] = known.find(text[r])
            np.add.at(times, hits[0], copies[r])
        covered: dict[str, list[tuple[int, int]]] = {}
        for t, (which, last) in found.items():
            good = times[which] > 1
            merged: list[list[int]] = []
            ends = last[good] + 1
            starts = ends - known.sizes[which[good]]
            order = np.argsort(starts, kind="stable")
            for a, z in zip(starts[order].tolist(), ends[order].tolist()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], z)
                else:
                    merged.append([a, z])
            covered[t] = [(a, z - a) for a, z in merged]
        out = [(key[r], pos[r] + a, n) for r in rows for a, n in covered[text[r]]]
    cols = list(zip(*out)) or [[], [], []]
    return pa.table({"key": pa.array(cols[0], pa.int64()), "pos": pa.array(cols[1], pa.int32()), "n": pa.array(cols[2], pa.int32())})


def _removed(batches):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    for b in batches:
        n_words, n_removed, digests, kept = [], [], [], []
        for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            words = (text or "").encode().split()
            n_words.append(len(words))
            if found:
                edge = np.zeros(len(words) + 1, np.int64)
                for x in found:
                    edge[x["pos"]] += 1
                    edge[x["pos"] + x["n"]] -= 1
                words = list(compress(words, (np.cumsum(edge)[:-1] == 0).tolist()))
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
            digests.append(hashlib.sha256(kept[-1]).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], names)


def confirmed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments that may hold a passage, and one place of each passage: ``key, pos, n, phrase``, passages with their ``kind``."""
    every = materialise(docs.mapInArrow(_segments, "key long, pos int, n int, phrase long, segment long, inner boolean"), "segments")
    often = every.groupBy("phrase").agg(F.count("*").alias("times"), F.max("inner").alias("any_inner")).where("times > 1 or any_inner").select("phrase")
    some = materialise(every.join(often, "phrase", "left_semi"), "recurring")
    kinds = some.groupBy("phrase", "segment").agg(F.count("*").alias("copies"), F.min(F.struct("key", "pos", "n")).alias("rep"), F.max("inner").alias("inner"))
    kinds = materialise(kinds, "kinds")
    whole = kinds.where("copies > 1").select("rep.key", "rep.pos", "rep.n", "phrase", F.lit(WHOLE).alias("kind"))
    # phrases with segments that don't recur as a whole: those, and one copy of each segment that does
    lone = kinds.where("copies = 1").groupBy("phrase").agg(F.count("*").alias("lone"), F.max("inner").alias("lone_inner"))
    kinds_of = kinds.groupBy("phrase").agg(F.count("*").alias("kinds"))
    open_ = lone.join(kinds_of, "phrase").where("kinds > 1 or lone_inner").select("phrase")
    ask = kinds.join(open_, "phrase", "left_semi").select(F.col("rep.key").alias("_key"), F.struct(F.col("rep.pos").alias("pos"), (F.col("copies") > 1).alias("rep")).alias("ask"))
    single = _asked(docs, ask).select("key", "text", "ask").mapInArrow(_single_windows, "key long, pos int, phrase long, window long, rep boolean")
    # a window that only segments of copies have is in their passage
    twice = single.groupBy("window").agg(F.count("*").alias("times"), F.min("rep").alias("rep"), F.min(F.struct("key", "pos", "phrase")).alias("at")).where("times > 1 and not rep")
    windows = twice.select("at.key", "at.pos", F.lit(1).alias("n"), "at.phrase", F.lit(RUN).alias("kind"))
    return some.select("key", "pos", "n", "phrase"), materialise(whole.union(windows), "passages")


def _asked(docs: DataFrame, ask: DataFrame) -> DataFrame:
    """``key, text, copies, ask``: the texts asked for, equal rows once and with their number."""
    ask = ask.groupBy("_key").agg(F.collect_set("ask").alias("ask"))
    # rows that share a key share id and text
    got = docs.join(ask, docs.key == ask._key).groupBy("key").agg(F.min("text").alias("text"), F.count("*").alias("copies"), F.first("ask").alias("ask"))
    return got


def stretches(docs: DataFrame, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """``key`` (a hash of id and text) and what is ``found`` there: arrays of (first word, number of words)."""
    some, passages = confirmed(docs)
    streams = some.join(passages.select("phrase").distinct(), "phrase", "left_semi").select("key", "pos", "n", "phrase", F.lit(STREAM).alias("kind"))
    ask = streams.union(passages.select(*streams.columns)).select(F.col("key").alias("_key"), F.struct("pos", "n", "phrase", "kind").alias("ask"))
    rows = _asked(docs, ask).select("key", "text", "copies", "ask").mapInArrow(_pieces, "phrase long, key long, pos int, copies long, kind int, text string")
    rows = materialise(rows, "pieces")
    streamed = F.col("kind").isin(STREAM, BOTH)
    size = rows.where(streamed).groupBy("phrase").agg(F.count("*").alias("size"))
    parts = -(-rows.where(streamed).count() // shard)
    large = size.where(F.col("size") > hot).select(F.col("phrase").alias("_phrase"), F.ceil(F.col("size") / hot).cast("int").alias("parts"))
    rows = rows.join(large, rows.phrase == F.col("_phrase"), "left").withColumn("dealt", F.col("parts").isNotNull()).withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("key", "pos"), F.col("parts")).cast("int")
    # segments go to one part of their phrase, passages to all
    part = F.when(F.col("kind").isin(STREAM), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("own", own).withColumn("part", F.explode(part))
    rows = rows.withColumn("kind", F.when((F.col("kind") == BOTH) & (F.col("part") != F.col("own")), WHOLE).otherwise(F.col("kind")))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("phrase", "part"), F.lit(max(parts, 1))))
    found = rows.select("shard", "dealt", "kind", "key", "pos", "copies", "text").groupBy("shard").applyInArrow(locate, "key long, pos int, n int")
    return found.groupBy("key").agg(F.collect_list(F.struct("pos", "n")).alias("found"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and ``kept``, the words that stay joined by single spaces."""
    tune(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    found = materialise(stretches(docs.select("key", "text")), "stretches").withColumnRenamed("key", "_key")
    rows = docs.join(found, docs.key == found._key, "left").select("doc_id", "text", "found")
    return rows.mapInArrow(_removed, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
