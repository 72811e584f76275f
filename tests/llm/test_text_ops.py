"""Operators on documents against brute force, and their edge cases."""

import hashlib
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from docweave.llm import components, hmm, leaks, linear, mixing, passages, pii, quality, queries, shingles, simhash

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: columns whose names the operators use inside
CLASH = ["_kept", "_gone", "_found", "_spans", "_id", "_key", "key", "fp", "p", "found", "row", "h"]
ODD = [(1, None), (2, ""), (3, ""), (4, " \n\t"), (5, "one"), (6, "One"), (None, "no id at all"), (7, "ünïcode 日本 " * 3), (8, "word " * 60_000)]


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{D}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], SCHEMA).withColumns({c: F.lit(1) for c in CLASH})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, None, None), (5, 0, 1), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# PII


def luhn(digits):
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if ok(m.group())]
    return out


TRICKY = ["a@b.c_d@e.f x@y@z.com .@a.b", "1.2.3.4.5.6.7.8 256.1.1.1 999999999999.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 0000000000000", "+1 (202) 555-0100 +1 +49.30.1234567", "é+1 202 555 0100 é@b.co 日本 a@b.co", "9" * 5000, "1 " * 5000, "a@" * 3000]


def test_pii_base_spans(spark, docs):
    texts = [(d["doc_id"], d["text"]) for d in docs] + [(10_000 + k, t) for k, t in enumerate(TRICKY)]
    got = by_id(pii.report(spark.createDataFrame(texts, "doc_id long, text string")))
    for i, t in texts:
        want = base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in want).encode()).hexdigest(), t[:200]
        n = Counter(k for k, _, _ in want)
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [n[k] for k in pii.BASE]
        assert {f"{k}:{a}:{z}" for k, a, z in want} <= set(got[i]["spans"].split(","))


def test_pii_added_kinds_and_redaction(spark, odd, empty):
    df = spark.createDataFrame([(1, "IBAN DE89 3704 0044 0532 0130 00 and ssn 123-45-6789, not 987-65-4321; mail a@b.co"), (2, "code 123-45-6789 DE89 3704 0044 0532 0130 01")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert got[1] == "IBAN [IBAN] and ssn [SSN], not 987-65-4321; mail [EMAIL]"
    assert got[2] == "code 123-45-6789 DE89 3704 0044 0532 0130 01"
    red = pii.redact(odd)
    assert red.columns == odd.columns and red.count() == len(ODD) and by_id(red)[1]["text"] is None
    assert pii.report(empty).count() == 0 and pii.report(odd).count() == len(ODD)


def test_pii_card_of_lone_digits(spark):
    texts = [(1, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"), (2, "pay 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1 now"), (3, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 2")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = by_id(pii.report(df))
    for i, t in texts:
        want = base_spans(t)
        assert got[i]["n_card"] == len(want) == (i < 3)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in want).encode()).hexdigest()
    red = by_id(pii.redact(df))
    assert [red[i]["text"] for i in (1, 2, 3)] == ["[CARD]", "pay [CARD] now", texts[2][1]]


def test_pii_many_spans(spark):
    """Thousands of spans in a text: places and redaction stay right, and near linear."""
    rng = np.random.default_rng(9)
    words = [f"u{k}@mail{k % 7}.org" if rng.random() < 0.6 else ["+1 202 555 0100", "日本", "10.0.0.1", "w" * int(rng.integers(1, 30))][rng.integers(4)] for k in range(12_000)]
    text = "; ".join(words)
    df = spark.createDataFrame([(1, text), (2, text[:1000])], "doc_id long, text string")
    began = time.time()
    got = by_id(pii.report(df))
    for i, t in ((1, text), (2, text[:1000])):
        want = base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in want).encode()).hexdigest()
    plain, at = [], 0
    for kind, a, z in sorted(base_spans(text), key=lambda x: (x[1], -x[2])):
        if a >= at:
            plain += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, z)
    assert by_id(pii.redact(df))[1]["text"] == "".join(plain) + text[at:]
    assert time.time() - began < 60


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    cur = con.execute(queries.ORACLE[name])
    names = [c[0] for c in cur.description]
    got = queries.QUERIES[name](spark, D)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cur.fetchall())


# SimHash


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(fps, radius=3):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_classes(spark, docs):
    fps = {d["doc_id"]: fingerprint(d["text"]) for d in docs}
    got = by_id(queries.op7_simhash(spark, D))
    want = classes(fps)
    for i, f in fps.items():
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{f:016x}", want[i])


def test_trie_walk_loses_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = [int(b) for b in base]
    for _ in range(160):
        x = fp[rng.integers(len(fp))]
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            x ^= 1 << int(b)
        fp.append(x)
    fps = {i: f for i, f in enumerate(dict.fromkeys(fp))}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in fps.items()], "fp long, rep long")
    for hot in (1 << 16, 2):  # the second splits every bucket anew
        root = {i: i for i in fps}
        for r in simhash.links(df, hot=hot).collect():
            a, b = r["a"], r["b"]
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        assert {i: find(i) for i in fps} == classes(fps)


def test_simhash_edges(odd, empty):
    got = by_id(simhash.near_duplicates(odd))
    assert got[1]["component_id"] == got[4]["component_id"] == 1 and got[1]["fingerprint"] == "0" * 16
    assert got[5]["component_id"] == got[6]["component_id"] == 5 and got[None]["component_id"] is None
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and set(by_id(kept)) == {1, 5, 7, 8, None}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def grams(text, width=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def similar_groups(texts):
    sets = {i: grams(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_copies_are_complete(spark, docs, monkeypatch):
    rng = np.random.default_rng(4)
    texts = {d["doc_id"]: d["text"] for d in docs}
    for k in range(30):
        words = [f"w{x}" for x in rng.integers(0, 500, rng.integers(5, 160))]
        for copy in range(5):  # chains: each copy is made of the last one
            texts[10_000 + 10 * k + copy] = " ".join(words)
            words = list(words)
            for at in rng.choice(len(words), min(len(words), 1 + copy % 3), replace=False):
                words[at] = f"new{rng.integers(500)}"
    line = " ".join(f"common{k}" for k in range(30))
    texts |= {20_000 + k: f"{line} a{k}" + (" b c" if k % 2 else "") for k in range(40)}
    texts |= {30_000: "", 30_001: None, 30_002: "one two", 30_003: "One  two", 30_004: "one two three"}
    want = similar_groups(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for share in (64, 1):  # the second puts common shingles last
        monkeypatch.setattr(shingles, "SHARE", share)
        assert {r["id"]: r["root"] for r in shingles.copies(df).collect()} == want
    assert set(by_id(simhash.keep_one(df))) == {i for i, r in want.items() if i == r}


def test_stage_walks_the_tries(spark, docs, monkeypatch):
    rng = np.random.default_rng(9)
    texts = {d["doc_id"]: d["text"] for d in docs}
    for k in range(40):  # long texts with one changed word: fingerprints a few bits apart
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        texts[40_000 + 2 * k] = " ".join(words)
        words[int(rng.integers(300))] = "new"
        texts[40_001 + 2 * k] = " ".join(words)
    fps = {i: fingerprint(t) for i, t in texts.items()}
    want = similar_groups(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    walked, confirmed = [], []
    walk, confirm = simhash.trie_forest, shingles._confirmed
    monkeypatch.setattr(simhash, "near_pairs", lambda *args, near=simhash.near_pairs: walked.append(near(*args).cache()) or walked[0])
    monkeypatch.setattr(shingles, "_confirmed", lambda *args: confirmed.append(confirm(*args)) or confirmed[-1])
    assert set(by_id(simhash.keep_one(df))) == {i for i, r in want.items() if i == r}
    pairs = {(r["a"], r["b"]) for r in walked[0].collect()}
    assert all(a < b and (fps[a] ^ fps[b]).bit_count() <= simhash.NEAR for a, b in pairs)
    # the tries span what is within their budget
    grouped = classes({i: fps[i] for i in {x for p in pairs for x in p}}, simhash.NEAR)
    first = {(r["a"], r["b"]) for r in confirmed[0].collect()}
    assert len(pairs) >= len(grouped) - len(set(grouped.values()))
    assert first <= pairs and sum(a >= 40_000 for a, _ in first) >= 30
    # pairs of trie_forest are linked themselves, and join what roots join
    fp = np.array(sorted(set(fps.values())), np.uint64)
    i, j = walk(fp, 0, simhash.NEAR, pairs=True)
    assert (np.bitwise_count(fp[i] ^ fp[j]) <= simhash.NEAR).all() and len(i) == len(walk(fp, 0, simhash.NEAR)[0])


# passages


def removed(texts, width=35):
    words = {k: WORD.findall(t or "") for k, t in texts}
    seen = Counter(tuple(w[a : a + width]) for w in words.values() for a in range(len(w) - width + 1))
    out = {}
    for k, w in words.items():
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            if seen[tuple(w[a : a + width])] > 1:
                gone[a : a + width] = [True] * width
        out[k] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


def test_passages(spark, docs):
    words = [f"w{k}" for k in range(200)]
    made = ["x " * 90, " ".join(words), "pre " + " ".join(words[20:70]) + " post", " ".join(words[60:100]), " ".join(words[100:134]), " ".join(words[:40] + words[:40]), "\t".join(words[20:70])]
    texts = [(d["doc_id"], d["text"]) for d in docs] + [(10_000 + k, t) for k, t in enumerate(made)]
    got = by_id(passages.remove(spark.createDataFrame(texts, "doc_id long, text string")))
    for k, want in removed(texts).items():
        assert tuple(got[k][c] for c in ("n_words", "n_removed", "kept_sha256")) == want, k


def test_passages_dealt_over_many_shards(spark, monkeypatch):
    rng = np.random.default_rng(6)
    line = [f"common{k}" for k in range(60)]
    texts = [(k, " ".join([f"a{x}" for x in rng.integers(0, 10**6, 9)] + line[k % 7 : 40 + k % 19] + [f"b{x}" for x in rng.integers(0, 10**6, 40)])) for k in range(120)]
    texts += [(500 + k, " ".join(line[:34])) for k in range(3)] + [(600, " ".join(line[:35]))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = removed(texts)
    whole = passages.stretches
    for shard, hot in ((20_000, 20_000), (7, 20_000), (7, 5)):
        monkeypatch.setattr(passages, "stretches", lambda d, s=shard, h=hot: whole(d, s, h))
        got = by_id(passages.remove(df))
        assert {k: tuple(got[k][c] for c in ("n_words", "n_removed", "kept_sha256")) for k in want} == want


def test_passages_come_from_anywhere():
    words = [f"w{k}" for k in range(50)]
    rows = [  # one passage of one text, as a run of windows; streams of two other texts, and one that only looks alike by its hash
        (passages.RUN, 1, 0, 1, " ".join(words[:40])), (passages.STREAM, 1, 0, 1, " ".join(words[:40])), (passages.STREAM, 2, 10, 1, "x " + " ".join(words[2:45])),
        (passages.WHOLE, 3, 0, 1, " ".join(words[::-1])), (passages.STREAM, 3, 0, 1, " ".join(words[::-1])),
    ]
    names = ["kind", "key", "pos", "copies", "text"]
    for dealt in (False, True):
        got = passages.locate(pa.Table.from_pylist([dict(zip(names, r), dealt=dealt) for r in rows])).to_pylist()
        assert {(g["key"], g["pos"], g["n"]) for g in got if g["key"] != 3} == ({(1, 0, 40), (2, 11, 38)} if dealt else {(1, 2, 38), (2, 11, 38)})
        assert any(g["key"] == 3 for g in got) == dealt


def test_passages_equal_rows(spark):
    text = " ".join(f"w{k}" for k in range(1000))
    df = spark.range(10_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text")).union(spark.createDataFrame([(8, "own " * 3 + " ".join(text.split()[:200]))], "doc_id long, text string"))
    got = passages.remove(df).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert {tuple(r) for r in got} == {(7, 1000, 1000, 10_000), (8, 203, 200, 1)}


def test_passages_edges(odd, empty):
    got = by_id(passages.remove(odd))
    assert got[1]["n_words"] == 0 and got[8]["n_removed"] == 60_000 and got[7]["n_removed"] == 0
    assert passages.remove(empty).count() == 0


# classifier, mixing


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = by_id(queries.op6_quality(spark, d))
    truth = [r for r in pq.read_table(f"{d}/labels.parquet").to_pylist() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(got[r["doc_id"]]["held_out"] for r in truth)
    right = np.mean([got[r["doc_id"]]["predicted"] == r["quality"] for r in truth])
    assert right >= 0.85, right


def test_classifier_edges(spark, odd, empty, labels):
    got = by_id(quality.score(odd, labels))
    assert len(got) == len(ODD) and got[1]["score"] == got[2]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["score"] for r in quality.score(odd, labels.where("false")).collect()} == {0.5}
    assert quality.score(empty, labels).count() == 0 and quality.keep_good(odd, labels.where("false")).columns == odd.columns
    mixed = mixing.with_rates(odd.withColumn("rate", F.lit("mine")), labels, {"good": 1, "toxic": 0, "junk": 0})
    assert set(odd.columns) < set(mixed.columns) and len(mixed.columns) == len(set(mixed.columns))
    assert mixing.mix(empty, labels).count() == 0


def test_mixing_meets_targets(spark):
    t = queries.op9_mixing(spark, "/root/testdata/sf0.01")
    sums = t.agg(F.sum("n_tokens").alias("n"), F.min("rate").alias("least"), *[F.sum(F.expr(f"rate * n_tokens * p_{d}")).alias(d) for d in mixing.DOMAINS]).first()
    assert sums["least"] >= 0
    for d in mixing.DOMAINS:
        assert abs(sums[d] / sums["n"] - mixing.TARGETS[d]) < 1e-3


def test_fitting_sample_is_bounded_in_rows(spark):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text")).union(spark.createDataFrame([(k, f"text {k}") for k in range(2, 40)], "doc_id long, text string"))
    known = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    got = linear.labelled_features(docs, known, ["quality"], 20)
    assert len(got) <= 20
    assert len(linear.labelled_features(docs, known, ["quality"], 100)) == 39


def nonnegative_least_squares(a, t, rounds=20_000):
    """The smallest residual of ``a @ r = t`` over r >= 0, by accelerated projected gradient."""
    r = y = np.ones(a.shape[1])
    step, m = 1 / np.linalg.norm(a, 2) ** 2, 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * a.T @ (a @ y - t))
        m, old = (1 + np.sqrt(1 + 4 * m * m)) / 2, m
        y, r = new + (old - 1) / m * (new - r), new
    return np.linalg.norm(a @ r - t)


def test_mixing_against_least_squares(spark):
    rng = np.random.default_rng(5)
    for k, target in enumerate([{"good": 0.6, "toxic": 0.3, "junk": 0.1}, {"good": 0.98, "toxic": 0.01, "junk": 0.01}]):
        p = rng.dirichlet([0.6, 0.5, 0.5], 60)
        n = rng.integers(5, 400, 60)
        table = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(60)], "doc_id long, n_tokens long, p_good double, p_toxic double, p_junk double")
        steps, miss = mixing.fit_rates(table, target)
        rates = np.array([r["r"] for r in table.withColumn("r", mixing._rate(steps)).orderBy("doc_id").collect()])
        a, t = (p * n[:, None]).T / n.sum(), np.array([target[d] for d in mixing.DOMAINS])
        assert rates.min() >= 0 and miss == pytest.approx(np.abs(a @ rates - t).max(), abs=1e-9)
        assert np.linalg.norm(a @ rates - t) <= nonnegative_least_squares(a, t) + 1e-4


def test_mixing_tells_what_it_misses(spark):
    table = spark.createDataFrame([(1, 10, 0.5, 0.25, 0.25), (2, 30, 0.5, 0.25, 0.25)], "doc_id long, n_tokens long, p_good double, p_toxic double, p_junk double")
    with pytest.warns(UserWarning, match="misses"):
        assert mixing.fit_rates(table, {"good": 0.9, "toxic": 0.1, "junk": 0.0})[1] > 0.1


def test_mixing_of_repeated_ids(spark, labels):
    docs = spark.createDataFrame([(1, "a b c", "x")] * 50 + [(2, None, "y")], "doc_id long, text string, p_good string")
    got = mixing.with_rates(docs, labels, {"good": 1, "toxic": 1, "junk": 1}).collect()
    assert len(got) == 51 and {r["p_good"] for r in got} == {"x", "y"}


def test_ftrl_learns_a_rule():
    rng = np.random.default_rng(0)
    rows = [(float(y), np.array([1 if y else 2, 3 + int(rng.integers(50))]), np.ones(2)) for y in rng.integers(0, 2, 400)]
    w, b = linear.ftrl(rows, bits=8)
    assert w[1] + b > 1 and w[2] + b < -1


# language model


def test_hmm_base_scores(spark, docs):
    got = by_id(queries.op10_hmm(spark, D))
    low = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    count = Counter()
    for d in docs:
        if zlib.crc32(str(d["doc_id"]).encode()) % 7 != 2:
            count.update([*low(d["text"]), None])
    n, v = sum(count.values()), len(count)
    for d in docs:
        tokens, r = [*low(d["text"]), None], got[d["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(t in count for t in tokens), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((count[t] + 1) / (n + v + 1)) for t in tokens), rel=1e-9)
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 7 == 2)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_hmm_forward_is_exact():
    rng = np.random.default_rng(2)
    m = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    seqs = [rng.integers(0, 5, k).astype(np.uint16) for k in (1, 4, 2, 7)]
    got = m.log10(np.concatenate(seqs), np.cumsum([0, *map(len, seqs)]))
    for s, x in zip(seqs, got):
        a = m.start * m.emit[s[0]]
        for t in s[1:]:
            a = (a @ m.move) * m.emit[t]
        assert x == pytest.approx(np.log10(a.sum()))


def forward_backward(m, s):
    """Expected counts of one text, token by token."""
    k, a, c, b = len(m.start), [], [], [np.ones(len(m.start))]
    for t, x in enumerate(s):
        now = (m.start if t == 0 else a[-1] @ m.move) * m.emit[x]
        c.append(now.sum())
        a.append(now / c[-1])
    for t in range(len(s) - 1, 0, -1):
        b.append(m.move @ (m.emit[s[t]] * b[-1]) / c[t])
    b = b[::-1]
    emits, moves = np.zeros((len(m.emit), k)), np.zeros((k, k))
    for t, x in enumerate(s):
        emits[x] += a[t] * b[t]
        if t:
            moves += np.outer(a[t - 1], m.emit[x] * b[t] / c[t]) * m.move
    return a[0] * b[0], moves, emits, np.log(c).sum()


def test_hmm_counts_are_of_whole_texts(monkeypatch):
    rng = np.random.default_rng(3)
    k, size = 4, 30
    m = hmm.Model(rng.dirichlet(np.ones(k)), 0.97 * np.eye(k) + 0.03 * rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(size), k).T)
    for rows, long in ((1024, 4096), (512, 0), (64, 100), (7, 0)):
        monkeypatch.setattr(hmm, "CHUNK", rows)
        monkeypatch.setattr(hmm, "LONG", long)
        for lens in ([1000], [1], [5, 70, 1, 64, 0, 128, 3000, 2], [63, 1, 512, 512]):
            texts = [rng.integers(0, size, n).astype(np.uint16) for n in lens]
            got = m.expected(np.concatenate(texts), np.cumsum([0, *lens]))
            for g, want in zip(got, zip(*(forward_backward(m, t) for t in texts if len(t)))):
                assert np.asarray(g) == pytest.approx(sum(want), rel=1e-9, abs=1e-9)
        assert got[1].sum() == pytest.approx(sum(lens) - len(lens))


def test_hmm_edges(odd, empty):
    got = by_id(hmm.score(odd, rounds=1))
    assert len(got) == len(ODD) and got[1]["n_tokens"] == 1 and all(np.isfinite(r["score"]) for r in got.values())
    assert hmm.score(empty).count() == 0


# decontamination


def test_leaks_finds_paraphrases(spark, odd, empty):
    rng = np.random.default_rng(8)
    vocab = [f"term{k}" for k in range(3000)]
    item = list(rng.choice(vocab, 40))
    other = [" ".join(rng.choice(vocab, 120)) for _ in range(60)]
    swap = [f"other{k}" if k % 6 == 3 else w for k, w in enumerate(item)]
    docs = spark.createDataFrame([*enumerate(other), (100, other[0] + " " + " ".join(item) + " " + other[1]), (101, other[2] + " " + " ".join(swap)), (102, " ".join(item))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "few words")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in leaks.search(docs, bench).collect()}
    assert found == {(100, 1), (101, 1), (102, 1)}
    assert set(by_id(leaks.clean(docs, bench))) == set(range(60))
    kept = leaks.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert leaks.search(empty, bench).count() == 0 and leaks.search(docs, bench.where("false")).count() == 0


def test_leaks_recall_of_paraphrases(spark):
    """Paraphrases with words swapped for others, put in or left out, against the exact subsequence over every place of every text."""
    rng = np.random.default_rng(12)
    vocab = np.array([f"term{k}" for k in range(4000)])
    draw = lambda n: list(rng.choice(vocab, n, p=weight))
    weight = 1 / np.arange(5, 4005)
    weight /= weight.sum()
    items = {k: draw(int(rng.integers(12, 60))) for k in range(60)}
    texts, want = {}, set()
    for d in range(240):
        text = draw(int(rng.integers(20, 200)))
        k, how, share = d % 60, d // 60, rng.choice([0.08, 0.15, 0.25])
        item = list(items[k])
        for at in sorted(rng.choice(len(item), max(1, int(len(item) * share)), replace=False).tolist(), reverse=True):
            if how == 0:
                item[at] = f"own{rng.integers(10**6)}"
            elif how == 1:
                item.insert(at, f"own{rng.integers(10**6)}")
            elif how == 2:
                del item[at]
        if how < 3:
            at = int(rng.integers(len(text)))
            text[at:at] = item
        texts[d] = " ".join(text)
    number = {w: k for k, w in enumerate({w for t in [*texts.values()] for w in t.split()} | {w for i in items.values() for w in i})}
    for d, t in texts.items():
        words = [number[w] for w in t.split()]
        for k, item in items.items():
            seq = [number[w] for w in item]
            if any(leaks.common(seq, words[a : a + 2 * len(seq)]) >= leaks.COVER * len(seq) for a in range(0, len(words), max(len(seq) // 4, 1))):
                want.add((d, k))
    planted = {(d, d % 60) for d in range(180)}
    found = {(r["doc_id"], r["item_id"]) for r in leaks.search(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame([(k, " ".join(i)) for k, i in items.items()], "item_id long, text string")).collect()}
    print(len(want), len(planted & want), len(found & want) / len(want), len(found - want))
    assert len(found & planted & want) >= 0.9 * len(planted & want)
    assert len(found - want - planted) <= 0.02 * len(found)


def test_common_subsequence():
    assert leaks.common([1, 2, 3, 4], [9, 1, 3, 8, 4]) == 3 and leaks.common([1], []) == 0


def test_models_are_fitted_in_a_task(spark, empty, monkeypatch):
    """The driver gets weights, not the sample's features; they are those of the collected sample, bit for bit."""
    table, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    rows = linear.labelled_features(table, labels, ["quality", "toxic"], 100)
    want = [linear.ftrl([(y[k], i, x) for y, i, x in rows]) for k in range(2)]
    monkeypatch.setattr(linear, "labelled_features", lambda *args: pytest.fail("features were collected"))
    got = linear.fit(table, labels, ["quality", "toxic"], 100)
    assert len(rows) > 50 and want[0][0].any() and all((w == v).all() and a == b for (w, a), (v, b) in zip(got, want))
    w, bias = quality.fit(empty, labels)
    assert not w.any() and bias == 0 and len(mixing._models(empty, labels, 100)) == 3
    assert quality.fit(table, labels)[0].any()


def test_short_edge_lists_take_one_task(spark):
    """The same components as by rounds, without the rounds' hundreds of tasks in the driver's books."""
    rng = np.random.default_rng(5)
    edges = [*rng.integers(0, 900, (500, 2)).tolist(), [7, 7], [5000, 5000], *([i + 1, i] for i in range(2000, 2100)), *([3000, i] for i in range(2990, 3200))]
    df = spark.createDataFrame(edges + edges[:50], "a long, b long")
    began = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    at_once = sorted(map(tuple, components.components(df, len(edges) + 50).collect()))
    assert spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs() - began <= 5
    assert at_once == sorted(map(tuple, components.components(df).collect())) == sorted(map(tuple, components.components(df, 10).collect()))
    assert components.components(df.where("a < 0"), 10).count() == 0


def test_near_copies_take_few_jobs(spark):
    """Each round of the near-duplicate stage's three component searches was some ten jobs."""
    df = spark.read.parquet(f"{D}/documents.parquet")
    began = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    simhash.keep_one(df).count()
    assert spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs() - began < 88
