"""Pages, vectors, rollups and the pipeline."""

import numpy as np
import pyarrow.parquet as pq
import pytest
import tiktoken  # noqa: F401  the rollup needs it
from pyspark.sql import functions as F

import corpus_pipeline
from docweave.llm import ann, html, queries, rollup


def test_html_keeps_the_article():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><a href=x>Menu</a></nav>
    <div class="ad">Buy</div><article><h1>A&amp;B</h1><p>one\n two<br>three</p><ul><li>x<li>y</ul><div class="related">more</div></article>
    <section class="comments"><p>first!</p></section><footer>c</footer></body></html>"""
    assert html.main_text(page) == "A&B\n\none two three\n\nx\n\ny"
    for odd in ("", "<", "<p", "<article><p>cut", "plain", "<!-- open", "<script>x"):
        html.main_text(odd)
    assert html.main_text("<article><p>cut") == "cut" and html.main_text("plain &lt;") == "plain <"


def test_html_template_by_host(spark):
    rows = [(k, f"http://h.example/{k}", f"<html><body><div class=top><p>Site name</p></div><div class=c><p>Story {k} has words</p><p>and {k * 7} more</p></div><div><p>All rights kept</p></div></body></html>") for k in range(30)]
    rows += [(100, None, None), (101, "odd url", ""), (0, "http://h.example/0", rows[0][2])]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("mine"))).collect()
    assert len(got) == len(rows)
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[3] == "Story 3 has words\n\nand 21 more" and texts[100] == "" and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_keeps_what_repeats_in_the_article(spark):
    def page(k):
        return k, f"http://h.example/{k}", f"<body><div><p>Site</p></div><article><h2>Ingredients</h2><p>item {k} one</p><h2>Method</h2><p>step {k}</p><div class='share-price'>Up 3</div><div class=search-results>None</div><p class='notice-of-award'>Given</p><div class='share-buttons left'>Share</div><div class=adBox>Buy</div></article></body>"

    for n in (2, 9, 12):
        got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame([page(k) for k in range(n)], "page_id long, url string, html string")).collect()}
        assert got == {k: f"Ingredients\n\nitem {k} one\n\nMethod\n\nstep {k}\n\nUp 3\n\nNone\n\nGiven" for k in range(n)}


def test_html_template_by_layout(spark):
    def page(k, layout):
        menu = f"<div class=box{layout}><p>Menu {layout}</p><p>All of {layout} in one place, day by day and week by week</p></div>"
        own = f"<div class=c{layout}><p>Story {k} has words of its own</p><p>No {k * 7} tells more of them</p></div>"
        return k, f"http://h.example/{k}", f"<html><body><div class=top><p>Site name</p></div>{menu}{own}<div class=low{layout}><span>Kept rights of {layout}</span></div></body></html>"

    rows = [page(k, "a" if k % 2 else "b") for k in range(8)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Story {k} has words of its own\n\nNo {k * 7} tells more of them" for k in range(8)}
    # flat pages have no element that holds the slot, only what lies between template text
    rows = [(k, "http://flat/", f"<body><p>Site name</p><p>Story {k} is long enough to be most of the page</p><p>Again</p><p>End {k}</p><p>All rights kept</p></body>") for k in range(3)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Story 1 is long enough to be most of the page\n\nAgain\n\nEnd 1"


def test_html_nesting():
    page = {t: (t * 10, "/x" if t % 2 else None) for t in range(1, 10)}
    assert html.nested(page, [[1, 2, 9], [3, 4]]) == {1, 2, 9, 3, 4}
    assert html.nested(page, [[1, 2, 9], [4, 3]]) == {1, 2, 9}  # out of order
    assert html.nested(page, [[1, 5], [3, 4, 6]]) == {1, 5, 3, 4}  # cut at 5; 6 has no element
    assert html.nested(page, [[1, 77]]) == set()


def test_html_copies_and_small_hosts(spark):
    def page(host, k, story, tag="div"):
        return k, f"http://{host}/{k}", f"<html><body><div class=top><p>Site name</p></div><{tag} class=c><h2>Head</h2><p>{story}</p><p>By the desk</p></{tag}><div><p>All rights kept</p></div></body></html>"

    long = "A story that is told again and again by the same host in the same words"
    rows = [page("copies", k, long) for k in range(12)]  # one page only
    rows += [page("mark", 20 + k, long + (f" {k}" if k > 10 else ""), "article") for k in range(12)]
    rows += [page("small", 40 + k, f"{long} {k}") for k in range(3)] + [page("large", 60 + k, f"{long} {k}") for k in range(12)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(long in got[k] for k, _, _ in rows)
    assert got[20] == f"Head\n\n{long}\n\nBy the desk"
    assert got[41] == got[61] == f"Head\n\n{long} 1\n\nBy the desk"  # the same at 3 pages and at 12


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_ann_recall(spark, size):
    d = f"/root/testdata/{size}"
    t = pq.read_table(f"{d}/embeddings.parquet").to_pylist()
    ids, x = np.array([r["vec_id"] for r in t]), np.array([r["embedding"] for r in t], np.float64)
    place = {i: k for k, i in enumerate(ids.tolist())}
    got = {}
    for r in queries.op3_ann(spark, d).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = (r["rank"], r["score"])
    hit = total = 0
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        mine = got[ids[k]]
        hit, total = hit + len(set(ids[best].tolist()) & set(mine)), total + 20
        assert sorted(r for r, _ in mine.values()) == list(range(1, 21))
        assert all(v == pytest.approx(float(x[k] @ x[place[i]])) for i, (_, v) in mine.items())
    assert hit / total >= 0.92, hit / total


def test_ann_cells_follow_clusters():
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(50, 32))
    tight = (centre[rng.integers(0, 50, 4000)] + 0.1 * rng.normal(size=(4000, 32))).astype(np.float32)
    loose = rng.normal(size=(4000, 32)).astype(np.float32)
    share = [ann.Codebooks.fit(x, 64).probes(x, 20) / 64 for x in (tight, loose)]
    assert share[0] < 0.1 < share[1] <= 1


def test_ann_loses_no_neighbour(spark):
    rng = np.random.default_rng(5)
    centre, n = rng.normal(size=(40, 64)), 6000
    x = (centre[rng.integers(0, 40, n)] + 0.05 * rng.normal(size=(n, 64))).astype(np.float32)
    x[::20] = rng.normal(size=(n // 20, 64))  # queries lie elsewhere than the rows
    got = ann.search(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    mine = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in range(0, n, 400)}
    for q, found in mine.items():
        s = np.einsum("nd,d->n", x.astype(np.float64), x[q].astype(np.float64))
        s[q] = -np.inf
        assert found == np.lexsort((np.arange(n), -s))[:20].tolist()


def test_ann_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (20, [float("inf"), 1.0])]
    v = spark.createDataFrame(rows + [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>").withColumn("cell", F.lit(1))
    # equal rows count once, and an id has its best score
    assert [tuple(r) for r in ann.search(v).orderBy("rank").collect()] == [(0, 1, 1, 2.0), (0, 2, 2, 2.0)]
    assert ann.search(v.where("false")).count() == 0
    mixed = spark.createDataFrame([(0, [1.0]), (20, [1.0, 1.0]), (40, [1e300, 3.0]), (1, [5.0]), (3, [3.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.search(mixed).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 5.0), (0, 2, 3, 3.0), (20, 1, 40, 1e300 + 3.0), (40, 1, 20, 1e300 + 3.0)]


def test_ann_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(1)
    one = rng.normal(size=16).tolist()
    rows = [(k, one) for k in range(500)] + [(1000 + k, (0.1 * rng.normal(size=16)).tolist()) for k in range(60)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 100").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(20))


def totals(df):
    return {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"], r["n_chars"]) for r in df.collect()}


def test_rollup_commits_once(spark, tmp_path):
    tok = rollup.Tokenizer()
    docs = spark.createDataFrame([("a", "en", "hello world"), ("a", "en", None), (None, None, "x"), ("b", "de", "Wörter")], "source string, lang string, text string")
    path = f"file://{tmp_path}/r"
    want = totals(rollup.count_table(docs, path, tok))
    assert want == {("a", "en"): (2, tok.count(["hello world"])[0], 11), (None, None): (1, 1, 1), ("b", "de"): (1, tok.count(["Wörter"])[0], 6)}
    assert totals(rollup.count_table(docs, path, tok)) == want
    r = rollup.Rollup(spark, path)
    changes = spark.createDataFrame([("revise", "a", "en", "hello there world", "a", "en", "hello world"), ("delete", None, None, None, "b", "de", "Wörter"), ("odd", "z", "z", "z", "z", "z", "z")], "kind string, source string, lang string, text string, old_source string, old_lang string, old_text string")
    assert r.commit("day 2", rollup.signed(changes), tok) and not r.commit("day 2", rollup.signed(changes), tok)
    after = totals(r.totals())
    assert after == {("a", "en"): (2, tok.count(["hello there world"])[0], 17), (None, None): (1, 1, 1)}
    r.compact()
    assert totals(r.totals()) == after and not r.commit("day 2", rollup.signed(changes), tok)
    assert r.commit("none", rollup.signed(changes.where("false")), tok) and totals(r.totals()) == after


def test_rollup_of_a_random_history(spark, tmp_path):
    """Inserts, deletes, revisions and repeated batches against a plain dictionary of the texts that are left."""
    rng = np.random.default_rng(2)
    tok, path = rollup.Tokenizer(), f"file://{tmp_path}/h"
    r = rollup.Rollup(spark, path)
    held, key, batches = {}, 0, []
    draw = lambda: (str(rng.choice(["a", "b"])), [None, "en", "de"][rng.integers(3)], ["", "one two", "x" * 5000, "zwei Wörter mehr"][rng.integers(4)])
    schema = "kind string, source string, lang string, text string, old_source string, old_lang string, old_text string, sign int"
    for n in range(3):
        rows = []
        for _ in range(30):
            kind = rng.choice(["insert", "delete", "revise", "odd"]) if held else "insert"
            old = held.pop(int(rng.choice(list(held)))) if kind in ("delete", "revise") else (None, None, None)
            new = draw() if kind != "delete" else (None, None, None)
            if kind == "revise" and rng.random() < 0.5:
                new = (*new[:2], old[2])
            rows.append((str(kind), *new, *old, 9))
            if kind in ("insert", "revise"):
                held[key := key + 1] = new
        batches.append((f"b{n}", rollup.signed(spark.createDataFrame(rows, schema))))
        for name, df in batches:  # each again and again
            assert r.commit(name, df, tok) == (name == f"b{n}")
    want = {}
    for source, lang, text in held.values():
        w = want.setdefault((source, lang), [0, 0, 0])
        w[0], w[1], w[2] = w[0] + 1, w[1] + tok.count([text])[0], w[2] + len(text)
    assert totals(r.totals()) == {k: tuple(v) for k, v in want.items()}


def test_rollup_of_the_table(spark):
    got = queries.op8_rollup(spark, "/root/testdata/sf0.001").agg(F.sum("n_docs"), F.sum("n_chars")).first()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").agg(F.count("*"), F.sum(F.length("text"))).first()
    assert tuple(got) == tuple(docs)


def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = corpus_pipeline.run(spark, d).cache()
    assert docs.columns == out.columns[: len(docs.columns)] and {"rate", "domain", "n_tokens"} <= set(out.columns)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert 0 < len(ids) == len(set(ids)) < docs.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), d).count() == 0, name
