"""Hand-written cases for what SQL can't express, and for edge cases of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.functions import numbers as nx
from docweave.functions import text as tx
from docweave.operators import aggregates, dml, filters, graph, paging, retrieval, shape, windows
from docweave.sources import delimited, formats, markup, sqltables
from docweave.streaming import events as ev
from docweave.streaming import lifecycle


def vals(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_filter_rules():
    F_ = filters.Filter
    for bad in (("", "string", "is", "a"), ("k", "string", "in", "a"), ("k", "list", "in", "a"), ("k", "number", "is_between", [3, 1]), ("k", "boolean", "is", 1)):
        with pytest.raises(filters.FilterError):
            F_.make(*bad)
    assert [f.key for f in filters.from_config({"a": {"type": "string", "operator": "is", "value": "x"}, "b": {"type": "string"}, "c": None})] == ["a"]
    assert F_.make("k", "list", "equals", [{"id": "x"}]).value == ("x",)
    assert filters.is_enabled({}, "pages") and not filters.is_enabled({"enable_manual_sync": True, "pages": True}, "pages")
    assert filters.parse_range("gte:1,lte:5,eq:3") == (1, 5) and filters.parse_range(None) == (None, None)
    for bad in ("gte:5,lte:1", "gte:-1", "gte:x"):
        with pytest.raises(filters.FilterError):
            filters.parse_range(bad, 100)
    assert filters.known_values(["a", "z"], "abc") == ["a"] and filters.known_values(["z"], "abc") is None
    assert filters.strings(" a ") == ["a"] and filters.strings(["", None]) is None
    assert filters.scope(["x"], ["a", "b"]) == ["a", "b"] and filters.scope(["b"], ["a", "b"]) == ["b"]


def test_filter_tree_rejects_mode_and_counts_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    with pytest.raises(filters.FilterError):
        filters.tree(mode="odd")
    assert vals(df.where(filters.tree(must_not={"s": "a"})), "i") == [(2,)]
    assert df.where(filters.tree(s="a", mode="should")).count() == 1
    with pytest.raises(filters.FilterError):
        filters.listing(df, {}, strict=True, odd=1)


def test_upserts_and_versions(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, name string, n int")
    new = spark.createDataFrame([(2, None, 7), (3, "c", 8)], "id int, name string, n int")
    assert vals(dml.upsert(old, new, ["id"]), "id", "name", "n") == [(1, "a", 5), (2, "b", 7), (3, "c", 8)]
    assert dml.insert(old, new, ["id"])[1].first().asDict() == {"created": 1, "updated": 0, "ignored": 0, "errors": 1}
    v = spark.createDataFrame([("d", 0, "x"), ("d", 1, "y")], "doc string, version int, content string")
    back = dml.roll_back(v, "doc", "content", 0)
    assert vals(dml.at_version(back, "doc"), "doc", "version", "content") == [("d", 2, "x")]
    assert dml.append_version(v, spark.createDataFrame([("d", "y")], "doc string, content string"), "doc", "content").count() == 2
    with pytest.raises(ValueError):
        dml.at_version(v, "doc", -1)
    good, bad = dml.validate(old, {"small": F.col("n") < 6}, ["name"])
    assert vals(good, "id") == [(1,)] and vals(bad, "id") == [(2,)]


def test_taxonomy_needs_upper_levels(spark):
    named = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", None, "c"])], "record int, names array<string>")
    nodes, edges = dml.taxonomy(spark.createDataFrame([], "level long, name string"), spark.createDataFrame([], "src string, dst string"), named)
    assert vals(nodes, "level", "name") == [(1, "a"), (2, "b")]
    assert vals(edges, "src", "dst") == [("1", "1:a"), ("1", "2:b"), ("2", "1:a"), ("2:b", "1:a")]


def test_cycles_end(spark):
    e = spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "b")], "src string, dst string")
    assert vals(graph.descendants(e, spark.createDataFrame([("a",)], "id string")), "node", "hops") == [("a", 0), ("b", 1), ("c", 2)]
    assert vals(graph.ancestors(e, spark.createDataFrame([("c",)], "id string")), "at", "hops") == [("a", 2), ("b", 1), ("c", 0)]


def test_dense_ties_nulls_and_empty(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0])], "point_id long, vector array<double>")
    q = spark.createDataFrame([(9, [3.0, 0.0])], "query_id long, vector array<double>")
    assert vals(retrieval.dense(q, p, 5), "point_id", "rank") == [(1, 1), (2, 2)]
    assert retrieval.dense(q.where("false"), p, 5).count() == 0
    assert retrieval.bm25(q.where("false").select("query_id", F.lit("a").alias("text")), p.select("point_id", F.lit("a").alias("text")), 3).count() == 0


def test_dense_reads_points_once_in_tiles(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5000, 8)).round(1)
    x[1000:2000] = x[0]  # equal points go by id
    p = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "point_id long, vector array<double>")
    got = retrieval.dense(p.where("point_id % 4 = 0").withColumnRenamed("point_id", "query_id"), p, 5)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # 1,250 queries
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    score = np.round(unit[::4] @ unit.T, 6)
    best = np.argsort(-score, axis=1, kind="stable")[:, :5]
    assert vals(got, "query_id", "rank", "point_id") == [(4 * q, r + 1, i) for q, row in enumerate(best.tolist()) for r, i in enumerate(row)]


def test_sparse_search_scores_in_tasks(spark, tmp_path):
    import duckdb

    from docweave import plans

    rows = [(1, "Alpha beta, beta"), (1, "beta gamma"), (2, "alpha \u00e9alpha \u212aappa gamma"), (3, None), (4, ""), (5, "other words only"), (6, "GAMMA-alpha")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "alpha Beta beta"), (8, "gamma"), (9, "absent"), (10, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    queries, oracle = plans.load()
    got = queries["search_bm25_topk"](spark, str(tmp_path))
    assert vals(got, "query_id", "point_id", "score", "rank") == sorted(con.execute(oracle["search_bm25_topk"]).fetchall())
    # pairs of queries and points aren't shuffled, only each task's best
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") <= 1


def test_boxes_ranges_headers(spark):
    b = spark.createDataFrame([(1, 10.0, 20.0, 50.0, 60.0), (1, 30.0, 10.0, 100.0, 80.0)], "g int, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(c) for c in aggregates.box_union(b, ["g"]).first()["corners"]] == [(10, 10), (100, 10), (100, 80), (10, 80)]
    i = spark.createDataFrame([(1, x) for x in (1, 2, 2, 5)], "g int, i int")
    assert vals(aggregates.index_ranges(i, ["g"], "i"), "start", "end") == [(1, 2), (5, 5)]
    h = spark.createDataFrame([(1, n, k) for k, n in enumerate("aab")], "g int, name string, pos int")
    assert vals(windows.suffix_repeats(h, ["g"], "name", "pos", 1), "pos", "unique_name") == [(0, "a"), (1, "a_1"), (2, "b")]
    assert vals(windows.suffix_collisions(h, ["g"], "name", "pos"), "pos", "unique_name") == [(0, "a_1"), (1, "a_2"), (2, "b")]


def test_chunk_metadata(spark):
    c = spark.createDataFrame([(1, 0, 1, "s", ["x"], 0.2), (1, 1, 2, "s", ["y", "x"], 0.9), (1, 2, None, "s", None, None)], "g int, o int, page int, source string, tags array<string>, conf double")
    assert aggregates.merge_metadata(c, "g", "o", ["page", "source"], ["tags"], ["conf"]).select("conf", "page", "page_all", "source", "source_all", "tags").first() == (0.9, None, [1, 2], "s", None, ["x", "y"])


def test_scalars(spark):
    one = spark.range(1)
    got = one.select(
        tx.value_type(F.lit("1d")).alias("a"), nx.calculate("divide", F.lit(1.0), F.lit(0.0)).alias("b"), nx.calculate("sqrt", F.lit(-1.0)).alias("c"),
        nx.epoch_ms(F.lit("2024-01-01T00:00:01.9Z")).alias("d"), tx.row_text(F.array(F.lit("a")), F.array(F.lit(None).cast("string"))).alias("e"),
        nx.excluded_dates(F.lit("2024-01-06").cast("date"), F.lit("2024-01-01").cast("date"), F.array().cast("array<date>")).alias("f"),
        F.size(nx.dates_in(F.lit("13/02/2024, 02/13/2024 and 5 May 2023"), 2024)).alias("g"), F.lit(markup.mdx("<Info>x</Info>\n<Card/>\n\n\ny")).alias("h"),
        tx.file_name(F.lit("\n")).alias("i"), tx.url_title(F.lit("http://a.b/")).alias("j"), nx.mapped(F.lit("P7"), nx.PRIORITY).alias("k"),
    ).first()
    assert tuple(got) == ("string", None, None, 1704067201000, "a: null", None, 1, "> **Note:**\n>\n> x\n\ny", "file", "a.b", "P7")
    with pytest.raises(ValueError):
        nx.calculate("modulo", F.lit(1), F.lit(2))


def test_nested_projection(spark):
    df = spark.createDataFrame([((1, 2), [(3, 4)])], "a struct<x:int,y:int>, b array<struct<x:int,z:int>>")
    assert shape.project(df, ["*.x"]).schema.simpleString() == "struct<a:struct<y:int>,b:array<struct<z:int>>>"
    assert shape.project(df, keep=["a", "b.z"]).schema.simpleString() == "struct<a:struct<x:int,y:int>,b:array<struct<z:int>>>"
    assert shape.project(df, ["a.x"], ["a"]).first().a.y == 2


def test_citations(spark):
    a = spark.createDataFrame([("k", "see [1](http://h/record/r1/preview#blockIndex=3) [2](http://u) [3](http://h/record/r9/preview#blockIndex=0) [4](ref5)")], "k string, t string")
    blocks = spark.createDataFrame([("http://u", "r2", 0, "B"), ("http://v", "r1", 3, "A")], "url string, record_id string, block_index long, block_id string")
    assert vals(shape.join_citations(shape.citations(a, "k", "t"), blocks).fillna("-", ["block_id"]), "position", "block_id") == [(0, "A"), (1, "B"), (2, "-"), (3, "-")]
    sizes = spark.createDataFrame([("r9", 0)], "record_id string, n_blocks long")
    assert vals(shape.unknown_citations(a, "k", "t", blocks, sizes), "target") == [("http://h/record/r9/preview#blockIndex=0",), ("ref5",)]
    assert vals(shape.unknown_citations(a, "k", "t", blocks, sizes.withColumn("n_blocks", F.lit(1))), "target") == [("ref5",)]


def test_table_regions():
    grid = [["a", "b", "", "x"], ["1", "2", "", ""], ["", "", "", ""], ["", "", "", ""], ["c", "", "", ""]]
    assert [(a, z) for a, z, _ in delimited.regions(grid)] == [(0, 1), (0, 0), (4, 4)]
    assert delimited.regions(grid)[0] == (0, 1, [["a", "b"], ["1", "2"]])
    # an empty second row doesn't end a table
    assert delimited.regions([["a"], [""], ["b"]])[0][:2] == (0, 2)
    assert delimited.regions([]) == []


def test_csv_files(spark):
    f = spark.createDataFrame([("f", "h,i\n1,2\n3,4\n"), ("g", ""), ("n", None)], "file string, content string")
    t = delimited.tables(f, "file", "content")
    assert vals(t, "file", "table_no", "start_row", "end_row") == [("f", 0, 1, 3)]
    assert vals(delimited.row_blocks(t), "row_number", "text", "n_rows") == [(1, "h: 1, i: 2", 2), (2, "h: 3, i: 4", 2)]


def test_markup():
    assert markup.absolute("<link rel=canonical href='https://a.b/c'><img src=\"x.png\"><img src='http://q/z'>") == "<link rel=canonical href='https://a.b/c'><img src=\"https://a.b/x.png\"><img src='http://q/z'>"
    text, images = markup.numbered("![i](u.png) ![r][k]\n<img src='h.png' alt='c'>\n\n[k]: v.png")
    assert [(i["name"], i["url"]) for i in images] == [("Image_1", "v.png"), ("Image_2", "u.png"), ("Image_3", "h.png")]
    assert "![Image_2](u.png) ![Image_1][k]" in text
    cut = lambda s: [s[a:z] for a, z in markup.split_sentences(s)]
    assert cut("Dr. Who came. He left... then 3. more") == ["Dr. Who came.", "He left... then 3. more"]
    assert cut("") == [] and cut("  ") == []


def test_pages():
    assert paging.PageInfo.of(0, 1, 20).pages == 0 and paging.PageInfo.of(41, 2, 20) == paging.PageInfo(2, 20, 41, 3, True, True)
    assert paging.adaptive_limit(1) == 50 and paging.adaptive_limit(9) == 25


def test_sql_surface(spark):
    spark.range(150).createOrReplaceTempView("t150")
    got = sqltables.display(sqltables.run(spark, "SELECT id FROM t150 WHERE id >= ? ORDER BY id", [10]))
    assert (got["row_count"], got["truncated"], got["displayed_row_count"], got["rows"][0]) == (140, True, 100, {"id": 10})
    assert ("t150", "id", "bigint") in vals(sqltables.tables(spark), "table_name", "column_name", "data_type")
    assert sqltables.ddl(spark.range(1), "t").startswith("CREATE TABLE t (\n  `id` bigint NOT NULL")


def test_feed_items_of_shared_links(spark, tmp_path):
    from docweave import plans

    spark.createDataFrame([(1, "u"), (2, "u"), (2, "u"), (3, ""), (4, None), (5, "v")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert vals(plans.load()[0]["feed_items"](spark, str(tmp_path)), "page_id", "url") == [(1, "u"), (2, "u"), (3, ""), (5, "v")]


def test_feed_and_routes(spark):
    df = spark.createDataFrame([("f", 1, "u", None, "", "s", "t"), ("f", 2, "u", "c", "", "s", "t"), ("f", 3, "v", "c", "", "s", "t")], "feed string, position int, link string, content string, crawled string, summary string, title string")
    assert vals(formats.feed_entries(df, spark.createDataFrame([("v",)], "link string"), 5), "link", "body") == [("u", "s")]


def test_envelopes(spark):
    raw = spark.createDataFrame([('{"eventType":"newRecord","timestamp":1,"payload":"{}"}', 0), ('"{\\"eventType\\":\\"x\\",\\"timestamp\\":2}"', 1), ("junk", 2), (None, 3)], "value string, offset int")
    good, bad = ev.envelopes(raw)
    assert vals(good, "offset", "eventType") == [(0, "newRecord"), (1, "x")]
    assert vals(bad, "offset") == [(2,), (3,)]


def test_lifecycle_rules(spark):
    rows = [(1, 1, "newRecord", "active", True, "OK"), (1, 2, "reindexRecord", "active", True, "FAILED"), (1, 3, "updateRecord", "active", True, "EMPTY"), (1, 4, "deleteRecord", "active", True, "OK"), (1, 5, "updateRecord", "active", True, "OK"), (2, 6, "newRecord", "inactive", True, "OK")]
    got = lifecycle.replay(spark.createDataFrame(rows, lifecycle.EVENT))
    assert [r["status"] for r in got.orderBy("event_id").collect()] == ["COMPLETED", "COMPLETED", "EMPTY", None, None, "AUTO_INDEX_OFF"]


def test_lifecycle_bulk_delete(spark, tmp_path):
    rows = [(1, 1, "newRecord", "active", True, "OK", None), (2, 2, "newRecord", "active", True, "OK", None), (3, 3, "newRecord", "active", True, "OK", None)]
    rows += [(None, 4, "bulkDeleteRecords", None, None, None, [1, 2, 2, None]), (2, 5, "updateRecord", "active", True, "OK", None), (None, 6, "bulkDeleteRecords", None, None, None, [])]
    df = spark.createDataFrame(rows, lifecycle.EVENT + ", record_ids array<long>")
    got = {(r["record_id"], r["event_id"]): (r["event_type"], r["status"], r["embeddings"]) for r in lifecycle.replay(df).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (1, 4), (2, 4), (2, 5)}
    assert got[1, 4] == got[2, 4] == ("deleteRecord", None, "delete") and got[3, 3][1] == "COMPLETED" and got[2, 5] == ("updateRecord", None, "keep")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = lifecycle.stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).format("memory").queryName("bulk").start()
    q.awaitTermination()
    assert {(r["record_id"], r["event_id"]): (r["event_type"], r["status"], r["embeddings"]) for r in spark.table("bulk").collect()} == got


def test_lifecycle_stream_is_the_replay(spark, tmp_path):
    e = lifecycle.from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    # files in the order of event ids, a micro-batch each
    for k in range(3):
        e.where(F.floor(F.col("event_id") / 400) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = lifecycle.stream(s).writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).format("memory").queryName("life").start()
    q.awaitTermination()
    cols = ["record_id", "event_id", "status", "virtual_version", "embeddings"]
    assert sorted(map(str, spark.table("life").select(cols).collect())) == sorted(map(str, lifecycle.replay(e).select(cols).collect()))


def test_sinks_stop_after_a_failure(spark, tmp_path):
    seen = []
    ev.ordered_sinks(ev.parquet_sink(str(tmp_path / "a")), lambda b, i: False, lambda b, i: seen.append(i))(spark.range(3), 7)
    assert not seen and spark.read.parquet(str(tmp_path / "a/batch=7")).count() == 3
