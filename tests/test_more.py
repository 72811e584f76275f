"""Operators, sources and streams that the registered queries don't cover in full."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docweave.functions import numbers as nx
from docweave.functions import text as tx
from docweave.functions.registry import ConnectorBuilder, FilterField, Registry
from docweave.operators import dml, filters, graph, paging, retrieval, windows
from docweave.plans import load
from docweave.sources import delimited, documents, markup, sqltables
from docweave.streaming import events, lifecycle

D = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# functions


def test_values_of_trackers(spark):
    rows = [("P7", "LOWEST"), ("p2", "HIGH"), ("0", "UNKNOWN"), ("Urgent", "HIGHEST"), ("px", "px"), ("", None), (None, None), ("9" * 30, "LOWEST")]
    df = spark.createDataFrame(rows, "given string, want string")
    assert [r["p"] for r in df.select(nx.priority(F.col("given")).alias("p")).collect()] == [w for _, w in rows]
    kinds = {"Sub-Task": "SUBTASK", "New bug report": "BUG", "Test Case": "TEST", "ep": "EPIC", "zzz": "zzz"}
    df = spark.createDataFrame(list(kinds.items()), "given string, want string")
    assert all(r["t"] == r["want"] for r in df.select("want", nx.item_type(F.col("given")).alias("t")).collect())


def test_time_zone_lines():
    from datetime import datetime

    assert nx.zone_line("Asia/Kolkata", datetime(2024, 1, 1)) == "**Time zone**: Asia/Kolkata (IST, UTC+05:30)"
    assert nx.zone_line("America/St_Johns", datetime(2024, 1, 1)).endswith("UTC-03:30)")
    assert nx.zone_line("No/Where") == "**Time zone**: No/Where" and nx.zone_line("  ") == nx.zone_line(None) == ""


def test_ranges(spark):
    got = one(spark, nx.ranges(F.array(*[F.lit(x) for x in (5, 1, 2, None, 2, 9)])))
    assert [(r["start"], r["end"]) for r in got] == [(1, 2), (5, 5), (9, 9)]
    assert one(spark, nx.ranges(F.array().cast("array<int>"))) == []


def test_mdx_and_json():
    assert markup.mdx("a\n\n\n\nb<Card>x</Card>c<Info>see <b>this</b></Info>d") == "a\n\nbc\n\n> **Note:**\n>\n> see <b>this\nd"
    assert markup.mdx("<CodeGroup>\nx\n</CodeGroup><Tab/>") == "x"
    broken = '{"a": "x\ny\\" z\x7f", "b":\n"\\\\"}\n'
    fixed = markup.repaired_json(broken)
    assert json.loads(fixed) == {"a": 'x\ny" z\x7f', "b": "\\"} and fixed.endswith("}\n")


def test_titles_and_records(spark):
    rows = ["http://h/a/b-c_d/", "http://h/", "h.org", "", None, "http://h/--"]
    df = spark.createDataFrame([(r,) for r in rows], "u string")
    assert [r["t"] for r in df.select(tx.url_title(F.col("u")).alias("t")).collect()] == ["b c d", "h", "h.org", "Untitled", "Untitled", "h"]


def test_registry(spark):
    r = Registry()

    @r.tool("calc", "double_it", "Doubles a number", "math", ("number",), True, "long")
    def double_it(x: int) -> int:
        return None if x is None else 2 * x

    @r.tool("text", "shout")
    def shout(s: str, mark: str = "!") -> str:
        """Louder."""
        return s.upper() + mark

    assert r.get("calc", "double_it").parameters == (("x", "long", True),) and r.get("text", "shout").parameters[1] == ("mark", "string", False)
    assert r.publish(spark) == ["calc_double_it", "text_shout"] and spark.sql("SELECT calc_double_it(21) AS x").first()["x"] == 42
    assert r.statistics() == {"total": 2, "essential": 1, "by_app": {"calc": 1, "text": 1}, "by_category": {"general": 1, "math": 1}}
    assert [x["name"] for x in filters.search_tools(r.table(spark), "LOUD").collect()] == ["shout"] and [t.name for t in r.of_category("math")] == ["double_it"]
    for bad in (lambda: r.tool("Calc", "x"), lambda: r.tool("a", ""), lambda: r.tool("calc", "double_it")(double_it)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        r.tool("a", "b", schema=["x"])


def test_connector_builder():
    c = ConnectorBuilder("drive").in_group("Office").add_filter_field(FilterField("since", "datetime")).every(15).build()
    assert (c.name, c.schedule_minutes, c.filters[0].kind) == ("drive", 15, "datetime")
    with pytest.raises(ValueError):
        ConnectorBuilder("drive").build()
    with pytest.raises(ValueError):
        ConnectorBuilder("x").add_filter_field(FilterField("a", "odd"))


# operators


def test_overlaps_by_buckets(spark):
    a = spark.createDataFrame([(1, k, 3 * k, 3 * k + 1 + k % 9) for k in range(60)], "g int, i int, start long, end long")
    b = spark.createDataFrame([(1, k, 5 * k, 5 * k + k % 4) for k in range(40)], "g int, j int, s_start long, s_end long")
    want = sorted(tuple(r) for r in graph.overlapping(a, b, "g").where("s_start < s_end").select("i", "j").collect())
    assert want and all(sorted(tuple(r) for r in graph.overlapping(a, b, "g", w).select("i", "j").collect()) == want for w in (1, 7, 1000))


def test_principals(spark):
    m = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1)], "member long, principal long")
    assert sorted(r[0] for r in graph.principals(F.lit(1), m, 2).collect()) == [1, 2, 3] and len(graph.principals(F.lit(1), m, 9).collect()) == 4


def test_prepared_content(spark):
    rows = [(1, 0, "image", "i"), (1, 1, "text", "aaaa"), (1, 2, "other", "x"), (1, 3, "image", "i"), (1, 4, "image", ""), (1, 5, "image", "i"), (1, 6, "table_row", "bbbb"), (1, 7, "text", "cccccccc"), (1, 8, "text", "d"), (1, 9, "image", "i")]
    df = spark.createDataFrame(rows, "g int, o int, kind string, data string").withColumn("n", F.length("data"))
    got = [r["o"] for r in windows.prepared_content(df, "g", "o", "kind", "data", "n", 10, 2).orderBy("o").collect()]
    assert got == [0, 1, 3, 6]  # two images, and nothing after the first overflow


def test_listing_refuses(spark):
    df = spark.range(1).selectExpr("id", "'a' AS record_name")
    for bad in ({"sort_by": "size"}, {"direction": "up"}, {"limit": 101}, {"number": 0}):
        with pytest.raises(ValueError):
            paging.record_listing(df, "id", **{"sort_by": "recordName", **bad})
    with pytest.raises(filters.FilterError):
        filters.listing(df, {"source": "record_name"}, source="odd")


def test_rerank_model(spark):
    hits = spark.createDataFrame([("ab", "abc"), ("q", None)], "query string, content string")

    def load():
        return lambda q, c: [float(len(set(x) & set(y))) for x, y in zip(q, c)]

    assert [r["rerank_score"] for r in retrieval.reranked(hits, "query", "content", load).collect()] == [2.0, 0.0]
    assert retrieval.empty_response("none", "vector_db_empty")["status_code"] == 503


def test_transactions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    a = spark.range(3)
    assert dml.in_transaction(spark, path, lambda t: (t.write("x", a), t.write("y", a.where("id = 1")))) == 0
    first = dml.Transaction(spark, path)
    assert (first.read("x").count(), first.read("y").count()) == (3, 1)

    def broken(t):
        t.write("x", a.where("false"))
        raise KeyError("no")

    with pytest.raises(KeyError):
        dml.in_transaction(spark, path, broken)
    assert dml.Transaction(spark, path).read("x").count() == 3
    seen = []

    def raced(t):
        t.write("x", t.read("x").union(spark.range(10, 11)))
        if not seen:  # another writer comes in between once
            seen.append(dml.in_transaction(spark, path, lambda o: o.write("x", o.read("x").union(spark.range(20, 21)))))

    assert dml.in_transaction(spark, path, raced) == 2
    last = dml.Transaction(spark, path)
    assert sorted(r[0] for r in last.read("x").collect()) == [0, 1, 2, 10, 20] and last.read("y").count() == 1 and first.read("x").count() == 3


def test_record_upsert(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {"records": t([(1, "FILE", "a")], "record_id long, record_type string, name string"), "FILE": t([(1, "pdf")], "record_id long, ext string"), "is_of_type": t([("records/1", "FILE/1")], "src string, dst string")}
    new = t([(1, "FILE", "b", "md"), (2, "FILE", "c", "txt")], "record_id long, record_type string, name string, ext string")
    got = dml.upsert_records(tables, new, ["name"], {"FILE": ["ext"]})
    assert sorted(tuple(r) for r in got["records"].select("record_id", "name").collect()) == [(1, "b"), (2, "c")]
    assert sorted(tuple(r) for r in got["FILE"].collect()) == [(1, "md"), (2, "txt")] and got["is_of_type"].count() == 2


# sources


def test_raw_rows_and_blocks(spark):
    df = spark.createDataFrame([(1, 'a,"b\nc"\n\nd\n'), (2, None), (3, "")], "f long, t string")
    assert [(r["file"], r["row_number"], r["cells"]) for r in delimited.raw_rows(df, "f", "t").orderBy("row_number").collect()] == [(1, 1, ["a", "b\nc"]), (1, 2, []), (1, 3, ["d"])]
    assert documents.blocks(None) == documents.blocks("[1") == documents.blocks("[]") == documents.blocks('{"body": 3}') == []
    deep = {"body": {"children": [{"$ref": "#/groups/0"}]}, "groups": [{"children": [{"$ref": f"#/groups/{k + 1}"}]} for k in range(3000)]}
    assert len(documents.blocks(json.dumps(deep))) == 3000


def test_files_and_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.txt").write_text("no")
    assert sorted(r["_c0"] for r in delimited.read_rows(spark, str(tmp_path / "a.csv")).collect()) == ["1", "x"]
    assert [r["path"].rsplit("/")[-1] for r in sqltables.read_objects(spark, str(tmp_path), "*.csv").select("path").collect()] == ["a.csv"]
    assert sqltables.read_objects(spark, str(tmp_path), after="2199-01-01T00:00:00").count() == 0
    delimited.write_csv(spark.range(2), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


def test_points_are_written_in_batches(spark, tmp_path):
    sqltables.write_points(spark.range(2500).withColumnRenamed("id", "point_id"), str(tmp_path / "p"), 1000, 2)
    files = list((tmp_path / "p").glob("*.parquet"))
    assert all(pd.read_parquet(f).shape[0] <= 1000 for f in files) and sum(pd.read_parquet(f).shape[0] for f in files) == 2500


def test_lookups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert sqltables.lookup(df, "k", 2) == {"k": 2, "v": "b"} and sqltables.lookup(df, "k", 9) is None
    assert sqltables.scroll(df, F.col("k") > 0, 1).count() == 1
    assert [len(b) for b in sqltables.pull(spark.range(25), 10)] == [10, 10, 5]
    assert sqltables.first_of(df, "v", k=1).collect()[0]["v"] == "a"


def test_indexed_table(spark):
    sqltables.write_indexed(spark.range(100).withColumn("g", F.col("id") % 3), "indexed_points", 4, ["id"], ["id"], ["g"])
    t = spark.table("indexed_points")
    assert t.where("id = 7").count() == 1 and "Exchange" not in t.groupBy("id").count()._jdf.queryExecution().executedPlan().toString().replace("ReusedExchange", "")
    spark.sql("DROP TABLE indexed_points")


def test_jdbc(spark):
    url = "jdbc:derby:memory:docweave;create=true"
    try:
        spark._jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    except Exception:
        pytest.skip("no embedded database")
    rows = spark.range(40).selectExpr("id AS ID", "concat('n', id) AS NAME")
    rows.limit(0).write.jdbc(url, "T", mode="overwrite")
    assert sqltables.write_counted(rows, url, "T") == 40
    got = sqltables.read_jdbc(spark, url, "T", "ID", (0, 40), 4)
    assert got.rdd.getNumPartitions() == 4 and got.where("ID >= 38").count() == 2 and sqltables.read_jdbc(spark, url, "T").count() == 40


# streams


def test_dedupe_stream_goes_on_after_a_crash(spark, tmp_path):
    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    rows = lambda a, z: spark.range(a, z).selectExpr("'t' AS topic", "id % 2 AS partition", "id AS offset", "timestamp_seconds(id + 1000) AS ts")
    schema = "topic string, partition long, offset long, ts timestamp"
    rows(0, 20).union(rows(0, 20)).coalesce(1).write.mode("append").parquet(str(src))
    stream = lambda: events.once(events.files(spark, str(src), schema), time="ts")
    assert events.drained(stream(), out).count() == 20
    rows(10, 30).coalesce(1).write.mode("append").parquet(str(src))
    calls = []

    def crash(batch, batch_id):
        calls.append(batch_id)
        batch.write.mode("overwrite").parquet(f"{out}/out/batch={batch_id}")
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        events.drained(stream(), out, sink=crash)
    got = events.drained(stream(), out)  # the batch comes again and overwrites its own folder
    assert calls and got.count() == 30 and got.select("offset").distinct().count() == 30


def test_lifecycle_stream_equals_replay(spark):
    queries = load()[0]
    batch, stream = (sorted(tuple(r) for r in queries[f"record_lifecycle_{n}"](spark, D).select("record_id", "event_id", "status", "virtual_version", "embeddings").na.fill("-").collect()) for n in ("batch", "stream"))
    assert batch == stream


def test_connectors_and_failures(spark):
    e = spark.createDataFrame([(1, "c1"), (2, "c2"), (3, "c3")], "record_id long, connector_id string")
    apps = spark.createDataFrame([("c1", True), ("c2", False)], "connector_id string, active boolean")
    assert {r["record_id"]: r["connector"] for r in lifecycle.with_connectors(e, apps).collect()} == {1: "active", 2: "inactive", 3: "missing"}
    df = spark.createDataFrame([("COMPLETED",), (None,)], "extraction string")
    assert [r["x"] for r in df.select(lifecycle.failed_status("extraction").alias("x")).collect()] == ["COMPLETED", "FAILED"]
    assert lifecycle.step("QUEUED", 0, {"event_type": "newRecord", "connector": "active", "supported": True, "outcome": "ENABLE_MULTIMODAL_MODELS"})[0] == "ENABLE_MULTIMODAL_MODELS"


def test_recovery_and_windows_on_streams(spark, tmp_path):
    spark.range(100).selectExpr("timestamp_seconds(id * 60) AS ts", "'k' AS key").write.parquet(str(tmp_path / "in"))
    s = events.files(spark, str(tmp_path / "in"), "ts timestamp, key string")
    got = events.drained(events.windowed_counts(s, "ts", "key"), f"file://{tmp_path}/o", "append")
    assert got.columns == ["window_start", "key", "n"]
