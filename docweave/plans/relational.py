"""Filter, join, aggregation, window, page and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import aggregates, dedup, dml, filters, graph, paging, sets, windows
from docweave.operators.filters import Filter
from docweave.sources import sqltables
from docweave.plans.registry import belongs, groups, memory, nesting, permission, query, records, table, vrecords

NOW = 1700000000000 + 500 * 3600000
_R = "SELECT record_id FROM records WHERE "
L = lambda c: F.col(c).cast("long").alias(c)


def _where(name, body, condition):
    @query(_R + body, "records")
    def run(spark, d):
        return records(spark, d).where(condition()).select("record_id")

    from docweave.plans import registry

    registry.QUERIES[name] = registry.QUERIES.pop("run")
    registry.ORACLE[name] = registry.ORACLE.pop("run")


_T = lambda *a: lambda: Filter.make(*a).column(now_ms=NOW)
_where("filter_equality", "connector_id = 'src3'", lambda: F.col("connector_id") == "src3")
_where("filter_must_should_not", "org_id = 'org1' AND (record_type = 'FILE' OR status IN ('QUEUED', 'EMPTY')) AND NOT COALESCE(mime_type = 'text/plain', false)", lambda: filters.tree({"org_id": "org1", "origin": " "}, {"record_type": "FILE", "status": ["QUEUED", None, "EMPTY"]}, {"mime_type": "text/plain"}))
_where("filter_min_should_match", "(org_id = 'org1')::INT + (record_type = 'FILE')::INT + (status = 'EMPTY')::INT >= 2", lambda: filters.tree(should={"org_id": "org1", "record_type": "FILE", "status": "EMPTY"}, min_should_match=2))
_where("filter_empty_matches_nothing", "false", lambda: filters.tree({"org_id": None}, {"status": []}))
_where("filter_string_is", "record_name = 'doc-17'", _T("record_name", "string", "is", "doc-17"))
_where("filter_string_is_not", "mime_type <> 'text/html'", _T("mime_type", "string", "is_not", "text/html"))
_where("filter_string_is_empty", "mime_type IS NULL OR mime_type = ''", _T("mime_type", "string", "is_empty"))
_where("filter_string_not_empty", "web_url IS NOT NULL AND web_url <> ''", _T("web_url", "string", "is_not_empty"))
_where("filter_string_contains", "contains(record_name, '-7')", _T("record_name", "string", "contains", "-7"))
_where("filter_string_lacks", "NOT contains(record_name, '-7')", _T("record_name", "string", "does_not_contain", "-7"))
_where("filter_datetime_last_days", f"created_at BETWEEN {NOW} - 7 * 86400000 AND {NOW}", _T("created_at", "datetime", "last_7_days"))
_where("filter_datetime_after", f"created_at > {NOW}", _T("created_at", "datetime", "is_after", NOW))
_where("filter_datetime_between", f"created_at BETWEEN {NOW - 10**9} AND {NOW}", _T("created_at", "datetime", "is_between", {"start": NOW - 10**9, "end": NOW}))
_where("filter_number_between", "size BETWEEN 100 AND 900", _T("size", "number", "is_between", [100, 900]))
_where("filter_number_compare", "size >= 100 AND size < 5000", lambda: Filter.make("size", "number", "greater_than_or_equal", 100).column() & Filter.make("size", "number", "less_than", 5000).column())
_where("filter_list_in", "connector_id IN ('src1', 'src4')", _T("connector_id", "list", "equals", [{"id": "src1", "label": "One"}, "src4"]))
_where("filter_multiselect_not_in", "status NOT IN ('FAILED', 'EMPTY')", _T("status", "multiselect", "not_in", ["FAILED", "EMPTY"]))
_where("filter_boolean", "(record_id % 2 = 0) = true", lambda: Filter.make("x", "boolean", "is", True).column(F.col("record_id") % 2 == 0))
_where("filter_range_parameter", "size >= 200 AND size <= 4000", lambda: filters.between(F.col("size"), *filters.parse_range("gte:200,lte:4000,eq:7", 10**12)))
_where("filter_prefix", "starts_with(record_name, 'doc-1')", lambda: F.col("record_name").startswith("doc-1"))
_where("filter_path_or_name", "COALESCE(contains(lower(web_url), 'record/9'), false) OR contains(record_name, 'record/9')", lambda: filters.has_text(["web_url", "record_name"], "Record/9"))
_where("filter_needs_update", "web_url IS NOT NULL AND (mime_type IS NULL OR mime_type = '')", lambda: filters.needs_update("web_url", "mime_type"))


@query(_R + "status IN ('FAILED', 'QUEUED') AND org_id = 'org2'", "records")
def nodes_by_filters(spark, d):
    return filters.field_in(filters.nodes_by(records(spark, d), {"org_id": "org2"}), "status", ["FAILED", "QUEUED"], ["record_id"])


@query(_R + "record_id IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45)", "records")
def filter_large_list(spark, d):
    wanted = table(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey").distinct()
    return filters.field_in(records(spark, d), "record_id", wanted, ["record_id"])


@query("SELECT record_id, record_name FROM records WHERE record_id = 42", "records")
def point_lookup(spark, d):
    return sqltables.scroll(records(spark, d), F.col("record_id") == 42, 1).select("record_id", "record_name")


@query(
    """SELECT record_id FROM records WHERE contains(lower(record_name), '-1') AND record_type IN ('MAIL', 'FILE')""",
    "records",
)
def keyword_tag_search(spark, d):
    df = records(spark, d).withColumn("tags", F.array("record_type", "status"))
    return filters.search(df, "-1", ["record_name"], "tags", ["MAIL", "FILE"]).select("record_id")


@query("SELECT record_id, COALESCE(web_url, record_name) AS path, size > 1000 AS is_large, CASE WHEN mime_type IS NULL THEN 'unknown' ELSE 'known' END AS mime FROM records", "records")
def computed_projection(spark, d):
    return records(spark, d).select("record_id", F.coalesce("web_url", "record_name").alias("path"), (F.col("size") > 1000).alias("is_large"), F.when(F.col("mime_type").isNull(), "unknown").otherwise("known").alias("mime"))


@query("SELECT split_part('records/' || record_id, '/', 1) AS collection, split_part('records/' || record_id, '/', 2) AS node_key FROM records WHERE split_part('records/' || record_id, '/', 1) = 'records'", "records")
def identifier_parts(spark, d):
    coll, key = filters.id_parts(F.concat(F.lit("records/"), "record_id"))
    return records(spark, d).select(coll.alias("collection"), key.alias("node_key")).where("collection = 'records'")


@query(_R + "contains(lower(record_name), 'doc-2') AND record_type IN ('FILE', 'MAIL') AND size BETWEEN 10 AND 100000 AND connector_id IN ('src1','src2','src3','src4')", "records")
def listing_filters(spark, d):
    names = {"q": "record_name", "record_types": "record_type", "size": "size", "connector_ids": "connector_id"}
    got, _ = filters.listing(records(spark, d), names, strict=True, q="DOC-2", record_types=["FILE", "MAIL"], size=(10, 100000), connector_ids=["src1", "src2", "src3", "src4"])
    return got.select("record_id")


@query("SELECT record_id, CASE WHEN record_id % 3 = 0 THEN 'src1' ELSE 'src1,src2' END AS scope FROM records", "records")
def scope_fallback(spark, d):
    wanted = F.when(F.col("record_id") % 3 == 0, F.array(F.lit("src1"), F.lit("src9"))).otherwise(F.array(F.lit("src8")))
    return records(spark, d).select("record_id", F.array_join(filters.scope_column(wanted, F.array(F.lit("src1"), F.lit("src2"))), ",").alias("scope"))


@query("SELECT record_id, CASE WHEN record_id % 4 = 0 THEN false WHEN record_id % 3 = 0 THEN false ELSE true END AS enabled FROM records", "records")
def enabled_flags(spark, d):
    flag = F.when(F.col("record_id") % 3 == 0, False).when(F.col("record_id") % 3 == 1, True)
    return records(spark, d).select("record_id", filters.enabled_column(flag, F.col("record_id") % 4 == 0).alias("enabled"))


@query("SELECT conv_id, turn FROM memory WHERE kind = 'user_query' AND contains(lower(text), 'the') ORDER BY conv_id DESC, turn LIMIT 20", "memory")
def saved_search_history(spark, d):
    m = memory(spark, d).where("kind = 'user_query'").where(filters.has_text(["text"], "The"))
    return m.orderBy(F.desc("conv_id"), "turn").limit(20).select("conv_id", "turn")


@query("""SELECT event_id, event_type IN ('click') OR CAST(props::JSON->>'k' AS BIGINT) > 50 AS is_collection FROM events""")
def split_knowledge_sources(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "kb").otherwise("drive")
    groups_ = F.when(F.get_json_object("props", "$.k").cast("long") > 50, '{"recordGroups":["a"]}').otherwise("{}")
    return filters.split_sources(e.select("event_id", kind.alias("kind"), groups_.alias("f")), "kind", "f").select("event_id", "is_collection")


# joins


@query("SELECT b.src AS record_id, g.group_id, g.n FROM belongs b JOIN groups g ON b.dst = g.group_id WHERE g.n % 2 = 0", "belongs", "groups")
def hop_outbound(spark, d):
    return graph.outbound(belongs(spark, d), groups(spark, d).where("n % 2 = 0"), "group_id").select(F.col("src").alias("record_id"), "group_id", "n")


@query("SELECT p.principal, p.target, p.role, c.c_name AS name FROM permission p JOIN customer c ON p.principal = c.c_custkey WHERE p.target % 20 = 5", "permission")
def hop_inbound(spark, d):
    e = permission(spark, d).select(F.col("principal").alias("src"), F.col("target").alias("dst"), "role").where("dst % 20 = 5")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return graph.inbound(e, c, "c_custkey").select(F.col("src").alias("principal"), F.col("dst").alias("target"), "role", "name")


@query("SELECT a.record_id AS src, b.record_id AS dst FROM records a JOIN records b ON b.record_id = a.record_id // 2 AND a.connector_id = b.connector_id WHERE a.record_id > 0", "records")
def edge_both_ends(spark, d):
    r = records(spark, d)
    edges = r.where("record_id > 0").select(F.col("record_id").alias("src"), F.expr("record_id div 2").alias("dst"))
    return graph.both_ends(edges, r, "record_id", ["connector_id"]).select("src", "dst")


@query("SELECT record_id, p.principal, p.role FROM records LEFT JOIN (SELECT target, principal, role FROM permission QUALIFY row_number() OVER (PARTITION BY target ORDER BY principal, role) = 1) p ON record_id = target", "records", "permission")
def left_first_match(spark, d):
    p = permission(spark, d).withColumn("o", F.struct("principal", "role")).withColumnRenamed("target", "record_id")
    return graph.first_match(records(spark, d).select("record_id"), p, "record_id", "o", ["principal", "role"])


@query("SELECT r.record_id, b.dst AS group_id, n.dst AS parent FROM records r LEFT JOIN belongs b ON r.record_id = b.src LEFT JOIN nesting n ON b.dst = n.src", "records", "belongs", "nesting")
def multiway_left(spark, d):
    b = belongs(spark, d).select(F.col("src").alias("record_id"), F.col("dst").alias("group_id"))
    n = nesting(spark, d).select(F.col("src").alias("group_id"), F.col("dst").alias("parent"))
    return records(spark, d).select("record_id").join(b, "record_id", "left").join(n, "group_id", "left").select("record_id", "group_id", "parent")


@query("SELECT record_id, EXISTS (SELECT 1 FROM permission p WHERE p.target = r.record_id AND role = 'OWNER') AS owned FROM records r", "records", "permission")
def exists_flag(spark, d):
    p = permission(spark, d).where("role = 'OWNER'").select(F.col("target").alias("record_id"))
    return graph.with_flag(records(spark, d).select("record_id"), p, "record_id", "owned")


@query(_R + "record_id IN (SELECT target FROM permission WHERE role = 'WRITER')", "records", "permission")
def exists_semi(spark, d):
    return graph.having(records(spark, d).select("record_id"), permission(spark, d).where("role = 'WRITER'").select(F.col("target").alias("record_id")), "record_id")


@query(_R + "record_id NOT IN (SELECT src FROM belongs)", "records", "belongs")
def orphan_anti(spark, d):
    return graph.lacking(records(spark, d).select("record_id"), belongs(spark, d).select(F.col("src").alias("record_id")), "record_id")


@query(
    """SELECT node, string_agg(here, '/' ORDER BY hops DESC) AS path FROM (WITH RECURSIVE up(node, here, hops) AS (SELECT group_id, group_id, 0 FROM groups UNION ALL SELECT up.node, n.dst, hops + 1 FROM up JOIN nesting n ON up.here = n.src WHERE hops < 5) SELECT * FROM up) u
    WHERE here IN (SELECT group_id FROM groups) GROUP BY node""",
    "nesting",
)
def path_recursive(spark, d):
    return graph.paths(nesting(spark, d), groups(spark, d).withColumn("name", F.col("group_id")), "group_id", "name")


@query(
    """SELECT record_id FROM records WHERE connector_id IN (SELECT node FROM (WITH RECURSIVE down(node) AS (SELECT 'src2' UNION ALL SELECT n.src FROM down JOIN nesting n ON n.dst = down.node) SELECT * FROM down))""",
    "records", "nesting",
)
def descendant_search(spark, d):
    roots = groups(spark, d).where("group_id = 'src2'").select("group_id")
    return graph.within(records(spark, d), "connector_id", nesting(spark, d), roots).select("record_id")


@query("SELECT node, min(hops)::BIGINT AS hops FROM (WITH RECURSIVE down(node, hops) AS (SELECT 'src1', 0 UNION ALL SELECT n.src, hops + 1 FROM down JOIN nesting n ON n.dst = down.node WHERE hops < 2) SELECT * FROM down) GROUP BY node", "nesting")
def reindex_subtree(spark, d):
    return graph.descendants(nesting(spark, d), groups(spark, d).where("group_id = 'src1'").select("group_id"), 2).select("node", L("hops"))


@query("SELECT p.user_id, p.kind, CASE kind WHEN 'USER' THEN 'u' || c_custkey ELSE 'g' || s_suppkey END AS principal FROM (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'USER' ELSE 'GROUP' END AS kind FROM (SELECT DISTINCT user_id FROM events)) p LEFT JOIN customer ON kind = 'USER' AND c_custkey = user_id LEFT JOIN supplier ON kind = 'GROUP' AND s_suppkey = user_id WHERE c_custkey IS NOT NULL OR s_suppkey IS NOT NULL")
def principal_resolution(spark, d):
    p = table(spark, d, "events").select("user_id").distinct().select("user_id", F.when(F.col("user_id") % 2 == 0, "USER").otherwise("GROUP").alias("kind"), F.concat(F.lit("M"), "user_id").alias("email"), F.col("user_id").cast("string").alias("external_id"), F.lit("c").alias("connector_id"))
    u = table(spark, d, "customer").select(F.concat(F.lit("m"), "c_custkey").alias("email"), F.concat(F.lit("u"), "c_custkey").alias("user_id"))
    g = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("external_id"), F.lit("c").alias("connector_id"), F.concat(F.lit("g"), "s_suppkey").alias("group_id"))
    return graph.resolve_principals(p, u, g).select("user_id", "kind", "principal")


@query("SELECT DISTINCT c.c_custkey AS src, n.n_nationkey::BIGINT AS dst FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = 1")
def membership_edges(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation").where("n_regionkey = 1")
    pairs = c.select(F.col("c_name").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    nodes = c.select(F.col("c_name").alias("external_id"), F.col("c_custkey").alias("node_id")).union(n.select(F.concat(F.lit("n"), "n_nationkey"), F.col("n_nationkey").cast("long")))
    return graph.edges_by_external_ids(pairs, nodes)


@query("SELECT l_orderkey AS group_id, i AS index FROM (SELECT DISTINCT l_orderkey, unnest(generate_series(min_l, max_l)) AS i FROM (SELECT l_orderkey, min(l_linenumber)::BIGINT AS min_l, max(l_linenumber)::BIGINT AS max_l FROM lineitem GROUP BY 1))")
def range_expand_join(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("group_id")).agg(F.array(F.struct(F.min("l_linenumber").cast("long").alias("start"), F.max("l_linenumber").cast("long").alias("end"))).alias("r"))
    return graph.expand_ranges(g, "r")


@query("SELECT a.event_id AS line, b.event_id AS sentence FROM events a JOIN events b ON a.user_id = b.user_id AND epoch_ms(a.ts) < epoch_ms(b.ts) + 1800000 AND epoch_ms(a.ts) + 600000 > epoch_ms(b.ts) WHERE a.event_type = 'click' AND b.event_type = 'view'")
def interval_overlap(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    a = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("line"), F.col("t").alias("start"), (F.col("t") + 600000).alias("end"))
    b = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("sentence"), F.col("t").alias("s_start"), (F.col("t") + 1800000).alias("s_end"))
    return graph.overlapping(a, b, "user_id", 3_600_000).select("line", "sentence")


_ASKED = "(SELECT conv_id, turn, conv_id * 7 AS r, turn * 3 AS b FROM conversations)"


@query(f"""SELECT DISTINCT conv_id, target FROM (SELECT conv_id, 'https://x/record/' || r || '/preview#blockIndex=' || b AS target FROM {_ASKED} c
    WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = c.r AND c.b < x.n_chars % 7) AND NOT (r % 5 = 0 AND b = 3 AND r IN (SELECT doc_id FROM documents)) AND NOT (r % 4 = 0 AND b = 6 AND r IN (SELECT doc_id FROM documents))
    UNION ALL SELECT conv_id, 'ref' || turn FROM conversations WHERE turn % 2 = 1)""")
def hallucinated_citations(spark, d):
    from docweave.operators import shape

    c = table(spark, d, "conversations")
    text = F.concat(F.lit("see [1](https://x/record/"), F.col("conv_id") * 7, F.lit("/preview#blockIndex="), F.col("turn") * 3, F.lit(") or [2](ref"), "turn", F.lit(") and [not](http://other/"), "turn", F.lit(")"))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("record_id"), "doc_id", (F.col("n_chars") % 7).alias("n_blocks"))
    hits = docs.where("doc_id % 5 = 0").select("record_id", F.lit(3).cast("long").alias("block_index"))
    rows = docs.where("doc_id % 4 = 0").select("record_id", F.lit(6).cast("long").alias("block_index"))
    refs = c.where("turn % 2 = 0").select("conv_id", F.concat(F.lit("ref"), "turn").alias("ref"))
    return shape.unknown_citations(c.select("conv_id", text.alias("answer")), "conv_id", "answer", hits, docs.select("record_id", "n_blocks"), refs, rows).select("conv_id", "target").distinct()


@query("""SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 10 = 0 THEN 'hit' WHEN r.status = 'COMPLETED' THEN 'stored' ELSE 'unavailable' END AS source,
    CASE WHEN o_orderkey % 10 = 0 THEN 'hit ' || o_orderkey WHEN r.status = 'COMPLETED' THEN 'v' || r.virtual_id END AS content FROM orders LEFT JOIN vrecords r ON r.record_id = o_orderkey""", "vrecords")  # fmt: skip
def full_record_fetch(spark, d):
    want = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"))
    hits = want.where("record_id % 10 = 0").select("record_id", F.concat(F.lit("hit "), "record_id").alias("content"))
    v = vrecords(spark, d)
    blobs = v.select("virtual_id").distinct().select("virtual_id", F.concat(F.lit("v"), "virtual_id").alias("content"))
    return graph.fetched(want, hits, v, blobs)


# aggregates


@query("SELECT count(*) AS n FROM records WHERE connector_id = 'src1'", "records")
def count_filtered(spark, d):
    return records(spark, d).where("connector_id = 'src1'").agg(F.count("*").alias("n"))


_ST = ("COMPLETED", "QUEUED", "IN_PROGRESS", "FAILED")
_SUMS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in _ST)


@query(f"SELECT NULL::VARCHAR AS record_type, count(*) AS total, {_SUMS} FROM records UNION ALL SELECT record_type, count(*), {_SUMS} FROM records GROUP BY 1", "records")
def connector_stats_pivot(spark, d):
    cells = records(spark, d).groupBy("record_type", "status").agg(F.count("*").alias("cnt"))
    return aggregates.status_pivot(cells, "record_type", "status", "cnt", list(_ST))


@query("SELECT (SELECT count(*) FROM records) AS records, (SELECT count(*) FROM groups) AS groups, (SELECT count(*) FROM belongs) AS belongs, (SELECT count(*) FROM permission) AS permissions, (SELECT count(*) FROM nesting) AS nested", "records", "groups", "belongs", "permission", "nesting")
def graph_summary(spark, d):
    return aggregates.counts({"records": records(spark, d), "groups": groups(spark, d), "belongs": belongs(spark, d), "permissions": permission(spark, d), "nested": nesting(spark, d)})


@query("SELECT ((SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part))::BIGINT AS n")
def count_many(spark, d):
    return aggregates.total_count([table(spark, d, t) for t in ("customer", "supplier", "part")])


@query("SELECT record_id, CASE WHEN mime_type IS NULL THEN 'no record' ELSE 'not valid' END AS reason FROM records WHERE mime_type IS NULL OR web_url IS NULL", "records")
def validation_invalid(spark, d):
    return aggregates.invalid_nodes(records(spark, d), "record_id", F.col("mime_type").isNotNull(), F.col("web_url").isNotNull())


@query("SELECT count(*) AS total, count(mime_type) AS with_record, count(*) FILTER (mime_type IS NOT NULL AND web_url IS NOT NULL) AS valid, count(*) FILTER (mime_type IS NULL OR web_url IS NULL) AS invalid, count(*) FILTER (mime_type IS NULL OR web_url IS NULL) = 0 AS success FROM records", "records")
def validation_summary(spark, d):
    return aggregates.validation(records(spark, d), "record_id", F.col("mime_type").isNotNull(), F.col("web_url").isNotNull())


@query("SELECT role, count(*) AS n_groups, sum(n)::BIGINT AS n_members, round(avg(n), 6) AS avg_members FROM (SELECT principal, role, count(DISTINCT target) AS n FROM permission GROUP BY ALL) GROUP BY 1", "permission")
def group_statistics(spark, d):
    g = permission(spark, d).groupBy("principal", "role").agg(F.collect_set("target").alias("members"))
    return aggregates.group_statistics(g, "role", "members").withColumn("avg_members", F.round("avg_members", 6))


@query("SELECT 'record_type' AS facet, record_type AS value, count(*) AS n FROM records GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM records GROUP BY 2", "records")
def facet_counts(spark, d):
    return aggregates.facets(records(spark, d), "record_type", "status")


@query("SELECT record_type AS value, count(*) AS n FROM (SELECT * FROM records ORDER BY record_name, record_id LIMIT 50 OFFSET 50) GROUP BY 1", "records")
def facet_counts_page(spark, d):
    return aggregates.facets(paging.page(records(spark, d), [F.col("record_name"), F.col("record_id")], 2, 50), "record_type").select("value", "n")


@query("SELECT DISTINCT virtual_id FROM vrecords", "vrecords")
def distinct_virtual_ids(spark, d):
    return vrecords(spark, d).select("virtual_id").distinct()


@query("""SELECT source, max(n_chars) AS n_chars, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS lang, CASE WHEN count(DISTINCT lang) > 1 THEN (SELECT string_agg(x.lang, ',' ORDER BY f) FROM (SELECT lang, min(doc_id) AS f FROM documents y WHERE y.source = d.source GROUP BY 1) x) END AS langs,
    (SELECT string_agg(t, ',' ORDER BY f) FROM (SELECT t, min(doc_id * 2 + i) AS f FROM (SELECT doc_id, 0 AS i, 't' || (doc_id % 3) AS t FROM documents y WHERE y.source = d.source UNION ALL SELECT doc_id, 1, 'u' FROM documents y WHERE y.source = d.source) GROUP BY 1)) AS tags FROM documents d GROUP BY source""")
def metadata_merge(spark, d):
    docs = table(spark, d, "documents").withColumn("tags", F.array(F.concat(F.lit("t"), F.col("doc_id") % 3), F.lit("u")))
    got = aggregates.merge_metadata(docs, "source", "doc_id", ["lang"], ["tags"], ["n_chars"])
    return got.select("source", "n_chars", "lang", F.array_join("lang_all", ",").alias("langs"), F.array_join("tags", ",").alias("tags"))


@query("SELECT l_orderkey, min(l_quantity) AS x0, min(l_discount) AS y0, max(l_quantity) AS x1, max(l_discount) AS y1 FROM lineitem GROUP BY 1")
def bbox_union(spark, d):
    b = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x0"), F.col("l_discount").alias("y0"), F.col("l_quantity").alias("x1"), F.col("l_discount").alias("y1"))
    return aggregates.box_union(b, ["l_orderkey"]).drop("corners")


@query('SELECT l_orderkey, min(l) AS start, max(l) AS "end" FROM (SELECT l_orderkey, l, l - row_number() OVER (PARTITION BY l_orderkey ORDER BY l) AS g FROM (SELECT DISTINCT l_orderkey, l_linenumber::BIGINT AS l FROM lineitem)) GROUP BY l_orderkey, g')
def index_ranges(spark, d):
    return aggregates.index_ranges(table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("i")), ["l_orderkey"], "i")


@query("SELECT count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type <> 'view') AS misses, round(100.0 * count(*) FILTER (event_type = 'view') / count(*), 2) AS hit_rate, count(*) FILTER (event_type = 'error') AS expired FROM events")
def cache_statistics(spark, d):
    return aggregates.cache_statistics(table(spark, d, "events"), F.col("event_type") == "view", F.col("event_type") == "error")


@query("SELECT source, lang, rank FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY lang) AS rank FROM (SELECT DISTINCT source, lang FROM documents)) WHERE rank <= 2")
def top_entities(spark, d):
    return aggregates.top_values(table(spark, d, "documents"), "source", "lang", 2).select("source", "lang", L("rank"))


@query("SELECT source, median(n_chars) AS median FROM documents GROUP BY 1")
def median_size(spark, d):
    return aggregates.median_or(table(spark, d, "documents"), ["source"], "n_chars", 12.0)


@query("SELECT source, count(*) AS pages, count(*) FILTER (n_chars < 1500) AS flagged, count(*) FILTER (n_chars < 1500) >= ceil(count(*) * 0.5) AS vote FROM documents GROUP BY 1")
def page_vote(spark, d):
    return aggregates.page_vote(table(spark, d, "documents").withColumn("f", F.col("n_chars") < 1500), "source", "f")


@query("SELECT l_partkey, l_orderkey, string_agg(l_quantity::BIGINT, ',' ORDER BY l_linenumber, l_quantity, l_extendedprice) AS quantities, count(*) AS n FROM lineitem GROUP BY 1, 2")
def soldin_parallel_arrays(spark, d):
    li = table(spark, d, "lineitem").withColumn("o", F.struct("l_linenumber", "l_quantity", "l_extendedprice"))
    got = aggregates.parallel_arrays(li, ["l_partkey", "l_orderkey"], "o", {"quantities": "l_quantity", "prices": "l_extendedprice"})
    return got.select("l_partkey", "l_orderkey", F.array_join(F.transform("quantities", lambda x: x.cast("long").cast("string")), ",").alias("quantities"), F.size("prices").cast("long").alias("n"))


# windows


@query("SELECT conv_id, role, first_at, row_number() OVER (PARTITION BY conv_id ORDER BY first_at, role) AS number FROM (SELECT conv_id, role, min(turn) AS first_at FROM conversations GROUP BY ALL)")
def citation_numbers(spark, d):
    return windows.first_seen_numbers(table(spark, d, "conversations"), "conv_id", "role", "turn").select("conv_id", "role", "first_at", L("number"))


@query("SELECT doc_id, CASE WHEN n = 1 THEN lang ELSE lang || '_' || n END AS unique_name FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents)")
def header_dedupe(spark, d):
    return windows.suffix_repeats(table(spark, d, "documents"), ["source"], "lang", "doc_id").select("doc_id", "unique_name")


@query("SELECT doc_id, CASE WHEN c = 1 THEN lang ELSE lang || '_' || n END AS unique_name FROM (SELECT doc_id, lang, row_number() OVER w AS n, count(*) OVER (PARTITION BY source, lang) AS c FROM documents WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id))")
def slug_dedupe(spark, d):
    return windows.suffix_collisions(table(spark, d, "documents"), ["source"], "lang", "doc_id").select("doc_id", "unique_name")


@query("SELECT doc_id, (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id))::BIGINT AS running, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) <= 20000 AS within FROM documents")
def row_threshold_running(spark, d):
    return windows.running_gate(table(spark, d, "documents"), ["source"], "doc_id", "n_chars", 20000).select("doc_id", "running", "within")


@query("SELECT doc_id, running FROM (SELECT doc_id, (sum(greatest(1, n_chars // 4)) OVER (PARTITION BY source ORDER BY doc_id))::BIGINT AS running FROM documents) WHERE running <= 5000")
def token_budget(spark, d):
    docs = table(spark, d, "documents").withColumn("tokens", F.greatest(F.lit(1), F.expr("n_chars div 4")))
    return windows.token_budget(docs, "source", "doc_id", "tokens", 5000).select("doc_id", "running")


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id % 4, doc_id) AS r FROM documents) WHERE r <= 10")
def representative_rows(spark, d):
    return windows.fullest_rows(table(spark, d, "documents").withColumn("nulls", F.col("doc_id") % 4), "source", "doc_id", "nulls").select("doc_id", F.col("place").cast("long").alias("place"))


@query("SELECT conv_id, turn, kind FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM memory) WHERE r <= 3", "memory")
def last_n_pairs(spark, d):
    return windows.last_n(memory(spark, d), "conv_id", "turn", 3).select("conv_id", "turn", "kind")


@query("SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 7 AS batch FROM documents")
def fixed_batches(spark, d):
    return windows.fixed_batches(table(spark, d, "documents"), "source", "doc_id", 7).select("doc_id", "batch")


@query(
    """WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
    f(conv_id, turn, r, batch, held) AS (SELECT conv_id, turn, r, 0, n FROM o WHERE r = 1 UNION ALL
      SELECT o.conv_id, o.turn, o.r, CASE WHEN held > 0 AND held + n > 600 THEN batch + 1 ELSE batch END, CASE WHEN held > 0 AND held + n > 600 THEN n ELSE held + n END FROM f JOIN o ON o.conv_id = f.conv_id AND o.r = f.r + 1)
    SELECT conv_id, turn, batch::BIGINT AS batch FROM f"""
)
def greedy_batches(spark, d):
    return windows.greedy_batches(table(spark, d, "conversations").withColumn("n", F.length("text")), "conv_id", "turn", "n", 600)


@query("SELECT source, count(*) FILTER (f AND NOT p) AS runs FROM (SELECT source, n_chars > 1000 AS f, COALESCE(lag(n_chars > 1000) OVER (PARTITION BY source ORDER BY doc_id), false) AS p FROM documents) GROUP BY 1")
def projection_runs(spark, d):
    return windows.gap_runs(table(spark, d, "documents").withColumn("f", F.col("n_chars") > 1000), "source", "doc_id", "f")


# pages and sets


@query("SELECT record_id, record_name, size FROM records WHERE org_id = 'org1' ORDER BY size DESC, record_id LIMIT 25 OFFSET 25", "records")
def browse_page(spark, d):
    r = records(spark, d).where("org_id = 'org1'")
    return paging.page(r, paging.order(r, "size", "down", "record_id", {"size": "size", "name": "record_name"}), 2, 25).select("record_id", "record_name", "size")


@query("SELECT record_id, record_name FROM records ORDER BY record_name, record_id LIMIT 30", "records")
def browse_unknown_sort(spark, d):
    r = records(spark, d)
    return paging.page(r, paging.order(r, "nonsense", "asc", "record_id", {"size": "size", "name": "record_name"}), 1, 30).select("record_id", "record_name")


@query("SELECT 2::BIGINT AS page, 25::BIGINT AS page_limit, count(*) AS total, ceil(count(*) / 25)::BIGINT AS pages, 2 < ceil(count(*) / 25) AS has_next, true AS has_prev FROM records", "records")
def page_totals(spark, d):
    return paging.page_info(records(spark, d), 2, 25)


@query("SELECT record_id, created_at FROM records ORDER BY created_at DESC, record_id LIMIT 100", "records")
def recent_capped(spark, d):
    return paging.recent(records(spark, d), "created_at", "record_id").select("record_id", "created_at")


@query("SELECT p_partkey, p_name FROM part WHERE p_size % 5 <> 0 AND (contains(lower(p_name), '1') OR contains(lower(p_brand), '1')) ORDER BY lower(p_name), p_partkey LIMIT 20 OFFSET 20")
def catalog_page(spark, d):
    p = table(spark, d, "part").withColumn("internal", F.col("p_size") % 5 == 0)
    return paging.catalog_page(p, "internal", ["p_name", "p_brand"], "p_name", "p_partkey", "1", 2, 20).select("p_partkey", "p_name")


@query("SELECT target, principal FROM (SELECT target, principal FROM permission INTERSECT SELECT doc_id, doc_id % 150 FROM documents)", "permission")
def intersect_ids(spark, d):
    return sets.common(permission(spark, d).select("target", "principal"), table(spark, d, "documents").select(F.col("doc_id").alias("target"), (F.col("doc_id") % 150).alias("principal")))


@query("SELECT record_id FROM records EXCEPT SELECT target FROM permission WHERE role = 'READER'", "records", "permission")
def except_ids(spark, d):
    return sets.without(records(spark, d).select("record_id"), permission(spark, d).where("role = 'READER'").select("target"))


@query("SELECT doc_id, 'a,' || lang || CASE WHEN lang <> 'en' THEN ',en' ELSE '' END AS queries FROM documents")
def ordered_union(spark, d):
    both = sets.ordered_union(F.array(F.lit("a"), F.col("lang")), F.array(F.lit("en"), F.lit("a")))
    return table(spark, d, "documents").select("doc_id", F.array_join(both, ",").alias("queries"))


@query("SELECT k, min(doc_id) AS v FROM (SELECT doc_id % 100 AS k, doc_id FROM documents WHERE doc_id < 40 UNION ALL SELECT doc_id % 100, doc_id FROM documents WHERE doc_id >= 100 AND doc_id % 100 >= 40) GROUP BY k")
def append_dedupe(spark, d):
    docs = table(spark, d, "documents").select((F.col("doc_id") % 100).alias("k"), F.col("doc_id").alias("v"))
    return sets.append_new(docs.where("v < 40"), docs.where("v >= 100"), "k", "v")


# duplicates and changes


@query(
    """SELECT r.record_id, CASE WHEN d IS NOT NULL THEN 'reuse' WHEN b IS NOT NULL THEN 'queue' ELSE 'process' END AS decision, COALESCE(d, b) AS twin FROM (SELECT r.record_id,
      (SELECT min(o.record_id) FROM vrecords o WHERE o.md5 = r.md5 AND o.record_id <> r.record_id AND o.status IN ('COMPLETED', 'EMPTY')) AS d,
      (SELECT min(o.record_id) FROM vrecords o WHERE o.md5 = r.md5 AND o.record_id <> r.record_id AND o.status = 'IN_PROGRESS') AS b FROM vrecords r) r""",
    "vrecords",
)
def duplicate_reuse_status(spark, d):
    return dedup.twin_decision(vrecords(spark, d), same=("md5",)).select("record_id", "decision", "twin")


@query("SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT virtual_id FROM vrecords WHERE record_id % 4 = 0) AND vec_id NOT IN (SELECT virtual_id FROM vrecords WHERE record_id % 4 <> 0)", "vrecords")
def refcount_delete(spark, d):
    v = vrecords(spark, d)
    pts = table(spark, d, "embeddings").select("vec_id", F.col("vec_id").alias("virtual_id"))
    return dedup.deletable_points(pts, v, v.where("record_id % 4 = 0").select("record_id")).select("vec_id")


@query("SELECT src, dst FROM belongs UNION SELECT v.record_id, b.dst FROM vrecords v JOIN belongs b ON b.src = v.virtual_id WHERE v.record_id <> v.virtual_id", "belongs", "vrecords")
def copy_relationships(spark, d):
    twins = vrecords(spark, d).where("record_id <> virtual_id").select(F.col("virtual_id").alias("twin"), F.col("record_id").alias("copy"))
    return dedup.copy_edges(belongs(spark, d), twins)


def _changes(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.round("c_acctbal", 2).alias("bal"))
    new = c.where("id % 3 = 0").select((F.col("id") * 2).alias("id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("new"), "id")).alias("name"), F.lit(1.5).alias("bal"))
    return c, new


_CH = """WITH o AS (SELECT c_custkey AS id, c_name AS name, round(c_acctbal, 2) AS bal FROM customer), n AS (SELECT c_custkey * 2 AS id, CASE WHEN c_custkey % 2 = 0 THEN 'new' || c_custkey END AS name, 1.5::DOUBLE AS bal FROM customer WHERE c_custkey % 3 = 0)
  SELECT COALESCE(n.id, o.id) AS id, {name} AS name, {bal} AS bal FROM o FULL JOIN n ON o.id = n.id"""


@query(_CH.format(name="COALESCE(n.name, o.name)", bal="COALESCE(n.bal, o.bal)"))
def upsert_merge(spark, d):
    return dml.upsert(*_changes(spark, d), ["id"])


@query(_CH.format(name="CASE WHEN n.id IS NULL THEN o.name ELSE n.name END", bal="COALESCE(n.bal, o.bal)"))
def upsert_replace(spark, d):
    return dml.upsert(*_changes(spark, d), ["id"], "replace")


@query(_CH.format(name="CASE WHEN o.id IS NULL THEN n.name ELSE o.name END", bal="COALESCE(o.bal, n.bal)"))
def upsert_keep(spark, d):
    return dml.upsert(*_changes(spark, d), ["id"], "keep")


@query("WITH n AS (SELECT c_custkey * 2 AS id FROM customer WHERE c_custkey % 3 = 0) SELECT count(*) FILTER (id NOT IN (SELECT c_custkey FROM customer)) AS created, count(*) FILTER (id IN (SELECT c_custkey FROM customer)) AS updated, 0::BIGINT AS ignored, 0::BIGINT AS errors FROM n")
def insert_counts(spark, d):
    return dml.insert(*_changes(spark, d), ["id"], "update")[1]


@query("SELECT src, dst FROM belongs WHERE NOT (src % 5 = 0 AND dst = 'src3')", "belongs")
def delete_edges(spark, d):
    b = belongs(spark, d)
    return dml.delete(b, b.where("src % 5 = 0 and dst = 'src3'"))


@query("SELECT record_id, CASE WHEN connector_id = 'src2' THEN 'PAUSED' ELSE status END AS status FROM records WHERE NOT COALESCE(mime_type IS NULL AND size > 1000, false)", "records")
def overwrite_payload(spark, d):
    got = dml.delete_where(records(spark, d), F.col("mime_type").isNull() & (F.col("size") > 1000))
    return dml.overwrite(got, F.col("connector_id") == "src2", {"status": F.lit("PAUSED")}).select("record_id", "status")


@query("SELECT record_id, concat_ws(';', CASE WHEN NOT (size < 4000) THEN 'small' END, CASE WHEN mime_type IS NULL THEN 'mime_type is required' END) AS violations FROM records WHERE size >= 4000 OR mime_type IS NULL", "records")
def node_validation(spark, d):
    _, bad = dml.validate(records(spark, d), {"small": F.col("size") < 4000}, ["mime_type"])
    return bad.select("record_id", F.array_join("violations", ";").alias("violations"))


@query("""SELECT DISTINCT level, name FROM (SELECT 1::BIGINT AS level, lang AS name FROM documents UNION ALL SELECT 2, source FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT 3, CASE doc_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END FROM documents WHERE doc_id % 5 <> 0)""")
def taxonomy_upsert(spark, d):
    names = F.array("lang", F.when(F.col("doc_id") % 5 != 0, F.col("source")), F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"))
    named = table(spark, d, "documents").select(F.col("doc_id").alias("record"), names.alias("names"))
    nodes = spark.createDataFrame([(1, "en")], "level long, name string")
    return dml.taxonomy(nodes, spark.createDataFrame([], "src string, dst string"), named)[0]


@query("SELECT conv_id, turn AS version, md5(text) AS digest FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def newest_versions(spark, d):
    v = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("version"), F.md5(F.col("text").cast("binary")).alias("digest"))
    return dml.at_version(v, "conv_id")
