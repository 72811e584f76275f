"""Further queries: access over several hops, chunking, content for models, listings, sync points, record and entity events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docweave.functions import numbers as nx
from docweave.functions import text as tx
from docweave.operators import dedup, dml, filters, graph, paging, retrieval, shape, windows
from docweave.plans.registry import belongs, memory, nesting, permission, query, records, table, vrecords
from docweave.sources import delimited, documents, markup, sqltables
from docweave.streaming import events as ev
from docweave.streaming import lifecycle

L = lambda c: F.col(c).cast("long").alias(c)


# joins


@query("SELECT r.record_id, p.principal, p.role FROM records r LEFT JOIN permission p ON r.record_id = p.target", "records", "permission")
def left_all_matches(spark, d):
    p = permission(spark, d).withColumnRenamed("target", "record_id")
    return graph.all_matches(records(spark, d).select("record_id"), p, "record_id", ["principal", "role"])


@query("SELECT r.record_id, p.principal FROM records r JOIN (SELECT target, min(principal) AS principal FROM permission WHERE role = 'OWNER' GROUP BY 1) p ON r.record_id = p.target", "records", "permission")
def inner_first_match(spark, d):
    p = permission(spark, d).where("role = 'OWNER'").withColumnRenamed("target", "record_id")
    return graph.first_inner(records(spark, d).select("record_id"), p, "record_id", "principal", ["principal"])


@query(
    """SELECT virtual_id, min(record_id) AS record_id FROM vrecords WHERE connector_id IN (SELECT node FROM (WITH RECURSIVE down(node, hops) AS (
    SELECT DISTINCT 'src' || (target % 20), 0 FROM permission WHERE principal IN (7, 7 // 2, 7 // 4) AND role = 'OWNER' UNION ALL SELECT n.src, hops + 1 FROM down JOIN nesting n ON n.dst = down.node WHERE hops < 2) SELECT * FROM down))
    AND record_id IN (SELECT src FROM belongs) OR record_id IN (SELECT target FROM permission WHERE principal IN (7, 7 // 2, 7 // 4) AND role <> 'OWNER') GROUP BY 1""",
    "vrecords", "permission", "belongs", "nesting",
)
def accessible_over_hops(spark, d):
    p = permission(spark, d)
    key = lambda kind, c: F.concat(F.lit(kind), c.cast("string"))
    # users belong to groups of half their number, and groups to groups likewise; rights of owners are on record groups
    grants = p.where("role <> 'OWNER'").select("principal", key("r", F.col("target")).alias("target")).union(p.where("role = 'OWNER'").select("principal", key("gsrc", F.col("target") % 20)))
    members = p.select("principal").distinct().where("principal > 1").select(F.col("principal").alias("member"), F.expr("principal div 2").alias("principal"))
    members = members.unionByName(members.select(F.col("principal").alias("member"), F.expr("principal div 2").alias("principal")).where("member > 1")).distinct()
    inherits = belongs(spark, d).select(key("r", F.col("src")).alias("record"), key("g", F.col("dst")).alias("target"))
    nested = nesting(spark, d).select(key("g", F.col("src")).alias("src"), key("g", F.col("dst")).alias("dst"))
    v = vrecords(spark, d).withColumn("record_key", key("r", F.col("record_id")))
    return graph.accessible(F.lit(7), grants, members, inherits, v, nested, 2)


@query("SELECT o_orderkey AS record_id, record_name FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN records ON record_id = o_orderkey", "records")
def lookup_batch(spark, d):
    return sqltables.lookup_many(records(spark, d), table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"))).select("record_id", "record_name")


# filters and listings


@query("SELECT p_partkey FROM part WHERE p_size > 10 AND p_brand = 'Brand#1' AND (p_size % 3 = 0) AND (contains(lower(p_name), 'a') OR contains(lower(p_type), 'a'))")
def tool_search(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("category"), (F.col("p_size") > 10).alias("essential"), F.array(F.when(F.col("p_size") % 3 == 0, "third").otherwise("other"), F.lit("any")).alias("tags"))
    return filters.search_tools(p, "A", "Brand#1", ["third", "fourth"], True).select("p_partkey")


@query("SELECT record_id FROM records WHERE origin = 'UPLOAD' AND record_type IN ('OWNER', 'FILE', 'MAIL') AND created_at BETWEEN 1700000000000 AND 1700720000000 AND status IN ('COMPLETED', 'EMPTY', 'FAILED')", "records")
def listing_by_source(spark, d):
    names = {"source": "origin", "permissions": "record_type", "dates": "created_at", "statuses": "status"}
    got, _ = filters.listing(records(spark, d), names, strict=True, source="local", permissions=["OWNER", "FILE", "MAIL"], dates=(1700000000000, 1700720000000), statuses=["COMPLETED", "EMPTY", "FAILED"])
    return got.select("record_id")


@query("SELECT record_id, record_name FROM records ORDER BY record_name, record_id LIMIT 25 OFFSET 50", "records")
def listing_page(spark, d):
    return paging.record_listing(records(spark, d), "record_id", "recordName", "asc", 3, 25).select("record_id", "record_name")


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM part WHERE p_size % 5 <> 0 AND (contains(lower(p_name), '1') OR contains(lower(p_brand), '1'))")
def catalog_totals(spark, d):
    p = table(spark, d, "part").withColumn("internal", F.col("p_size") % 5 == 0)
    return paging.catalog_totals(p, "internal", ["p_name", "p_brand"], "p_name", "p_partkey", "1", 20)


@query("SELECT group_id, is_root FROM (SELECT DISTINCT source AS group_id, substr(source, 4)::BIGINT < 2 AS is_root FROM documents) ORDER BY is_root DESC, group_id LIMIT 12")
def folders_sorted(spark, d):
    g = table(spark, d, "documents").select(F.col("source").alias("group_id"), (F.substring("source", 4, 20).cast("long") < 2).alias("is_root")).distinct()
    return paging.sorted_by(g, ("is_root", "desc"), ("group_id", "asc")).limit(12)


@query("SELECT virtual_id, record_id FROM vrecords ORDER BY virtual_id, record_id LIMIT 100", "vrecords")
def document_order(spark, d):
    return paging.in_document_order(vrecords(spark, d).select("virtual_id", "record_id"), "virtual_id", "record_id").limit(100)


@query("SELECT conv_id, turn FROM memory WHERE kind = 'user_query' AND len(list_intersect(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ['the', 'is'])) > 0 ORDER BY conv_id DESC, turn LIMIT 10 OFFSET 10", "memory")
def saved_search_page(spark, d):
    m = memory(spark, d).where("kind = 'user_query'").where(filters.has_tokens("text", "The, IS"))
    return paging.page(m, [F.desc("conv_id"), F.asc("turn")], 2, 10, 100).select("conv_id", "turn")


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'Knowledge Base' WHEN event_type = 'view' THEN 'n' || event_id ELSE 'Drive' END AS label, event_type = 'click' AS is_collection, CASE WHEN event_type <> 'click' THEN 'drive' END AS type_key,
    CASE WHEN event_type <> 'click' THEN 'c' || user_id END AS connector_id, CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'a,b' ELSE '' END END AS collections FROM events WHERE event_type <> 'error'""")
def knowledge_sources(spark, d):
    t, i = F.col("event_type"), F.col("event_id")
    df = table(spark, d, "events").select(
        F.when(t == "view", F.concat(F.lit("n"), i)).alias("name"), F.when(t == "click", F.lit(" kb ")).otherwise("Drive Workspace").alias("type"), F.when(t != "error", F.concat(F.lit(" c"), "user_id")).alias("connector_id"),
        F.when(i % 2 == 0, '{"recordGroups": ["a", "", "b"]}').otherwise("not json").alias("filters"), "event_id",
    )
    # the event's number travels in the name
    got = filters.knowledge_sources(df.withColumn("name", F.concat_ws("#", F.coalesce("name", F.lit("")), "event_id")))
    parts = F.split("label", "#")
    label = F.when(parts[0] != "", parts[0]).otherwise(F.when(F.col("is_collection"), "Knowledge Base").otherwise(F.initcap("type_key")))
    return got.select(parts[1].cast("long").alias("event_id"), label.alias("label"), "is_collection", "type_key", "connector_id", F.array_join("collection_ids", ",").alias("collections")).where("is_collection or connector_id is not null")


@query("SELECT c_custkey AS Id, c_name AS Name, c_acctbal AS LastModifiedDate FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 15")
def object_listing(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("Id"), F.col("c_name").alias("Name"), F.col("c_acctbal").alias("LastModifiedDate"), "c_mktsegment")
    return sqltables.listing(c, None, F.col("c_mktsegment") == "BUILDING", 15)


# retrieval


_COS = """s AS (SELECT label::BIGINT AS label, vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], lag(embedding::DOUBLE[]) OVER w) AS distance FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
    t AS (SELECT label, quantile_cont(distance, 0.95) AS most FROM s GROUP BY 1)"""


@query(f"WITH {_COS} SELECT vec_id, sum(CASE WHEN distance > most + 1e-12 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id)::BIGINT AS chunk FROM s JOIN t USING (label)")
def semantic_chunks(spark, d):
    e = table(spark, d, "embeddings").select(L("label"), "vec_id", "embedding")
    return retrieval.chunks(e, "label", "vec_id", "embedding").select("vec_id", "chunk")


@query("SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE doc_id % 7 = 0)")
def tool_scoped_points(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", F.col("vec_id").alias("virtual_id"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("virtual_id"))
    return retrieval.scoped(p, docs, docs.where("virtual_id % 7 = 0")).select("vec_id")


@query("SELECT record_id, CASE status WHEN 'COMPLETED' THEN 200 WHEN 'QUEUED' THEN 503 WHEN 'EMPTY' THEN 200 WHEN 'FAILED' THEN 500 ELSE 404 END::BIGINT AS code FROM records", "records")
def status_codes(spark, d):
    s = F.col("status")
    name = F.when(s == "COMPLETED", "success").when(s == "QUEUED", "vector_db_not_ready").when(s == "EMPTY", "empty_response").when(s == "FAILED", "odd").otherwise("accessible_records_not_found")
    return records(spark, d).select("record_id", retrieval.status_code(name).cast("long").alias("code"))


@query("SELECT doc_id, 'row ' || i AS content, i AS block_index FROM (SELECT doc_id, unnest(range(doc_id % 4)) AS i FROM documents WHERE doc_id % 3 = 0) UNION ALL SELECT doc_id, lang, -1 FROM documents WHERE doc_id % 3 <> 0")
def nested_rows_flat(spark, d):
    i = F.col("doc_id")
    rows = F.transform(F.when(i % 4 > 0, F.sequence(F.lit(0).cast("long"), i % 4 - 1)).otherwise(F.array().cast("array<bigint>")), lambda x: F.struct(F.concat(F.lit("row "), x).alias("content"), x.alias("block_index")))
    hits = table(spark, d, "documents").select("doc_id", F.col("lang").alias("content"), F.lit(-1).cast("long").alias("block_index"), rows.alias("children"))
    return shape.flattened(hits, "children", i % 3 == 0)


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, kind, sum(CASE WHEN kind <> 'image' THEN greatest(1, n_chars // 4) ELSE 0 END) OVER w AS running, sum(CASE WHEN kind = 'image' THEN 1 ELSE 0 END) OVER w AS images
    FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'text' ELSE 'table_row' END AS kind FROM documents WHERE text <> '') WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE running <= 20000 AND (kind <> 'image' OR images <= 4)""")
def content_for_models(spark, d):
    i = F.col("doc_id")
    b = table(spark, d, "documents").withColumn("kind", F.when(i % 3 == 0, "image").when(i % 3 == 1, "text").otherwise("table_row")).withColumn("tokens", F.greatest(F.lit(1), F.expr("n_chars div 4")))
    return windows.prepared_content(b, "source", "doc_id", "kind", "text", "tokens", 20000, 4).select("doc_id", "source")


@query(
    """SELECT r.record_id, CASE WHEN done IS NOT NULL THEN 'reuse' WHEN busy IS NOT NULL THEN 'queue' ELSE 'process' END AS decision, COALESCE(done, busy) AS twin FROM (SELECT a.record_id,
    min(CASE WHEN b.status IN ('COMPLETED', 'EMPTY') THEN b.record_id END) AS done, min(CASE WHEN b.status = 'IN_PROGRESS' THEN b.record_id END) AS busy
    FROM vrecords a LEFT JOIN vrecords b ON a.md5 = b.md5 AND a.record_type = b.record_type AND a.size = b.size AND a.record_id <> b.record_id GROUP BY 1) r""",
    "vrecords",
)
def duplicate_by_all_keys(spark, d):
    return dedup.twin_decision(vrecords(spark, d)).select("record_id", "decision", "twin")


# changes


_NEW = "(SELECT c_custkey * 2 AS id, 'n' || c_custkey AS name FROM customer WHERE c_custkey % 3 = 0)"


def _old_new(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), c.where("c_custkey % 3 = 0").select((F.col("c_custkey") * 2).alias("id"), F.concat(F.lit("n"), "c_custkey").alias("name"))


@query(f"SELECT COALESCE(o.c_custkey, n.id) AS id, COALESCE(n.name, o.c_name) AS name FROM customer o FULL JOIN {_NEW} n ON o.c_custkey = n.id")
def insert_replace(spark, d):
    return dml.insert(*_old_new(spark, d), ["id"], "replace")[0]


@query(f"SELECT count(*) FILTER (id NOT IN (SELECT c_custkey FROM customer)) AS created, 0::BIGINT AS updated, count(*) FILTER (id IN (SELECT c_custkey FROM customer)) AS ignored, 0::BIGINT AS errors FROM {_NEW}")
def insert_ignore_counts(spark, d):
    return dml.insert(*_old_new(spark, d), ["id"], "ignore")[1]


def _edges(spark, d):
    p = permission(spark, d)
    return p.select(F.concat(F.lit("users/"), "principal").alias("src"), F.concat(F.when(F.col("target") % 2 == 0, "records/").otherwise("groups/"), "target").alias("dst"), F.col("role").alias("kind"))


_E = "(SELECT 'users/' || principal AS src, CASE WHEN target % 2 = 0 THEN 'records/' ELSE 'groups/' END || target AS dst, role AS kind FROM permission)"


@query(f"SELECT * FROM {_E} WHERE NOT (src = 'users/7' AND kind IN ('OWNER', 'READER'))", "permission")
def delete_edges_from(spark, d):
    return dml.delete_edges_of(_edges(spark, d), src="users/7", kinds=["OWNER", "READER"])


@query(f"SELECT * FROM {_E} WHERE dst <> 'records/8'", "permission")
def delete_edges_to(spark, d):
    return dml.delete_edges_of(_edges(spark, d), dst="records/8")


@query(f"SELECT * FROM {_E} WHERE dst NOT LIKE 'groups/%'", "permission")
def delete_edges_between(spark, d):
    return dml.delete_edges_of(_edges(spark, d), src_collection="users", dst_collection="groups")


@query("""SELECT COALESCE(o.src, n.src) AS src, COALESCE(o.dst, n.dst) AS dst, COALESCE(o.kind, n.kind) AS kind, COALESCE(n.w, o.w) AS w FROM (SELECT principal AS src, target AS dst, role AS kind, count(*) AS w FROM permission GROUP BY ALL) o
    FULL JOIN (SELECT principal AS src, target AS dst, 'READER' AS kind, 0::BIGINT AS w FROM permission GROUP BY ALL) n ON o.src = n.src AND o.dst = n.dst AND o.kind = n.kind""", "permission")
def relation_upsert(spark, d):
    p = permission(spark, d).select(F.col("principal").alias("src"), F.col("target").alias("dst"), F.col("role").alias("kind"))
    old = p.groupBy("src", "dst", "kind").agg(F.count("*").alias("w"))
    return dml.upsert(old, p.select("src", "dst", F.lit("READER").alias("kind"), F.lit(0).cast("long").alias("w")).distinct(), ["src", "dst", "kind"])


@query("""SELECT 'records/' || record_id AS src, record_type || '/' || record_id AS dst FROM records WHERE record_type IN ('FILE', 'MAIL') UNION SELECT 'records/1', 'old/1'""", "records")
def record_upsert_edges(spark, d):
    r = records(spark, d)
    empty = {"records": r.where("record_id < 3").select("record_id", "record_type", "record_name"), "FILE": r.where("false").select("record_id", "mime_type"), "MAIL": r.where("false").select("record_id", "web_url")}
    empty["is_of_type"] = spark.range(1).select(F.lit("records/1").alias("src"), F.lit("old/1").alias("dst"))
    return dml.upsert_records(empty, r, ["record_name"], {"FILE": ["mime_type"], "MAIL": ["web_url"]})["is_of_type"]


# record and entity events, sync points


@query("SELECT min(record_id) AS record_id, 'newRecord' AS event_type FROM records q WHERE status = 'QUEUED' AND EXISTS (SELECT 1 FROM records f WHERE f.status = 'FAILED' AND f.md5 = q.md5) GROUP BY md5", "records")
def queued_twins_started(spark, d):
    r = records(spark, d)
    return lifecycle.next_queued(r, r.where("status = 'FAILED'").select("record_id"))


@query("""SELECT r.record_id, COALESCE(t.s, r.status) AS status FROM records r LEFT JOIN (SELECT md5, arg_min(status, record_id) AS s FROM records WHERE status IN ('COMPLETED', 'EMPTY') GROUP BY 1) t ON t.md5 = r.md5 AND r.status = 'QUEUED'""", "records")
def queued_twins_settled(spark, d):
    v = vrecords(spark, d)
    return lifecycle.settle_queued(v, v.where("status in ('COMPLETED', 'EMPTY')").select("record_id")).select("record_id", "status")


@query("SELECT (SELECT count(*) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'fr')) AS deleted_count, (SELECT count(*) FROM documents WHERE lang = 'fr') AS ids_processed")
def bulk_delete_counts(spark, d):
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("virtual_id"))
    return lifecycle.bulk_delete(p, table(spark, d, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("virtual_id")))[1]


_KIND = {"signup": "userAdded", "view": "userUpdated", "error": "userDeleted", "click": "appEnabled", "purchase": "appDisabled"}


@query("""SELECT user_id AS entity_id, kind, arg_max(state, event_id) AS state FROM (SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'purchase') THEN 'app' ELSE 'user' END AS kind,
    CASE event_type WHEN 'error' THEN 'deleted' WHEN 'click' THEN 'enabled' WHEN 'purchase' THEN 'disabled' ELSE 'active' END AS state FROM events) GROUP BY 1, 2""")
def entity_states(spark, d):
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in _KIND.items() for x in kv]), F.col("event_type"))
    e = table(spark, d, "events").select(F.col("user_id").alias("entity_id"), kind.alias("eventType"), F.col("event_id").alias("timestamp"), F.col("props").alias("payload"))
    state = ev.entity_state(e.where("timestamp % 2 = 0"))
    # the newer half comes as a batch of its own only where it is newer, so the whole is taken anew
    return ev.apply_entities(state, e).select("entity_id", "kind", "state")


@query("SELECT event_id FROM events WHERE user_id % 3 = 0 OR event_id > user_id * 10")
def incremental_rows(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id")
    points = e.where("user_id % 3 <> 0").select("user_id", (F.col("user_id") * 10).alias("offset")).distinct()
    return ev.newer(e, points, "user_id", "event_id").select("event_id")


@query("SELECT user_id, greatest(max(event_id), 500) AS offset FROM events GROUP BY 1")
def sync_points_advanced(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id")
    return ev.advanced(e.select("user_id", F.lit(500).cast("long").alias("offset")).distinct(), e, "user_id", "event_id")


@query("SELECT lower(event_type) || '.start' AS event_type, count(*) AS n FROM events GROUP BY 1")
def derived_events(spark, d):
    e = table(spark, d, "events").select(F.lit("appEnabled").alias("eventType"), F.col("event_id").alias("timestamp"), F.col("props").alias("payload"), F.col("event_type").alias("app"))
    return ev.derived(e).groupBy(F.col("eventType").alias("event_type")).agg(F.count("*").alias("n"))


@query("SELECT epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_counts(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return ev.windowed_counts(e, "ts", "event_type").select(F.unix_millis("window_start").alias("hour"), "event_type", "n")


def _place(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/docweave-streams"
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _event_stream(spark, d):
    schema = table(spark, d, "events").schema
    # a pattern, as a stream's path is else taken for a folder
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def event_dedupe_stream(spark, d):
    """Every event comes three times; the stream keeps one of each."""
    e = _event_stream(spark, d).select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("copy"), F.lit("record-events").alias("topic"), (F.col("event_id") % 4).alias("partition"), F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("ts"), "event_type").drop("copy")
    return ev.drained(ev.once(e, time="ts"), _place(spark)).groupBy("event_type").agg(F.count("*").alias("n"))


@query()
def record_lifecycle_stream(spark, d):
    return ev.drained(lifecycle.stream(lifecycle.from_events(_event_stream(spark, d))), _place(spark))


# scalars


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'BUG' WHEN 1 THEN 'STORY' WHEN 2 THEN 'TASK' WHEN 3 THEN 'Zebra' WHEN 4 THEN 'EPIC' ELSE 'IMPROVEMENT' END AS item_type,
    CASE WHEN o_orderkey % 8 = 0 THEN 'UNKNOWN' ELSE ['HIGHEST', 'HIGH', 'MEDIUM', 'LOW', 'LOWEST', 'LOWEST', 'LOWEST'][o_orderkey % 8] END AS priority, CASE o_orderkey % 3 WHEN 0 THEN 'ON_TRACK' WHEN 1 THEN 'HIGH_RISK' ELSE 'lost' END AS delivery, CASE o_orderkey % 3 WHEN 0 THEN 'DEPENDS_ON' WHEN 1 THEN 'MINE' ELSE 'odd' END AS relation FROM orders""")
def value_mapping(spark, d):
    i = F.col("o_orderkey")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (i % n + 1).cast("int"))
    return table(spark, d, "orders").select(
        "o_orderkey", nx.item_type(pick(6, " BUGS", "A User story!", "tas", "Zebra", "big epic", "Enhancement")).alias("item_type"), nx.priority(F.concat(F.when(i % 2 == 0, "P").otherwise(""), i % 8)).alias("priority"),
        nx.mapped(pick(3, "On-Track", "highrisk", "lost"), nx.DELIVERY).alias("delivery"), nx.relation(pick(3, "Depends On", "mine", "odd"), {"mine": "MINE"}).alias("relation"),
    )


@query("""SELECT o_orderkey, list_count(list_filter(days, lambda x: isodow(x) = 6)) AS saturdays, list_count(list_filter(days, lambda x: isodow(x) = 7)) AS sundays, 1::BIGINT AS holidays, CASE WHEN isodow(s + INTERVAL 1 DAY) < 6 THEN 1 ELSE 0 END::BIGINT AS holidays_on_weekdays, 10::BIGINT AS total_days
    FROM (SELECT o_orderkey, o_orderdate::DATE AS s, generate_series(o_orderdate::DATE, o_orderdate::DATE + INTERVAL 9 DAY, INTERVAL 1 DAY) AS days FROM orders)""")
def exclusion_counts(spark, d):
    s = F.col("o_orderdate").cast("date")
    b = nx.exclusion_breakdown(s, F.date_add(s, 9), F.array(F.date_add(s, 1), F.date_add(s, 1), F.date_add(s, 40)))
    return table(spark, d, "orders").select("o_orderkey", *[b[k].cast("long").alias(k) for k in ("saturdays", "sundays", "holidays", "holidays_on_weekdays", "total_days")])


@query("SELECT event_id, (epoch_us(ts) // 1000000) * 1000 AS ms FROM events")
def feed_times(spark, d):
    t = F.col("ts").cast("timestamp")
    parts = F.array(F.year(t), F.month(t), F.day(t), F.hour(t), F.minute(t), F.second(t), F.lit(0))
    return table(spark, d, "events").select("event_id", nx.feed_time_ms(parts).alias("ms"))


@query("SELECT doc_id, 'Row 1: {' || chr(10) || '  \"lang\": \"' || lang || '\",' || chr(10) || '  \"note\": null' || chr(10) || '}' || chr(10) || 'Row 2: {' || chr(10) || '  \"lang\": \"a\\\"b\\n\",' || chr(10) || '  \"note\": \"' || source || '\"' || chr(10) || '}' AS rows FROM documents")
def numbered_rows(spark, d):
    rows = F.array(F.array(F.col("lang"), F.lit(None).cast("string")), F.array(F.lit('a"b\n'), F.col("source")))
    return table(spark, d, "documents").select("doc_id", tx.numbered_rows(F.array(F.lit("lang"), F.lit("note")), rows).alias("rows"))


@query("SELECT doc_id, '{\"a\": \"' || source || '\\n' || lang || '\\t\\u0001 \\\" x\"}' || chr(10) AS json FROM documents")
def json_repaired(spark, d):
    text = F.concat(F.lit('{"a": "'), "source", F.lit("\n"), "lang", F.lit('\t\x01 \\" x"}\n'))
    return markup.repair_json(table(spark, d, "documents").select("doc_id", text.alias("json")), "json")


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'fetch' WHEN 'view' THEN 'search' WHEN 'signup' THEN 'create/send' END AS action, CASE event_type WHEN 'click' THEN 'channels' WHEN 'signup' THEN 'message' END AS target,
    CASE WHEN event_type = 'view' THEN event_id || ' items' END AS result, CASE WHEN event_type IN ('click', 'view') THEN true WHEN event_type = 'signup' THEN false END AS data_available FROM events""")
def tool_summaries(spark, d):
    t, i = F.col("event_type"), F.col("event_id")
    text = F.when(t == "click", "I Retrieved the channels").when(t == "view", F.concat(F.lit("Found "), i, F.lit(" results"))).when(t == "signup", "message SENT").otherwise("nothing to tell")
    s = tx.tool_summary(text)
    return table(spark, d, "events").select("event_id", *[s[k].alias(k) for k in ("action", "target", "result", "data_available")])


@query("SELECT l_orderkey, string_agg(a || '-' || z, ',' ORDER BY a) AS ranges FROM (SELECT l_orderkey, min(l_linenumber) AS a, max(l_linenumber) AS z FROM (SELECT l_orderkey, l_linenumber, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <> 3)) GROUP BY l_orderkey, g) GROUP BY 1")
def children_as_ranges(spark, d):
    li = table(spark, d, "lineitem").where("l_linenumber <> 3")
    kids = li.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("block_index"), F.lit(None).cast("int").alias("block_group_index"))).alias("kids"))
    r = nx.child_ranges(F.col("kids"))["block_ranges"]
    return kids.select("l_orderkey", F.array_join(F.transform(r, lambda x: F.concat(x["start"], F.lit("-"), x["end"])), ",").alias("ranges"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) < 15 AND doc_id % 3 <> 0 AS merge FROM documents")
def blocks_to_merge(spark, d):
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    return table(spark, d, "documents").select("doc_id", nx.may_merge(words, F.lit(0), F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("merge"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(l_quantity / 100 * 50, 6) AS x, round(l_quantity / 50 * 20, 6) AS y, round(l_quantity * 72 / 300, 6) AS points, l_quantity < 10 AS ocr FROM lineitem")
def page_units(spark, d):
    q = F.col("l_quantity")
    shares = nx.normalised(nx.corners(q, q, q, q), F.lit(100.0), F.lit(50.0), flip=False)
    p = nx.denormalised(shares, F.lit(50.0), F.lit(20.0))
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), q.alias("x1"), F.lit(1.0).alias("y1"))
    ocr = nx.needs_ocr(F.lit(1000), F.array().cast("array<struct<width:int,height:int>>"), F.array(box), F.lit(1000.0))
    return table(spark, d, "lineitem").select("l_orderkey", L("l_linenumber"), F.round(p[0]["x"], 6).alias("x"), F.round(p[0]["y"], 6).alias("y"), F.round(nx.to_page_units(q, F.lit(300)), 6).alias("points"), ocr.alias("ocr"))


@query("SELECT conv_id, turn, 'Represent this document for retrieval: ' || trim(role) AS asked, 'https://mail/u' || conv_id || '@x.org/inbox' AS url FROM conversations")
def query_texts(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.preprocess_query(F.concat(F.lit(" "), "role", F.lit("\n")), "BGE-large").alias("asked"), tx.gmail_url(F.lit("https://mail/{user.email}/inbox"), F.concat(F.lit("u"), "conv_id", F.lit("@x.org"))).alias("url"))


# sources


@query("SELECT doc_id AS file, r AS row_number, CASE r WHEN 1 THEN 'a|b' WHEN 2 THEN source || '|x,y|' || lang ELSE 'one' END AS cells FROM documents, (VALUES (1), (2), (3)) t(r)")
def raw_delimited_rows(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.concat(F.lit("a;b\n"), "source", F.lit(';"x,y";'), "lang", F.lit("\none\n")).alias("content"))
    return delimited.raw_rows(files, "file", "content", ";").select("file", "row_number", F.array_join("cells", "|").alias("cells"))


@query("""SELECT doc_id AS file, i AS block_index, CASE i WHEN 2 THEN 1 WHEN 4 THEN 3 END::BIGINT AS parent, CASE i WHEN 0 THEN 'text' WHEN 1 THEN 'group' WHEN 2 THEN 'text' WHEN 3 THEN 'table' WHEN 4 THEN 'table_row' END AS kind,
    CASE i WHEN 0 THEN lang WHEN 2 THEN source WHEN 4 THEN 'n | ' || n_chars END AS text FROM documents, (SELECT unnest(range(5)) AS i) t""")
def document_blocks(spark, d):
    text = F.concat(
        F.lit('{"body": {"children": [{"$ref": "#/texts/0"}, {"$ref": "#/groups/0"}, {"$ref": "#/tables/0"}, {"$ref": "#/texts/0"}, {"$ref": "#/texts/9"}]}, "texts": [{"text": "'), "lang", F.lit('", "label": "title"}, {"text": "'), "source",
        F.lit('", "children": [{"$ref": "#/groups/0"}]}], "groups": [{"label": "list", "children": [{"$ref": "#/texts/1"}]}], "tables": [{"data": {"grid": [[{"text": "n"}, {"text": "'), "n_chars", F.lit('"}]]}}]}'),
    )
    files = table(spark, d, "documents").select(F.col("doc_id").alias("file"), text.alias("content"))
    return documents.document_blocks(files, "file", "content").select("file", "block_index", "parent", "kind", "text")
