"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import filters, graph, paging, retrieval
from docweave.plans.registry import permission, query, records, table, vrecords

_DENSE = """dense AS (SELECT q.vec_id AS query_id, p.vec_id AS point_id, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS score
    FROM embeddings q JOIN embeddings p ON len(q.embedding) = len(p.embedding) WHERE q.vec_id % 20 = 0),
  dense_k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM dense)"""
_TERMS = """words AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS term FROM documents),
  lens AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS len FROM documents),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
  qt AS (SELECT item_id AS query_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS term FROM benchmark),
  qtf AS (SELECT query_id, term, count(*) AS qtf FROM qt GROUP BY ALL),
  sparse AS (SELECT query_id, tf.doc_id AS point_id, round(sum(qtf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT avg(len) FROM lens)))), 6) AS score
    FROM tf JOIN qtf USING (term) JOIN lens USING (doc_id) GROUP BY ALL),
  sparse_k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM sparse)"""
_FUSED = f"""{_DENSE}, {_TERMS}, legs AS (SELECT query_id, point_id, rank FROM dense_k WHERE rank <= 20 UNION ALL SELECT query_id, point_id, rank FROM sparse_k WHERE rank <= 20),
  fused AS (SELECT query_id, point_id, round(sum(1.0 / (60.0 + rank)), 9) AS score FROM legs GROUP BY ALL),
  fused_k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM fused)"""


def _points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"))


def _dense_queries(spark, d):
    return _points(spark, d).where("point_id % 20 = 0").withColumnRenamed("point_id", "query_id")


def _sparse_queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("point_id"), "text")


def _hits(spark, d, k=20):
    return retrieval.dense(_dense_queries(spark, d), _points(spark, d), k).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_DENSE} SELECT query_id, point_id, score, rank FROM dense_k WHERE rank <= 10")
def search_dense_topk(spark, d):
    return _hits(spark, d, 10)


@query(f"WITH {_TERMS} SELECT query_id, point_id, score, rank FROM sparse_k WHERE rank <= 10")
def search_bm25_topk(spark, d):
    return retrieval.bm25(_sparse_queries(spark, d), _docs(spark, d), 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_FUSED} SELECT query_id, point_id, score, rank FROM fused_k WHERE rank <= 10")
def search_hybrid_rrf(spark, d):
    return retrieval.hybrid(_dense_queries(spark, d), _sparse_queries(spark, d), _points(spark, d), _docs(spark, d), 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_DENSE} SELECT query_id, point_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY query_id, rank) AS seen FROM dense_k WHERE rank <= 20) WHERE seen = 1")
def search_multi_query_dedupe(spark, d):
    return retrieval.merge_queries(_hits(spark, d))


@query(
    f"""SELECT query_id, point_id, score, rank, virtual_id, record_id, record_name FROM (WITH {_DENSE} SELECT * FROM dense_k WHERE rank <= 20) h
    JOIN (SELECT record_id AS point_id, virtual_id FROM vrecords) v USING (point_id)
    JOIN (SELECT virtual_id, min(record_id) AS record_id FROM vrecords WHERE record_id IN (SELECT target FROM permission WHERE principal = 7) GROUP BY 1) m USING (virtual_id)
    JOIN (SELECT record_id, record_name FROM records) USING (record_id)""",
    "vrecords", "permission",
)
def search_permission_join(spark, d):
    v = vrecords(spark, d)
    mine = v.join(permission(spark, d).where("principal = 7").select(F.col("target").alias("record_id")), "record_id", "left_semi")
    return retrieval.visible(_hits(spark, d), v.select(F.col("record_id").alias("point_id"), "virtual_id"), mine.select("virtual_id", "record_id", "record_name"))


@query(
    f"""WITH {_DENSE}, v AS (SELECT min(doc_id) AS point_id FROM documents WHERE doc_id % 2 = 0 GROUP BY md5(text)),
    seen AS (SELECT d.query_id, d.point_id, d.score FROM dense d JOIN v USING (point_id))
    SELECT query_id, point_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM seen QUALIFY rank <= 10"""
)
def search_prefiltered_topk(spark, d):
    ok = table(spark, d, "documents").where("doc_id % 2 = 0").groupBy(F.md5(F.col("text").cast("binary"))).agg(F.min("doc_id").alias("point_id")).select("point_id")
    pts = _points(spark, d).join(ok, "point_id", "left_semi")
    return retrieval.dense(_dense_queries(spark, d), pts, 10).withColumn("rank", F.col("rank").cast("long"))


@query(
    """SELECT record_id, record_name, COALESCE(mime_type, CASE WHEN record_type IN ('FILE', 'MAIL') THEN 'application/x-' || lang END) AS mime_type, web_url
    FROM records JOIN (SELECT doc_id AS record_id, lang, text FROM documents) USING (record_id)
    WHERE text IS NOT NULL AND text <> '' AND COALESCE(mime_type, CASE WHEN record_type IN ('FILE', 'MAIL') THEN 'application/x-' || lang END) IS NOT NULL AND web_url IS NOT NULL""",
    "records",
)
def search_complete_rows(spark, d):
    docs = table(spark, d, "documents")
    side = docs.select(F.col("doc_id").alias("record_id"), F.concat(F.lit("application/x-"), "lang").alias("mime_type"))
    got = retrieval.enrich(records(spark, d), side, "record_id", ["mime_type"], F.col("record_type").isin("FILE", "MAIL"))
    got = got.join(docs.select(F.col("doc_id").alias("record_id"), "text"), "record_id")
    return filters.complete(got, "text", ["mime_type", "web_url"]).select("record_id", "record_name", "mime_type", "web_url")


@query(
    """SELECT doc_id, round(CASE WHEN trim(text) = '' OR lang = 'de' THEN COALESCE(s, 0) WHEN s IS NULL THEN r ELSE 0.3 * s + 0.7 * r END, 6) AS final_score FROM (
    SELECT doc_id, text, lang, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 100) / 100.0 END::DOUBLE AS s, ((doc_id * 37) % 101) / 101.0 AS r FROM documents) ORDER BY final_score DESC, doc_id LIMIT 50"""
)
def rerank_blend(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.when(F.col("lang") == "de", "image").otherwise("text").alias("block_type"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 100 / 100.0).alias("score"), (F.col("doc_id") * 37 % 101 / 101.0).alias("rerank_score"))
    got = retrieval.blend(docs, content="text").select("doc_id", F.round("final_score", 6).alias("final_score"))
    return paging.best_first(got, "final_score", "doc_id", 50)


@query("SELECT min(doc_id) AS doc_id, n_chars FROM documents GROUP BY md5(text), n_chars")
def compress_documents(spark, d):
    return retrieval.distinct_content(table(spark, d, "documents").select("doc_id", "n_chars", "text"), "text", "doc_id").select("doc_id", "n_chars")


@query(f"WITH {_DENSE} SELECT query_id, point_id, score FROM dense_k WHERE rank <= 3 ORDER BY score DESC, query_id, point_id LIMIT 50")
def search_global_sort(spark, d):
    return paging.sorted_by(_hits(spark, d, 3), ("score", "desc"), ("query_id", "asc"), ("point_id", "asc")).limit(50).select("query_id", "point_id", "score")


@query("SELECT v.virtual_id, min(v.record_id) AS record_id FROM vrecords v WHERE v.org_id = 'org1' AND v.connector_id IN ('src1', 'src2', 'src3') GROUP BY 1", "vrecords")
def service_account_records(spark, d):
    got = vrecords(spark, d).where(filters.tree(must={"org_id": "org1", "connector_id": ["src1", "src2", "src3"]}))
    return got.groupBy("virtual_id").agg(F.min("record_id").alias("record_id"))


@query(
    """SELECT * FROM (WITH reach AS (SELECT target FROM permission WHERE principal = 7 UNION SELECT b.src FROM belongs b JOIN (SELECT 'src' || (target % 20) AS g FROM permission WHERE principal = 7 AND role = 'OWNER') o ON b.dst = o.g)
    SELECT virtual_id, min(record_id) AS record_id FROM vrecords WHERE record_id IN (SELECT target FROM reach) GROUP BY 1)""",
    "vrecords", "permission", "belongs",
)
def accessible_virtual_ids(spark, d):
    from docweave.plans.registry import belongs

    p = permission(spark, d)
    key = lambda kind, c: F.concat(F.lit(kind), c.cast("string"))
    grants = p.select("principal", key("r", F.col("target")).alias("target")).union(p.where("role = 'OWNER'").select("principal", key("gsrc", F.col("target") % 20)))
    members = p.select(F.col("principal").alias("member"), "principal").distinct()
    inherits = belongs(spark, d).select(key("r", F.col("src")).alias("record"), key("g", F.col("dst")).alias("target"))
    v = vrecords(spark, d).withColumn("record_key", key("r", F.col("record_id")))
    return graph.accessible(F.lit(7), grants, members, inherits, v)
