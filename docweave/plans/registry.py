"""Registered queries and views over the test tables, in both dialects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: the views that queries start from, as SQL for the other engine
VIEWS = {
    "records": """SELECT doc_id AS record_id, 'org' || (doc_id % 3) AS org_id, source AS connector_id, 'doc-' || doc_id AS record_name,
        CASE doc_id % 4 WHEN 0 THEN 'FILE' WHEN 1 THEN 'MAIL' WHEN 2 THEN 'WEBPAGE' ELSE 'TICKET' END AS record_type,
        CASE WHEN doc_id % 9 = 0 THEN 'UPLOAD' ELSE 'CONNECTOR' END AS origin, CASE WHEN doc_id % 7 <> 0 THEN 'text/plain' END AS mime_type,
        CASE WHEN doc_id % 6 <> 0 THEN 'https://x/record/' || doc_id END AS web_url, md5(text) AS md5, n_chars AS size,
        CASE doc_id % 5 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'QUEUED' WHEN 2 THEN 'IN_PROGRESS' WHEN 3 THEN 'FAILED' ELSE 'EMPTY' END AS status,
        1700000000000 + doc_id * 3600000 AS created_at FROM documents""",
    "vrecords": "SELECT r.*, v.virtual_id FROM records r JOIN (SELECT md5, min(record_id) AS virtual_id FROM records GROUP BY md5) v USING (md5)",
    "groups": "SELECT DISTINCT source AS group_id, CAST(substr(source, 4) AS BIGINT) AS n FROM documents",
    "nesting": "SELECT group_id AS src, 'src' || (n // 2) AS dst FROM groups WHERE n >= 1",
    "belongs": "SELECT doc_id AS src, source AS dst FROM documents WHERE doc_id % 11 <> 0",
    "permission": """SELECT user_id AS principal, event_id % (SELECT count(*) FROM documents) AS target,
        CASE event_type WHEN 'purchase' THEN 'OWNER' WHEN 'signup' THEN 'WRITER' WHEN 'click' THEN 'COMMENTER' ELSE 'READER' END AS role
        FROM events WHERE event_type <> 'error'""",
    "memory": "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user_query' ELSE 'bot_response' END AS kind, text FROM conversations WHERE role IN ('user', 'assistant')",
}
_NEEDS = {"vrecords": ["records"], "nesting": ["groups"]}


def sql(body: str, *views: str) -> str:
    names: list[str] = []
    for v in views:
        names += [x for x in [*_NEEDS.get(v, []), v] if x not in names]
    return ("WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in names) + " " if names else "") + body


def query(body: str | None = None, *views: str):
    def wrap(f):
        QUERIES[f.__name__] = f
        if body:
            ORACLE[f.__name__] = sql(body, *views)
        return f

    return wrap


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _case(n: int, *values: str):
    c, out = F.col("doc_id") % n, F
    for i, v in enumerate(values[:-1]):
        out = out.when(c == i, v)
    return out.otherwise(values[-1])


def records(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        i.alias("record_id"), F.concat(F.lit("org"), i % 3).alias("org_id"), F.col("source").alias("connector_id"), F.concat(F.lit("doc-"), i).alias("record_name"),
        _case(4, "FILE", "MAIL", "WEBPAGE", "TICKET").alias("record_type"), F.when(i % 9 == 0, "UPLOAD").otherwise("CONNECTOR").alias("origin"),
        F.when(i % 7 != 0, "text/plain").alias("mime_type"), F.when(i % 6 != 0, F.concat(F.lit("https://x/record/"), i)).alias("web_url"),
        F.md5(F.col("text").cast("binary")).alias("md5"), F.col("n_chars").alias("size"),
        _case(5, "COMPLETED", "QUEUED", "IN_PROGRESS", "FAILED", "EMPTY").alias("status"), (F.lit(1700000000000) + i * 3600000).alias("created_at"),
    )


def vrecords(spark: SparkSession, d: str) -> DataFrame:
    from docweave.operators.dedup import virtual_ids

    return virtual_ids(records(spark, d), "md5", "record_id")


def groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("source").alias("group_id"), F.substring("source", 4, 20).cast("long").alias("n")).distinct()


def nesting(spark: SparkSession, d: str) -> DataFrame:
    return groups(spark, d).where("n >= 1").select(F.col("group_id").alias("src"), F.concat(F.lit("src"), F.expr("n div 2")).alias("dst"))


def belongs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_id % 11 <> 0").select(F.col("doc_id").alias("src"), F.col("source").alias("dst"))


def permission(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").count()
    role = F.when(F.col("event_type") == "purchase", "OWNER").when(F.col("event_type") == "signup", "WRITER").when(F.col("event_type") == "click", "COMMENTER").otherwise("READER")
    return table(spark, d, "events").where("event_type <> 'error'").select(F.col("user_id").alias("principal"), (F.col("event_id") % n).alias("target"), role.alias("role"))


def memory(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "user_query").otherwise("bot_response")
    return table(spark, d, "conversations").where(F.col("role").isin("user", "assistant")).select("conv_id", "turn", kind.alias("kind"), "text")
