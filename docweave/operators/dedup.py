"""Duplicates among records: twins by content, what to do with a new twin, reference-counted deletes, taking over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: what a processed twin's status can be
DONE = ("COMPLETED", "EMPTY")


def virtual_ids(records: DataFrame, content_hash: str, key: str) -> DataFrame:
    """Records with ``virtual_id``: the smallest key of equal content. Pre-aggregated, so that a content which a third of all records
    share costs one row a task."""
    first = records.groupBy(content_hash).agg(F.min(key).alias("virtual_id"))
    return records.join(first, content_hash)


def twin_decision(records: DataFrame, key: str = "record_id", same: tuple[str, ...] = ("md5", "record_type", "size"), status: str = "status", virtual: str = "virtual_id") -> DataFrame:
    """``decision`` and ``twin`` of every record, as if it came anew beside the others: ``reuse`` the smallest twin that is done (completed with
    a virtual id, or empty), else ``queue`` behind the smallest in progress, else ``process``.

    Two smallest candidates a group tell each record its smallest *other* one, without a window over the group.
    """
    done = ((F.col(status) == DONE[0]) & F.col(virtual).isNotNull()) | (F.col(status) == DONE[1])
    busy = F.col(status) == "IN_PROGRESS"

    def two(c):
        # the smallest and the second smallest key of those that qualify, by partial aggregates
        return F.min(F.when(c, F.col(key)))

    own = records.withColumn("_done", F.coalesce(done, F.lit(False))).withColumn("_busy", F.coalesce(busy, F.lit(False)))
    one = own.groupBy(*same).agg(two(F.col("_done")).alias("_d1"), two(F.col("_busy")).alias("_b1"))
    on = [F.col(f"_k{i}").eqNullSafe(F.col(c)) for i, c in enumerate(same)]
    named = one.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(same)], "_d1", "_b1")
    got = own.join(named, on, "left").drop(*[f"_k{i}" for i in range(len(same))])
    rest = got.groupBy(*same).agg(F.min(F.when(F.col("_done") & (F.col(key) != F.col("_d1")), F.col(key))).alias("_d2"), F.min(F.when(F.col("_busy") & (F.col(key) != F.col("_b1")), F.col(key))).alias("_b2"))
    rest = rest.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(same)], "_d2", "_b2")
    got = got.join(rest, on, "left")
    d = F.when(F.col("_d1") != F.col(key), F.col("_d1")).otherwise(F.col("_d2"))
    b = F.when(F.col("_b1") != F.col(key), F.col("_b1")).otherwise(F.col("_b2"))
    decision = F.when(d.isNotNull(), "reuse").when(b.isNotNull(), "queue").otherwise("process")
    return got.select(*records.columns, decision.alias("decision"), F.coalesce(d, b).alias("twin"))


def deletable_points(points: DataFrame, records: DataFrame, deleted: DataFrame, virtual: str = "virtual_id", key: str = "record_id") -> DataFrame:
    """Points to delete with the records of ``deleted``: those whose virtual id no other record shares."""
    survivors = records.join(deleted, key, "left_anti").select(virtual).distinct()
    gone = records.join(deleted, key, "left_semi").select(virtual).distinct().join(survivors, virtual, "left_anti")
    return points.join(gone, virtual, "left_semi")


def copy_edges(edges: DataFrame, twins: DataFrame) -> DataFrame:
    """Edges with those of each twin added for its copy (``twin, copy``); existing ones aren't repeated."""
    more = edges.join(twins, edges.src == twins.twin).select(F.col("copy").alias("src"), *[c for c in edges.columns if c != "src"]).select(*edges.columns)
    return edges.union(more.distinct().join(edges, edges.columns, "left_anti"))
