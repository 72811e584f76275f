"""The life of a record under new, update, reindex, delete and bulk-delete events, as a stream and as a batch replay.

State is kept by record. Rules: events without a record or before its new event are skipped, deletes excepted; new and reindex events of a completed record
change nothing; a record of an inactive connector is set aside, one of a missing connector is skipped; an update drops the embeddings
and gives a fresh virtual id; an unsupported type, a failure and an empty text each have a status of their own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "record_id long, event_id long, event_type string, connector string, supported boolean, outcome string"
OUT = "record_id long, event_id long, event_type string, status string, virtual_version long, embeddings string"
STATE = "status string, virtual_version long"


def step(status: str | None, version: int, e: dict) -> tuple[str | None, int, str]:
    """The next status and version, and what happens to the embeddings (keep, write, delete)."""
    kind = e["event_type"]
    if kind == "deleteRecord":
        return None, version, "delete"
    if kind not in ("newRecord", "reindexRecord", "updateRecord"):
        return status, version, "keep"
    if status is None and kind != "newRecord":
        return status, version, "keep"
    if kind != "updateRecord":
        if status == "COMPLETED":
            return status, version, "keep"
        if e["connector"] == "missing":
            return status, version, "keep"
        if e["connector"] == "inactive":
            return "AUTO_INDEX_OFF", version, "keep"
    fate = "delete" if kind == "updateRecord" else "keep"
    version += kind == "updateRecord"
    if not e["supported"]:
        return "FILE_TYPE_NOT_SUPPORTED", version, fate
    if e["outcome"] in ("FAILED", "EMPTY", "ENABLE_MULTIMODAL_MODELS"):
        return e["outcome"], version, fate
    return "COMPLETED", version, "write"


def _advance(record: int, rows: list[dict], status: str | None, version: int) -> tuple[list[tuple], str | None, int]:
    out = []
    for e in sorted(rows, key=lambda r: r["event_id"]):
        status, version, fate = step(status, version, e)
        out.append((record, e["event_id"], e["event_type"], status, version, fate))
    return out, status, version


_NAMES = [c.split()[0] for c in OUT.split(", ")]


def expand(events: DataFrame) -> DataFrame:
    """``EVENT`` rows with each bulkDeleteRecords event as one deleteRecord event for each of its ``record_ids`` (an array column, which other events
    have null; without that column there are none). A bulk event that names no record has no rows. Virtual ids are to be resolved to records before."""
    names = [c.split()[0] for c in EVENT.split(", ")]
    if "record_ids" not in events.columns:
        return events.select(*names)
    bulk = F.coalesce(F.col("event_type") == "bulkDeleteRecords", F.lit(False))
    ids = F.when(bulk, F.array_distinct(F.filter("record_ids", lambda x: x.isNotNull()))).otherwise(F.array("record_id"))
    kind = F.when(bulk, "deleteRecord").otherwise(F.col("event_type"))
    own = {"record_id": F.explode(ids).alias("record_id"), "event_type": kind.alias("event_type")}
    return events.select(*[own.get(c, F.col(c)) for c in names])


def stream(events: DataFrame) -> DataFrame:
    """Status changes of a stream of ``EVENT`` rows. A record's events are taken in the order of their ids within a micro-batch."""

    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, version = state.get if state.exists else (None, 0)
        rows = [r for f in frames for r in f.to_dict("records")]
        out, status, version = _advance(key[0], rows, status, version)
        state.update((status, version))
        yield pd.DataFrame(out, columns=_NAMES)

    return expand(events).groupBy("record_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def replay(events: DataFrame) -> DataFrame:
    """The same over a table of events: the checker of the stream, and the way to rebuild state. A record's events are bounded by its history."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_advance(key[0], frame.to_dict("records"), None, 0)[0], columns=_NAMES)

    return expand(events).groupBy("record_id").applyInPandas(run, OUT)


def with_connectors(events: DataFrame, apps: DataFrame) -> DataFrame:
    """Events with ``connector`` told from the static table ``apps`` (``connector_id, active``): active, inactive or missing. The events may be a stream."""
    a = apps.select(F.col("connector_id").alias("_id"), F.col("active").alias("_active"))
    got = events.join(a, events.connector_id == F.col("_id"), "left")
    connector = F.when(F.col("_id").isNull(), "missing").when(F.col("_active"), "active").otherwise("inactive")
    return got.withColumn("connector", connector).drop("_id", "_active")


def next_queued(records: DataFrame, ended: DataFrame, key: str = "record_id", same: tuple[str, ...] = ("md5",), status: str = "status") -> DataFrame:
    """``newRecord`` events for the first queued twin of each record that failed or needs other models; twins of one content are started once."""
    gone = records.join(ended.select(key), key, "left_semi").where(F.col(status).isin("FAILED", "ENABLE_MULTIMODAL_MODELS")).select(*same).distinct()
    queued = records.where(F.col(status) == "QUEUED").groupBy(*same).agg(F.min(key).alias(key))
    return queued.join(gone, list(same), "left_semi").select(key, F.lit("newRecord").alias("event_type"))


def settle_queued(records: DataFrame, done: DataFrame, key: str = "record_id", same: tuple[str, ...] = ("md5",), status: str = "status", virtual: str = "virtual_id") -> DataFrame:
    """Records with queued twins of a completed or empty record taking over its status and virtual id; of several the smallest one's."""
    d = records.join(done.select(key), key, "left_semi").where(F.col(status).isin("COMPLETED", "EMPTY"))
    d = d.groupBy(*[F.col(c).alias(f"_{c}") for c in same]).agg(F.min_by(F.struct(F.col(status).alias("s"), F.col(virtual).alias("v")), key).alias("_twin"))
    got = records.join(d, [F.col(c) == F.col(f"_{c}") for c in same], "left")
    queued = (F.col(status) == "QUEUED") & F.col("_twin").isNotNull()
    own = {status: F.when(queued, F.col("_twin.s")).otherwise(F.col(status)), virtual: F.when(queued, F.col("_twin.v")).otherwise(F.col(virtual))}
    return got.select(*[own[c].alias(c) if c in own else F.col(c) for c in records.columns])


def failed_status(extraction: str) -> Column:
    """The extraction status of a record that failed: what is completed stays so."""
    return F.when(F.col(extraction) == "COMPLETED", "COMPLETED").otherwise("FAILED")


def bulk_delete(points: DataFrame, ids: DataFrame, virtual: str = "virtual_id") -> tuple[DataFrame, DataFrame]:
    """The points that stay when those of the ids are deleted, and one row ``deleted_count, ids_processed``."""
    one = ids.select(virtual).where(F.col(virtual).isNotNull()).distinct()
    zero = F.lit(0).cast("long")
    gone = points.join(one, virtual, "left_semi").agg(F.count("*").alias("deleted_count"), zero.alias("ids_processed"))
    counts = gone.union(one.agg(zero, F.count("*"))).agg(F.sum("deleted_count").alias("deleted_count"), F.sum("ids_processed").alias("ids_processed"))
    return points.join(one, virtual, "left_anti"), counts


def from_events(events: DataFrame) -> DataFrame:
    """The test table of events as record events."""
    t = F.col("event_type")
    kind = F.when(t == "signup", "newRecord").when(t == "view", "reindexRecord").when(t == "error", "deleteRecord").otherwise("updateRecord")
    i = F.col("event_id")
    connector = F.when(i % 13 == 0, "inactive").when(i % 17 == 0, "missing").otherwise("active")
    return events.select(F.col("user_id").alias("record_id"), "event_id", kind.alias("event_type"), connector.alias("connector"), (i % 11 != 0).alias("supported"), F.when(i % 7 == 0, "FAILED").when(i % 19 == 0, "EMPTY").otherwise("OK").alias("outcome"))
