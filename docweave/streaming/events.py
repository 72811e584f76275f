"""Event streams: envelopes, duplicates, latest state of entities, derived events, recovery, ordered sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "eventType string, timestamp long, payload string"


def kafka(spark: SparkSession, servers: str, topic: str, most: int = 1000) -> DataFrame:
    """A topic with its place in it; ``most`` bounds what a micro-batch takes, which is the back-pressure."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", most).load()
    return raw.select(F.col("value").cast("string").alias("value"), "topic", "partition", "offset", F.col("timestamp").alias("arrived"))


def envelopes(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Events parsed from JSON that may be encoded twice, and the rows that can't be parsed. The payload stays JSON."""
    from docweave.functions.text import decode_json

    got = raw.withColumn("_e", decode_json(F.col(value), ENVELOPE))
    good = F.col("_e").isNotNull() & F.col("_e.eventType").isNotNull()
    keep = [c for c in raw.columns if c != value]
    return got.where(good).select(*keep, "_e.*"), got.where(~F.coalesce(good, F.lit(False))).select(*raw.columns)


def once(events: DataFrame, keys: tuple[str, ...] = ("topic", "partition", "offset"), time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Events without repeats. With a time column, state is dropped after ``delay``."""
    if time and events.isStreaming:
        return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))


#: fixed values: the topics, each of which is a stream of its own
TOPICS = ("record-events", "entity-events", "sync-events", "health-check")


def topics(spark: SparkSession, servers: str, names: tuple[str, ...] = TOPICS, most: int = 1000) -> dict[str, DataFrame]:
    return {n: kafka(spark, servers, n, most) for n in names}


def files(spark: SparkSession, path: str, schema: str, most: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream, at most so many new files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most).parquet(path)


def drained(stream: DataFrame, path: str, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """All that a stream has now, written below ``path`` with its checkpoint there, and read back. A run that broke off goes on from the checkpoint; batches that come
    again overwrite their own folder."""
    schema = stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(sink or write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/out")


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """The newest event of each key, by partial aggregates."""
    rest = [c for c in events.columns if c not in (key,)]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_e")).select(key, "_e.*")


def derived(events: DataFrame, app: str = "app") -> DataFrame:
    """``<app>.start`` events for apps that were enabled."""
    return events.where("eventType = 'appEnabled'").select(F.concat(F.lower(app), F.lit(".start")).alias("eventType"), "timestamp", "payload")


#: fixed values: what an entity event does
KINDS = {
    "orgCreated": "active", "orgUpdated": "active", "orgDeleted": "deleted", "userAdded": "active", "userUpdated": "active", "userDeleted": "deleted", "appEnabled": "enabled", "appDisabled": "disabled",
}


def entity_state(events: DataFrame, key: str = "entity_id", order: str = "timestamp") -> DataFrame:
    """``key, kind, state, payload`` of each entity by its newest event; other kinds of event count as nothing."""
    state = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("eventType"))
    some = events.where(F.col("eventType").isin(*KINDS)).select(key, F.regexp_extract("eventType", "^[a-z]+", 0).alias("kind"), state.alias("state"), "payload", order)
    return some.groupBy(key, "kind").agg(F.max_by(F.struct("state", "payload"), order).alias("_e")).select(key, "kind", "_e.*")


def apply_entities(state: DataFrame, events: DataFrame, key: str = "entity_id", order: str = "timestamp") -> DataFrame:
    """The entity table (``key, kind, state, payload``) after a batch of events, for ``foreachBatch``; the newest event wins."""
    new = entity_state(events, key, order)
    return state.join(new, [key, "kind"], "left_anti").unionByName(new)


def newer(rows: DataFrame, points: DataFrame, source: str, time: str) -> DataFrame:
    """Rows of each source after its sync point (``source, offset``); a source without one is taken whole."""
    p = points.select(F.col(source).alias("_s"), F.col("offset").alias("_o"))
    return rows.join(p, rows[source] == F.col("_s"), "left").where(F.col("_o").isNull() | (F.col(time) > F.col("_o"))).drop("_s", "_o")


def advanced(points: DataFrame, rows: DataFrame, source: str, time: str) -> DataFrame:
    """Sync points after rows have been taken; a point never goes back."""
    seen = rows.select(source, F.col(time).alias("offset"))
    return points.select(source, "offset").unionByName(seen).groupBy(source).agg(F.max("offset").alias("offset"))


def recovery(records: DataFrame, status: str) -> DataFrame:
    """What a start after a crash does: records in progress run again, queued ones are turned off."""
    return records.withColumn("outcome", F.when(F.col(status) == "IN_PROGRESS", "RERUN").when(F.col(status) == "QUEUED", "AUTO_INDEX_OFF"))


def windowed_counts(events: DataFrame, time: str, key: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    got = events.withWatermark(time, late) if events.isStreaming else events
    return got.groupBy(F.window(time, size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def ordered_sinks(*sinks: Callable[[DataFrame, int], bool]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that gives each batch to the sinks in order; a sink that returns False stops those after it. Sinks get the batch id,
    so that a replayed batch can be told."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                if sink(batch, batch_id) is False:
                    break
        finally:
            batch.unpersist()

    return write


def parquet_sink(path: str, choose: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], bool]:
    """Each batch in a folder of its own, overwritten if it comes again."""

    def sink(batch: DataFrame, batch_id: int) -> bool:
        choose(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        return True

    return sink
