"""An append-only event log, projections of it, dead letters and idempotency keys."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from lexmere import schemas
from lexmere.operators.chunking import chunk_id_of
from lexmere.operators.relational import null_safe
from lexmere.sources.snapshots import Change, Store

TYPES = ("DocumentIngested", "ChunksAdded", "DocumentDeleted", "EntityCreated", "RelationCreated")
PERMANENT = 3
TTL = "INTERVAL 24 HOURS"


def numbered(log: DataFrame) -> DataFrame:
    """Adds version, counted from 1 within each aggregate by (created_at, event_id)."""
    return log.withColumn("version", F.row_number().over(Window.partitionBy("aggregate_id").orderBy("created_at", "event_id")).cast("long"))


def versions(log: DataFrame) -> DataFrame:
    return log.groupBy("aggregate_id").agg(F.max("version").alias("version"), F.count("*").alias("events"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def since(log: DataFrame, created_at: Any, event_id: Any, limit: int) -> DataFrame:
    """The next events after a position (created_at, event_id): ties at a limit's edge are not lost."""
    after = (F.col("created_at") > F.lit(created_at)) | ((F.col("created_at") == F.lit(created_at)) & (F.col("event_id") > F.lit(event_id)))
    return log.filter(after).orderBy("created_at", "event_id").limit(limit)


def failures(records: DataFrame) -> DataFrame:
    """projection_name, event_id, retry_count, permanent: failures counted by event; permanent from the third on."""
    return records.groupBy("projection_name", "event_id").agg(F.count("*").alias("retry_count")).withColumn("permanent", F.col("retry_count") >= PERMANENT)


def unseen(commands: DataFrame, keys: DataFrame, now: Column | None = None) -> DataFrame:
    """Commands whose idempotency_key has no live record with a result."""
    live = keys.filter(F.col("result").isNotNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > (F.current_timestamp() if now is None else now))))
    return commands.join(live.select("idempotency_key").distinct(), "idempotency_key", "left_anti")


class Idempotency:
    """Results of commands by key, for 24 hours."""

    def __init__(self, store: Store, tenant: str) -> None:
        self.store, self.tenant = store, tenant

    def check(self, key: str, now: dt.datetime) -> dict | None:
        row = self.store.table("idempotency_keys").filter((F.col("tenant_id") == self.tenant) & (F.col("idempotency_key") == key) & (F.col("expires_at") > F.lit(now)) & F.col("result").isNotNull()).head()
        return None if row is None else row.asDict()

    def record(self, key: str, command: str, payload: str, result: str | None, now: dt.datetime) -> None:
        row = self.store.spark.createDataFrame([(key, self.tenant, command, payload, result, now, now + dt.timedelta(hours=24))], schemas.IDEMPOTENCY)
        self.store.upsert({"idempotency_keys": row}, f"idempotency {key}")


class DeadLetters:
    def __init__(self, store: Store) -> None:
        self.store = store

    def record(self, failed: DataFrame) -> None:
        """failed: the columns of the table without retry_count and resolved; each record of a known event counts one retry more."""
        known = self.store.table("projection_dlq")
        keys = schemas.KEYS["projection_dlq"]
        before = known.select(*keys, F.col("retry_count").alias("__before"))
        rows = failed.join(before, list(keys), "left").withColumn("retry_count", (F.coalesce("__before", F.lit(0)) + 1).cast("int")).withColumn("resolved", F.lit(False)).drop("__before")
        self.store.upsert({"projection_dlq": rows}, "dead letters")

    def first(self, failed: DataFrame) -> Change:
        """The change that records events which are not known yet, once; known ones stay as they are."""
        return self.store.merge("projection_dlq", failed.withColumn("retry_count", F.lit(1)).withColumn("resolved", F.lit(False)), "ignore")

    def unresolved(self, projection: str | None = None) -> DataFrame:
        rows = self.store.table("projection_dlq").filter("not resolved")
        rows = rows if projection is None else rows.filter(F.col("projection_name") == projection)
        return rows.withColumn("permanent", F.col("retry_count") >= PERMANENT).orderBy("created_at", "event_id")

    def resolve(self, event_id: str, projection: str | None = None, tenant: str | None = None) -> None:
        """Marks an event's records, those of one projection and tenant if they are named."""
        given = {"event_id": event_id, "projection_name": projection, "tenant_id": tenant}
        own = reduce(lambda a, b: a & b, (F.col(c) == v for c, v in given.items() if v is not None))
        self.store.upsert({"projection_dlq": self.store.table("projection_dlq").filter(own).withColumn("resolved", F.lit(True))}, f"resolve {event_id}")


def append(spark: SparkSession, log_path: str, rows: list[tuple]) -> None:
    """Appends events to the log, a folder of Parquet files."""
    spark.createDataFrame(rows, schemas.EVENTS).coalesce(1).write.mode("append").parquet(log_path)


_PAYLOAD = "doc_id string, source string, source_type string, title string, text string, name string, entity_type string, source_entity_id string, target_entity_id string, relation_type string, chunks array<string>"


def checkpoint_of(store: Store, projection: str, tenant: str, stream: str | None = None) -> dict | None:
    """How far a projection has come for a tenant: the last event, how many, and the batch; of several streams the one that went farthest."""
    rows = store.table("projection_checkpoints").filter((F.col("projection_name") == projection) & (F.col("tenant_id") == tenant))
    rows = rows if stream is None else rows.filter(F.col("stream") == stream)
    row = rows.orderBy(F.desc("last_event_at"), F.desc("last_event_id")).head()
    return None if row is None else row.asDict()


def _advanced(store: Store, batch: DataFrame, projection: str, stream: str, batch_id: int) -> Change:
    """The change that moves the checkpoints of a batch's tenants on."""
    last = F.max(F.struct("created_at", "event_id"))
    rows = batch.groupBy("tenant_id").agg(last.alias("last"), F.count("*").alias("more"))
    known = store.table("projection_checkpoints").filter((F.col("projection_name") == projection) & (F.col("stream") == stream)).select("tenant_id", F.col("events").alias("before"), F.struct(F.col("last_event_at").alias("created_at"), F.col("last_event_id").alias("event_id")).alias("known"))
    rows = rows.join(known, "tenant_id", "left").withColumn("last", F.greatest("last", F.coalesce("known", "last")))
    return store.merge("projection_checkpoints", rows.select(
        F.lit(projection).alias("projection_name"), "tenant_id", F.lit(stream).alias("stream"), F.lit(batch_id).cast("long").alias("batch_id"), F.col("last.event_id").alias("last_event_id"),
        F.col("last.created_at").alias("last_event_at"), (F.coalesce("before", F.lit(0)) + F.col("more")).alias("events"), F.current_timestamp().alias("updated_at")))


def project_batch(store: Store, batch: DataFrame, embed: Callable[[Column], Column] | None = None, stream: str | None = None, batch_id: int | None = None) -> None:
    """One batch of events applied to the stored tables in one commit; events that can't be read become dead letters.

    Offsets advance for every event, whatever its type. Applying a batch twice changes nothing more. With a stream's name and batch number
    the checkpoints move in the same commit, and a batch that is in them already is passed over.
    """
    if stream is not None:
        done = store.table("projection_checkpoints").filter((F.col("projection_name") == "documents") & (F.col("stream") == stream)).agg(F.max("batch_id")).head()[0]
        if done is not None and batch_id <= done:
            return
    rows = batch.withColumn("p", F.from_json("payload", _PAYLOAD)).withColumn("p_ok", F.col("p").isNotNull() & F.col("event_type").isin(*TYPES) & F.coalesce(F.col("p.doc_id"), F.col("p.name"), F.col("p.source_entity_id")).isNotNull()).cache()
    try:
        good = rows.filter("p_ok")
        now = F.col("created_at")
        null = lambda t: F.lit(None).cast(t)
        docs = good.filter("event_type = 'DocumentIngested'").select(
            F.col("p.doc_id"), F.coalesce("p.source", "p.doc_id").alias("source"), F.coalesce("p.source_type", F.lit("text")).alias("source_type"), null("string").alias("language"), F.col("p.title"), F.col("p.text"),
            F.length("p.text").cast("long").alias("file_size"), F.lit(0).alias("chunk_count"), null("map<string,string>").alias("metadata"), "tenant_id", now)
        lists = good.filter("event_type = 'ChunksAdded'").withColumn("nth", F.row_number().over(Window.partitionBy("tenant_id", "p.doc_id").orderBy(F.desc("created_at"), F.desc("event_id")))).filter("nth = 1")
        chunks = lists.select("tenant_id", "created_at", F.col("p.doc_id"), F.posexplode("p.chunks").alias("chunk_index", "text"))
        full = chunks.select(chunk_id_of(F.col("tenant_id"), F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "doc_id", "chunk_index", "text", "tenant_id", "created_at")
        entity = good.filter("event_type = 'EntityCreated'").select(F.sha2(F.concat_ws("\u001f", "tenant_id", "p.name", "p.entity_type"), 256).alias("entity_id"), "tenant_id", F.col("p.name"), F.col("p.entity_type"))
        relation = good.filter("event_type = 'RelationCreated'").select(
            F.sha2(F.concat_ws("\u001f", "tenant_id", "p.source_entity_id", "p.target_entity_id", "p.relation_type"), 256).alias("relation_id"), "tenant_id", F.col("p.source_entity_id"), F.col("p.target_entity_id"), F.col("p.relation_type"), F.lit(1.0).alias("weight"))
        gone = good.filter("event_type = 'DocumentDeleted'").select("p.doc_id", "tenant_id", F.col("created_at").alias("gone_at"))

        def shaped(df: DataFrame, name: str) -> DataFrame:
            have = set(df.columns)
            fields = store.spark.createDataFrame([], schemas.TABLES[name]).schema.fields
            return df.select(*[F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in fields])

        def deleted(df: DataFrame, how: str) -> DataFrame:
            """The rows of df that a delete event of this batch is not older than, or (left_anti) the others."""
            g = gone.select(F.col("doc_id").alias("__d"), F.col("tenant_id").alias("__t"), "gone_at")
            return df.join(g, (F.col("doc_id") == F.col("__d")) & (F.col("tenant_id") == F.col("__t")) & (F.col("created_at") <= F.col("gone_at")), how)

        known, own = store.table("chunks"), ["tenant_id", "doc_id"]
        docs, full = deleted(shaped(docs, "documents"), "left_anti"), deleted(shaped(full, "chunks"), "left_anti")
        docs_key = list(schemas.KEYS["documents"])
        dead_docs = deleted(store.table("documents"), "left_semi").select(*docs_key)
        dropped = lists.select("tenant_id", F.col("p.doc_id").alias("doc_id")).unionByName(deleted(known, "left_semi").select(*own))
        latest = store.merge("documents", docs)
        changes = {
            "documents": Change(latest.rows, latest.gone.unionByName(dead_docs)), "chunks": Change(full, dropped),  # a list of chunks replaces the one before
            "entities": store.merge("entities", shaped(entity, "entities"), "ignore"), "relations": store.merge("relations", shaped(relation, "relations"), "ignore"),
        }
        if embed is not None:
            made = full.select("chunk_id", "tenant_id", embed(F.col("text")).alias("vector"), F.lit("projection").alias("embedding_model"), F.col("created_at").alias("embedded_at"))
            old = null_safe(known, dropped, own, "left_semi").select("tenant_id", "chunk_id")
            changes["chunk_vectors"] = Change(made, old)
        bad = rows.filter("not p_ok").select(F.lit("documents").alias("projection_name"), "tenant_id", "event_id", "event_type", F.lit("the payload can't be read").alias("error_message"), "created_at")
        if stream is not None:
            changes["projection_checkpoints"] = _advanced(store, rows, "documents", stream, batch_id)
        store.change(changes | {"projection_dlq": DeadLetters(store).first(bad)}, "projection")
    finally:
        rows.unpersist()


def start_projection(spark: SparkSession, log_path: str, store: Store, checkpoint: str, embed: Callable[[Column], Column] | None = None, files: int = 100) -> StreamingQuery:
    """Reads new event files in order of arrival and applies them batch by batch; ends when all are read. Repeated event ids are taken once."""
    stream = spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", files).parquet(log_path)
    once = stream.withWatermark("created_at", "1 day").dropDuplicatesWithinWatermark(["tenant_id", "event_id"])
    return once.writeStream.foreachBatch(lambda batch, number: project_batch(store, batch, embed, checkpoint, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and tumbling window of a stream; events later than ``late`` are dropped, windows close behind the watermark."""
    return stream.withWatermark("created_at", late).groupBy(F.window("created_at", width), "event_type").agg(F.count("*").alias("n"))


def replay(spark: SparkSession, log_path: str, store: Store, embed: Callable[[Column], Column] | None = None) -> None:
    """The projections anew, from the first event."""
    empty = {n: spark.createDataFrame([], schemas.TABLES[n]) for n in ("documents", "chunks", "chunk_vectors", "entities", "relations")}
    store.commit(empty, "replay")
    project_batch(store, spark.read.schema(schemas.EVENTS).parquet(log_path), embed)
