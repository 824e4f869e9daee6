"""Documents, entities and relations as aggregates: every write leaves its events, numbered within the aggregate, in the commit of its data.

A writer that expects an older version than the log has gets a conflict; one that commits at the same time does too,
by the store's own manifest. The events alone give the tables again.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmere import schemas
from lexmere.sources.snapshots import Change, ConflictError, Store
from lexmere.streaming.events import project_batch


def facts(rows: DataFrame, aggregate: str, event_type: str, payload: list[str], nth: int = 1) -> DataFrame:
    """aggregate_id, event_type, payload, nth: one event for each row, with the named columns as its payload."""
    return rows.select(F.col(aggregate).cast("string").alias("aggregate_id"), F.lit(event_type).alias("event_type"), F.to_json(F.struct(*payload)).alias("payload"), F.lit(nth).alias("nth"))


def emitted(store: Store, tenant: str, made: DataFrame) -> Change:
    """The change that puts facts into the log: versions go on from the last of each aggregate, in order of nth. An aggregate has one fact for each nth."""
    last = store.table("events").filter(F.col("tenant_id") == tenant).groupBy("aggregate_id").agg(F.max("version").alias("last"))
    rows = made.join(last, "aggregate_id", "left").withColumn("version", F.coalesce("last", F.lit(0)) + F.col("nth"))
    return Change(rows.select(
        F.sha2(F.concat_ws("\u001f", F.lit(tenant), "aggregate_id", F.col("version").cast("string")), 256).alias("event_id"), "aggregate_id", F.lit(tenant).alias("tenant_id"), "event_type",
        F.col("version").cast("long").alias("version"), "payload", F.current_timestamp().alias("created_at")))


class Document:
    """A document's own history: what it is now follows from its events, and commands that don't fit it are refused."""

    def __init__(self, store: Store, tenant: str, doc_id: str) -> None:
        self.store, self.tenant, self.doc_id = store, tenant, doc_id
        rows = store.table("events").filter((F.col("tenant_id") == tenant) & (F.col("aggregate_id") == doc_id)).select("version", "event_type").orderBy("version").collect()
        self.version, self.alive = 0, False
        for r in rows:
            self.version = r["version"]
            self.alive = r["event_type"] != "DocumentDeleted"

    def _append(self, event_type: str, payload: dict[str, Any], now: dt.datetime) -> int:
        """Commits one event after the version that was read; ConflictError if the log has gone on."""
        head = self.store.table("events").filter((F.col("tenant_id") == self.tenant) & (F.col("aggregate_id") == self.doc_id)).agg(F.max("version")).head()[0] or 0
        if head != self.version:
            raise ConflictError(f"{self.doc_id} is at version {head}, not {self.version}")
        n = self.version + 1
        spark = self.store.spark
        key = spark.range(1).select(F.sha2(F.concat_ws("\u001f", F.lit(self.tenant), F.lit(self.doc_id), F.lit(str(n))), 256)).head()[0]
        row = spark.createDataFrame([(key, self.doc_id, self.tenant, event_type, n, json.dumps(payload), now)], schemas.EVENTS)
        self.store.change({"events": Change(row)}, f"{event_type} {self.doc_id}")
        self.version, self.alive = n, event_type != "DocumentDeleted"
        return n

    def ingest(self, source: str, text: str, now: dt.datetime, source_type: str = "text", title: str | None = None) -> int:
        return self._append("DocumentIngested", {"doc_id": self.doc_id, "source": source, "source_type": source_type, "title": title, "text": text}, now)

    def add_chunks(self, chunks: list[str], now: dt.datetime) -> int:
        if not self.alive:
            raise ValueError(f"no such document: {self.doc_id}")
        return self._append("ChunksAdded", {"doc_id": self.doc_id, "chunks": chunks}, now)

    def delete(self, now: dt.datetime) -> int:
        if not self.alive:
            raise ValueError(f"no such document: {self.doc_id}")
        return self._append("DocumentDeleted", {"doc_id": self.doc_id}, now)


def catch_up(store: Store, embed: Callable[[Column], Column] | None = None, stream: str = "log") -> int:
    """Projects the log's events that no checkpoint of the stream has yet, as one batch; how many there were."""
    done = store.table("projection_checkpoints").filter(F.col("stream") == stream)
    last = done.select("tenant_id", F.struct(F.col("last_event_at").alias("created_at"), F.col("last_event_id").alias("event_id")).alias("done"))
    new = store.table("events").join(last, "tenant_id", "left").filter("done is null or struct(created_at, event_id) > done").drop("done")
    n = new.count()
    if n:
        number = done.agg(F.max("batch_id")).head()[0]
        project_batch(store, new.select(*store.table("events").columns), embed, stream, 0 if number is None else number + 1)
    return n


def replay(store: Store, embed: Callable[[Column], Column] | None = None) -> None:
    """Documents, chunks, vectors, entities and relations anew, from the log's first event on."""
    spark = store.spark
    store.commit({n: spark.createDataFrame([], schemas.TABLES[n]) for n in ("documents", "chunks", "chunk_vectors", "entities", "relations", "projection_checkpoints")}, "replay")
    catch_up(store, embed)
