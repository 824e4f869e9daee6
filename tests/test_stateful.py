"""Streams that stop and go on: each command once, retries on time, joins, windows, late rows, checkpoints."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lexmere.sources.snapshots import Store
from lexmere.streaming import events as ev
from lexmere.streaming import stateful

T0 = dt.datetime(2024, 1, 1)


class Flow:
    """A folder of files that is read as a stream; run() takes what is new and ends, as if the stream were stopped."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, f"file://{path}", schema, 0

    def put(self, *rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def read(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")

    def run(self, out):
        q = out.writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/check").trigger(availableNow=True).start()
        q.awaitTermination(180)
        return q

    def rows(self):
        return self.spark.read.parquet(f"{self.path}/out").collect()


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_each_command_counts_once_over_restarts(spark, tmp_path):
    f = Flow(spark, tmp_path, "tenant_id string, idempotency_key string, command_id string, created_at timestamp")
    f.put(("t", "k", "c2", at(1)), ("t", "k", "c1", at(0)), ("u", "k", "d1", at(2)))
    f.run(stateful.once(f.read()))
    f.put(("t", "k", "c3", at(5)), ("t", "other", "e1", at(5)))
    f.run(stateful.once(f.read()))  # another query on the same checkpoint
    f.put(("t", "k", "c4", at(24 * 60 + 1)))  # a day later the key is free again
    f.run(stateful.once(f.read()))
    got = {r["command_id"]: (r["first"], r["first_command_id"]) for r in f.rows()}
    assert got == {"c1": (True, "c1"), "c2": (False, "c1"), "d1": (True, "d1"), "c3": (False, "c1"), "e1": (True, "e1"), "c4": (True, "c4")} and len(f.rows()) == 6


def test_retries_wait_longer_and_end(spark, tmp_path):
    f = Flow(spark, tmp_path, "projection_name string, event_id string, failed boolean, created_at timestamp")
    query = lambda: stateful.retries(f.read(), base_s=60)
    f.put(("p", "a", True, at(0)), ("p", "b", True, at(0)))
    f.run(query())
    f.put(("p", "x", True, at(2)))  # the watermark moves on: both are due
    f.run(query())
    f.put(("p", "a", True, at(3)), ("p", "b", False, at(3)))
    f.run(query())
    f.put(("p", "a", True, at(70)), ("p", "x", False, at(80)))  # a's second wait is an hour
    f.run(query())
    f.put(("p", "z", True, at(200)))
    f.run(query())
    got = sorted((r["event_id"], r["action"], r["failures"]) for r in f.rows() if r["event_id"] in "ab")
    assert got == [("a", "permanent", 3), ("a", "retry", 1), ("a", "retry", 2), ("b", "resolved", 1), ("b", "retry", 1)]


def test_streams_join_and_tell_what_is_missing(spark, tmp_path):
    kind = "key string, created_at timestamp"
    left, right = Flow(spark, tmp_path / "l", kind), Flow(spark, tmp_path / "r", kind)
    query = lambda: stateful.matched(left.read(), right.read(), ["key"], "10 minutes", late="5 minutes")
    left.put(("a", at(0)), ("b", at(0)), ("c", at(1)))
    right.put(("a", at(3)), ("c", at(30)))
    left.run(query())
    left.put(("z", at(300)))
    right.put(("z", at(301)))
    left.run(query())
    left.put(("y", at(600)))
    right.put(("y", at(600)))
    left.run(query())
    got = {r["left_key"]: r["right_created_at"] for r in left.rows()}
    assert got["a"] == at(3) and got["b"] is None and got["c"] is None and got["z"] == at(301)


def test_sliding_windows_and_late_rows(spark, tmp_path):
    f = Flow(spark, tmp_path, "event_type string, created_at timestamp")
    query = lambda: stateful.sliding_counts(f.read(), "20 minutes", "10 minutes", ["event_type"], late="10 minutes")
    f.put(("v", at(1)), ("v", at(12)), ("w", at(15)))
    f.run(query())
    f.put(("v", at(90)))
    f.run(query())
    f.put(("v", at(2)), ("v", at(95)))  # the first comes 78 minutes late
    q = f.run(query())
    assert stateful.late_rows(q) >= 1
    f.put(("v", at(500)))
    f.run(query())
    got = {(r["event_type"], (r["start"] - T0).total_seconds() / 60): r["n"] for r in f.rows()}
    assert got == {("v", -10): 1, ("v", 0): 2, ("v", 10): 1, ("w", 0): 1, ("w", 10): 1, ("v", 80): 2, ("v", 90): 2}


def test_checkpoints_move_with_the_data(spark, tmp_path):
    log, store = f"file://{tmp_path}/log", Store(spark, f"file://{tmp_path}/s")
    event = lambda n, tenant="t": (f"e{n}", f"d{n}", tenant, "DocumentIngested", 1, json.dumps({"doc_id": f"d{n}", "text": f"text {n}"}), at(n))
    ev.append(spark, log, [event(1), event(2), event(3, "u")])
    run = lambda: ev.start_projection(spark, log, store, f"file://{tmp_path}/check").awaitTermination(180)
    run()
    one = ev.checkpoint_of(store, "documents", "t")
    assert (one["last_event_id"], one["events"]) == ("e2", 2) and ev.checkpoint_of(store, "documents", "u")["events"] == 1 and ev.checkpoint_of(store, "documents", "x") is None
    ev.append(spark, log, [event(4), event(1)])  # an event again
    run()
    two = ev.checkpoint_of(store, "documents", "t")
    assert two["last_event_id"] == "e4" and two["batch_id"] > one["batch_id"] and store.table("documents").count() == 4
    versions = len(store.versions())
    batch = spark.createDataFrame([event(9)], spark.read.parquet(log).schema)
    ev.project_batch(store, batch, None, one["stream"], two["batch_id"])  # a batch that was applied before a crash
    assert len(store.versions()) == versions and store.table("documents").count() == 4


def test_sliding_windows_of_a_table_are_those_of_sql(spark, sf_dir, duck):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("created_at"))
    got = {(r["event_type"], r["start"]): r["n"] for r in stateful.sliding_counts(e, "2 hours", "1 hour", ["event_type"]).collect()}
    want = duck.sql("select event_type, time_bucket(interval 1 hour, ts) - s * interval 1 hour as start, count(*) as n from events, (select unnest([0, 1]) as s) group by 1, 2").fetchall()
    assert got == {(t, s): n for t, s, n in want}


