"""Streams with state: commands taken once, retries on timers, joins of streams, sliding windows, late rows.

State lives in RocksDB beside the executors and in the query's checkpoint, so a stream that is stopped or loses an executor goes
on where it was. Times are event times; timers fire when the watermark passes them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

TTL_MS = 24 * 3600 * 1000
PERMANENT = 3

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> None:
    """Timers and typed state need the RocksDB state store; streams that have a checkpoint keep the store they began with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def _ms(time: Any) -> int:
    return int(time.timestamp() * 1000)


class _Once(StatefulProcessor):
    """State of a key: when its first command came, until ttl later."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.first = handle, handle.getValueState("first", "at long, command_id string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        at, winner = self.first.get() if self.first.exists() else (None, None)
        for r in sorted(rows, key=lambda r: (_ms(r["created_at"]), r["command_id"])):
            now, again = _ms(r["created_at"]), at is not None
            if again and now >= at + self.ttl:
                self.handle.deleteTimer(at + self.ttl)
                again = False
            if not again:
                at, winner = now, r["command_id"]
                self.first.update((at, winner))
                self.handle.registerTimer(at + self.ttl)
            yield Row(tenant_id=key[0], idempotency_key=key[1], command_id=r["command_id"], created_at=r["created_at"], first=not again, first_command_id=winner)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.first.clear()
        return iter([])

    def close(self) -> None:
        pass


def once(commands: DataFrame, late: str = "10 minutes", ttl_ms: int = TTL_MS) -> DataFrame:
    """tenant_id, idempotency_key, command_id, created_at, first, first_command_id: every command, and whether it is the first of its key within the time to live.

    commands: a stream with tenant_id, idempotency_key, command_id and created_at. Within a batch the earliest counts. A key is forgotten when
    the watermark, ``late`` behind the newest command, passes its time to live.
    """
    with_rocksdb(commands.sparkSession)
    schema = "tenant_id string, idempotency_key string, command_id string, created_at timestamp, first boolean, first_command_id string"
    rows = commands.select("tenant_id", "idempotency_key", "command_id", "created_at").withWatermark("created_at", late)
    return rows.groupBy("tenant_id", "idempotency_key").transformWithState(_Once(ttl_ms), schema, "append", "EventTime")


class _Retries(StatefulProcessor):
    """State of an event: how often it failed; a timer for its next try."""

    def __init__(self, base_s: float, permanent: int) -> None:
        self.base_s, self.permanent = base_s, permanent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("failures", "n int, due long")

    def _out(self, key: Any, what: str, n: int, at: int) -> Row:
        return Row(projection_name=key[0], event_id=key[1], action=what, failures=n, at_ms=at)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n, due = self.state.get() if self.state.exists() else (0, 0)
        for r in sorted(rows, key=lambda r: (_ms(r["created_at"]), not r["failed"])):
            if due:
                self.handle.deleteTimer(due)
                if due <= _ms(r["created_at"]):  # it was due before this row, however they came
                    yield self._out(key, "retry", n, due)
                due = 0
            if not r["failed"]:
                if n:
                    yield self._out(key, "resolved", n, _ms(r["created_at"]))
                n = 0
            elif n < self.permanent:
                n += 1
                if n == self.permanent:
                    yield self._out(key, "permanent", n, _ms(r["created_at"]))
                else:
                    due = _ms(r["created_at"]) + int(1000 * self.base_s**n)
                    self.handle.registerTimer(due)
        if n:
            self.state.update((n, due))
        else:
            self.state.clear()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.state.exists():
            n, due = self.state.get()
            if due and due <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.update((n, 0))
                yield self._out(key, "retry", n, due)

    def close(self) -> None:
        pass


def retries(outcomes: DataFrame, base_s: float = 2.0, late: str = "0 seconds", permanent: int = PERMANENT) -> DataFrame:
    """projection_name, event_id, action, failures, at_ms: what to do about failed events: retry when base_s ** failures seconds are over, permanent, or resolved.

    outcomes: a stream with projection_name, event_id, failed and created_at. A success clears the count; a permanent failure stays one until then.
    """
    with_rocksdb(outcomes.sparkSession)
    schema = "projection_name string, event_id string, action string, failures int, at_ms long"
    rows = outcomes.select("projection_name", "event_id", "failed", "created_at").withWatermark("created_at", late)
    return rows.groupBy("projection_name", "event_id").transformWithState(_Retries(base_s, permanent), schema, "append", "EventTime")


def matched(left: DataFrame, right: DataFrame, on: list[str], within: str, late: str = "10 minutes", how: str = "left_outer") -> DataFrame:
    """left's rows with right's of the same ``on`` up to ``within`` later, as left_* and right_*: two streams, each with created_at.

    With left_outer a row without a partner comes out once the watermark shows that none can come; so what stays unfinished is found, and the state is bounded.
    """
    sides = [df.withWatermark("created_at", late).select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns]) for df, p in ((left, "left"), (right, "right"))]
    same: Column = F.expr(f"right_created_at >= left_created_at and right_created_at <= left_created_at + interval {within}")
    for c in on:
        same = same & (F.col(f"left_{c}") == F.col(f"right_{c}"))
    return sides[0].join(sides[1], same, how)


def sliding_counts(stream: DataFrame, width: str, slide: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    """start, end, by, n, last_at of windows of ``width`` that begin every ``slide``; each comes out once, behind the watermark."""
    w = F.window("created_at", width, slide)
    counted = stream.withWatermark("created_at", late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.max("created_at").alias("last_at"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "last_at")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were left out, in the batches whose progress the query still has."""
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
