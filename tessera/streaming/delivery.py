"""Delivery of outbox events as stream state: claims, leases, results and back-off, with timers for what nobody says any more.

Messages are rows (event_id, ts, kind created | claimed | done | failed | tick). States are kept by keys of neighbouring event ids; an event's messages are
taken in order of (ts, kind). A lease that ran out is noticed by the next message, or by a timer if there is none; so a stream in any batches, also
one that was stopped and started again, ends in the states of the table as a whole.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import scores
from ..operators.propagation import LEASE_SECONDS

MESSAGE = "event_id long, ts timestamp, kind string"
STATE = "event_id long, delivery_status string, attempt_count int, claimed_at timestamp, next_retry_at timestamp, changes int"
#: Event ids of one key of the state: a batch rewrites the states of all keys it touches.
GROUP = 256
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def states(messages: DataFrame, now: Column) -> DataFrame:
    """N02, N07, N08 for a table of messages: event_id, delivery_status, attempt_count, claimed_at, next_retry_at as of now.

    created: pending. claimed, where the event is pending, or in retry and due, or its lease ran out: processing, one attempt more. done or failed,
    within the lease: processed, or retry after 5 seconds for each attempt, 300 at most. A lease that ran out: retry, due from then on. All other
    messages change nothing. An event has few messages, so they are one array; ticks only move time.
    """
    steps = messages.filter("kind <> 'tick'").groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("ts", "kind"))).alias("steps"))
    lease = F.make_dt_interval(secs=F.lit(LEASE_SECONDS))

    def state(status, attempts, claimed, due):
        return F.struct(status.alias("delivery_status"), attempts.cast("int").alias("attempt_count"), claimed.cast("timestamp").alias("claimed_at"), due.cast("timestamp").alias("next_retry_at"))

    def expired(s, at):
        out = (s["delivery_status"] == "processing") & (s["claimed_at"] + lease < at)
        return F.when(out, state(F.lit("retry"), s["attempt_count"], F.lit(None), s["claimed_at"] + lease)).otherwise(s)

    def step(s, m):
        was = expired(s, m["ts"])
        free = (was["delivery_status"] == "pending") | ((was["delivery_status"] == "retry") & (was["next_retry_at"] <= m["ts"]))
        held, attempts = was["delivery_status"] == "processing", was["attempt_count"]
        wait = F.make_dt_interval(secs=scores.backoff_seconds(attempts))
        return (
            F.when((m["kind"] == "created") & was["delivery_status"].isNull(), state(F.lit("pending"), F.lit(0), F.lit(None), F.lit(None)))
            .when((m["kind"] == "claimed") & free, state(F.lit("processing"), attempts + 1, m["ts"], F.lit(None)))
            .when((m["kind"] == "done") & held, state(F.lit("processed"), attempts, F.lit(None), F.lit(None)))
            .when((m["kind"] == "failed") & held, state(F.lit("retry"), attempts, F.lit(None), m["ts"] + wait))
            .otherwise(was)
        )

    none = state(F.lit(None).cast("string"), F.lit(0), F.lit(None), F.lit(None))
    end = steps.select("event_id", F.aggregate("steps", none, step).alias("s"))
    return end.select("event_id", expired(F.col("s"), now).alias("s")).select("event_id", "s.*").filter("delivery_status is not null")


class Delivery(StatefulProcessor):
    """The same rules for a stream, one key for GROUP neighbouring event ids: a call reads and writes their states at once.

    Times are microseconds in the state. A key has one timer, for the lease that ends first.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "ids array<long>, status array<string>, attempts array<int>, claimed array<long>, due array<long>, changes array<int>, timer long")

    def _held(self) -> tuple[dict, int | None]:
        if not self.state.exists():
            return {}, None
        ids, *columns, timer = self.state.get()
        return dict(zip(ids, map(list, zip(*columns, strict=True)), strict=True)), timer

    def _kept(self, held: dict, changed: list, timer: int | None) -> Iterator[Row]:
        if not changed:
            return
        ends = min((_lease_end(s) for s in held.values() if s[0] == "processing"), default=None)
        if ends != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if ends is not None:
                self.handle.registerTimer(ends)
        self.state.update(([*held], *map(list, zip(*held.values(), strict=True)), ends))
        when = lambda x: None if x is None else dt.datetime.fromtimestamp(x // 1_000_000, dt.timezone.utc).replace(microsecond=x % 1_000_000)
        for i in changed:
            s = held[i]
            yield Row(event_id=i, delivery_status=s[0], attempt_count=s[1], claimed_at=when(s[2]), next_retry_at=when(s[3]), changes=s[4])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        messages = sorted((_micros(r.ts), r.kind, r.event_id) for r in rows if r.kind != "tick")
        held, timer = self._held()
        new: dict = {}
        for at, kind, i in messages:
            new[i] = advanced(new.get(i) or held.get(i) or [None, 0, None, None, 0], at, kind)
        changed = [i for i, s in new.items() if s != held.get(i, [None, 0, None, None, 0])]
        for i in changed:
            held[i] = [*new[i][:4], new[i][4] + 1]
        yield from self._kept(held, changed, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, _ = self._held()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        changed = [i for i, s in held.items() if s[0] == "processing" and _lease_end(s) <= now]
        for i in changed:
            s = expired_state(held[i], now * 1000 + 1)
            held[i] = [*s[:4], s[4] + 1]
        yield from self._kept(held, changed, None)

    def close(self) -> None:
        pass


def _lease_end(s) -> int:
    """Milliseconds of the timer of a claimed event: it fires once the watermark is past it, and a lease holds in its last moment."""
    return (s[2] + LEASE_SECONDS * 1_000_000) // 1000 + 1


def _micros(t: dt.datetime) -> int:
    return int(t.replace(microsecond=0).timestamp()) * 1_000_000 + t.microsecond


def expired_state(s: list, at: int) -> list:
    if s[0] == "processing" and s[2] + LEASE_SECONDS * 1_000_000 < at:
        return ["retry", s[1], None, s[2] + LEASE_SECONDS * 1_000_000, s[4]]
    return s


def advanced(s: list, at: int, kind: str) -> list:
    """A state (status, attempts, claimed, due, changes) after one message."""
    s = expired_state(s, at)
    status, attempts = s[0], s[1]
    if kind == "created" and status is None:
        return ["pending", 0, None, None, s[4]]
    if kind == "claimed" and (status == "pending" or status == "retry" and s[3] <= at):
        return ["processing", attempts + 1, at, None, s[4]]
    if kind == "done" and status == "processing":
        return ["processed", attempts, None, None, s[4]]
    if kind == "failed" and status == "processing":
        return ["retry", attempts, None, at + min(300, 5 * attempts) * 1_000_000, s[4]]
    return s


def follow(stream: DataFrame, sink: str, checkpoint: str, late: str = "0 seconds", before_write=None, available_now: bool = True) -> StreamingQuery:
    """States of a stream of messages, each change as a row below sink/batch=<id>; a batch that runs again replaces its own folder."""
    spark = stream.sparkSession
    changes = stream.withWatermark("ts", late).withColumn("events", F.expr(f"event_id div {GROUP}")).groupBy("events").transformWithState(Delivery(), STATE, "Update", "EventTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        if before_write:
            before_write(batch_id)
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    trigger = {"availableNow": True} if available_now else {"processingTime": "30 seconds"}
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, _STORE)  # this query's own, which takes it when it starts
    query = changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    spark.conf.set(name, before)
    return query


def latest(changes: DataFrame) -> DataFrame:
    """Each event's last state of the rows below a sink."""
    rest = ["delivery_status", "attempt_count", "claimed_at", "next_retry_at"]
    return changes.groupBy("event_id").agg(F.max_by(F.struct(*rest), "changes").alias("s")).select("event_id", "s.*")
