"""Connections over time: what becomes of each attempt to connect, as a stream with timers.

An attempt is connected by the first `ready` after it, fails by an `error`, ends by an `end`, is
replaced by a further `connect`, and times out where nothing of this comes within the guard. A
connection ends by the first of these but `ready`. Other events mean nothing.

Events may come late, by as much as the watermark's delay: they wait in the state until the watermark
has passed them, and then count in order of time. So the result doesn't depend on the order of arrival;
what comes later than that is left out. An attempt times out by the watermark too, without any event.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GUARD, DELAY = 35, 60  # seconds
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ENDS = {"error": "failed", "end": "ended", "connect": "replaced"}
FOUND = "connectionId string, started long, state string, at long"  # in microseconds, as all times within the state are


class Connection(StatefulProcessor):
    """Of one connection: events that wait, and the attempt or connection that there is now."""

    def __init__(self, guard: int = GUARD):
        self.guard = guard * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events string")  # JSON, many in a row of state: each row is a call
        self.now = handle.getValueState("now", "started long, connected boolean")
        self.alarm = handle.getValueState("alarm", "at long")

    def _wake(self, moments: list[int], passed: int) -> None:
        """Sees to it that the one timer there is goes off when the first of some moments has passed
        (microseconds; timers and `passed` are in milliseconds)."""
        at = max(-(-min(moments) // 1000), passed + 1)
        alarm = self.alarm.get()
        set_to = alarm[0] if alarm else None
        if set_to is None or at < set_to:
            if set_to is not None:
                self.handle.deleteTimer(set_to)
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        fresh = [(r["micros"], r["number"], r["kind"]) for r in rows]
        self.waiting.appendValue((json.dumps(fresh),))
        self._wake([t for t, _, _ in fresh], timerValues.getCurrentWatermarkInMs())
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.alarm.clear()
        now = timerValues.getCurrentWatermarkInMs()
        passed = now * 1000
        events = sorted(tuple(e) for row in self.waiting.get() for e in json.loads(row[0]))
        due = [e for e in events if e[0] <= passed]
        left = events[len(due) :]
        started, connected = self.now.get() or (None, False)
        out: list[tuple] = []
        for at, _, kind in [*due, (passed + 1, 0, None)]:
            if started is not None and not connected and started + self.guard < at:
                out.append((started, "timed out", started + self.guard))
                started = None
            if started is not None and kind == "ready" and not connected:
                connected = True
                out.append((started, "connected", at))
            elif started is not None and kind in ENDS:
                out.append((started, "ended" if connected and kind == "error" else ENDS[kind], at))
                started, connected = None, False
            if kind == "connect":
                started, connected = at, False
        if due:
            self.waiting.put([(json.dumps(left),)]) if left else self.waiting.clear()
        self.now.update((started, connected)) if started is not None else self.now.clear()
        ahead = [e[0] for e in left[:1]] + ([started + self.guard] if started is not None and not connected else [])
        if ahead:
            self._wake(ahead, now)
        for began, state, at in out:
            yield Row(connectionId=key[0], started=began, state=state, at=at)

    def close(self) -> None:
        pass


def events_of(spark: SparkSession, path: str, kinds: dict[str, str]) -> DataFrame:
    """A stream of (connectionId, number, at, kind) from files of events; kinds: by event type, of which
    others are left out."""
    raw = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string").parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may be one file, a plain path only a folder
    kind = F.try_element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)), F.col("event_type"))
    return raw.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("connectionId"), F.col("event_id").alias("number"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind")).where("kind IS NOT NULL")


def states(events: DataFrame, guard: int = GUARD, delay: int = DELAY) -> DataFrame:
    """(connectionId, started, state, at) of a stream of events, each as soon as the watermark tells."""
    known = events.where("at IS NOT NULL").withColumn("micros", F.unix_micros("at")).withWatermark("at", f"{delay} seconds")
    found = known.groupBy("connectionId").transformWithState(Connection(guard), FOUND, "Append", "EventTime")
    return found.select("connectionId", F.timestamp_micros("started").alias("started"), "state", F.timestamp_micros("at").alias("at"))


def run_to_end(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over what there is now, and reads what came of it. State with timers needs Spark's
    RocksDB store, which is set for this stream only."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        running = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
