"""Waiting until readings settle, on streams: the rule by which a page counts as loaded, for any number of keys at once.

A watch of a key begins with a reading and ends when two readings in a row are equal (``equal``), after so many readings
(``rounds``), or when none comes for so long (``idle``, told by the next reading, or a second later by a timer); the next reading begins a new
watch. State is one row for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROUNDS = 18
#: Microseconds by which a timer comes after the idle end that it tells.
GRACE = 1_000_000
WATCHES = "key string, watch long, rounds int, value string, why string, began_at timestamp, ended_at timestamp"
STATE = "watch long, rounds int, value string, began long, last long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Watch(StatefulProcessor):
    """Arbitrary state: a value for each key, and a timer for its idle end. Times are microseconds."""

    def __init__(self, rounds: int, idle: int):
        self.rounds, self.idle = rounds, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("watch", STATE)

    def told(self, key, state: tuple, why: str, ended: int) -> Row:
        from datetime import datetime, timedelta, timezone

        watch, rounds, value, began, _ = state
        at = lambda us: (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)).astimezone().replace(tzinfo=None)
        return Row(key=key[0], watch=watch, rounds=rounds, value=value, why=why, began_at=at(began), ended_at=at(ended))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = tuple(self.state.get()) if self.state.exists() else (0, 0, None, 0, 0)
        for at, _, value in sorted(((r["at_us"], r["tie"], r["value"]) for r in rows), key=lambda r: r[:2]):
            watch, n, before, began, last = state
            if n and at - last > self.idle:
                yield self.told(key, state, "idle", last + self.idle)
                watch, n = watch + 1, 0
            state = (watch, n + 1, value, began if n else at, at)
            why = "equal" if n and value is not None and before == value else "rounds" if n + 1 >= self.rounds else None
            if why:
                yield self.told(key, state, why, at)
                state = (watch + 1, 0, None, 0, 0)
        self.state.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state[1]:
            self.handle.registerTimer((state[4] + self.idle + GRACE) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = tuple(self.state.get())
        if state[1]:
            yield self.told(key, state, "idle", state[4] + self.idle)
            self.state.update((state[0] + 1, 0, None, 0, 0))

    def close(self) -> None:
        pass


def settled(readings: DataFrame, rounds: int = ROUNDS, idle: str = "2 days", lateness: str = "1 hour") -> DataFrame:
    """The ended watches (WATCHES) of a stream of readings (key, at, tie, value), in the order of (at, tie) within a key.

    Readings later than lateness are dropped by the watermark. The session must keep state in RocksDB (see session_for_state).
    Null values are equal to no other.
    """
    idle_us = int(readings.sparkSession.sql(f"SELECT unix_micros(timestamp '1970-01-01 00:00:00+00' + interval '{idle.split()[0]}' {idle.split()[1]})").first()[0])
    at = F.col("at").cast("timestamp")
    named = readings.select(F.col("key").cast("string"), at.alias("at"), F.unix_micros(at).alias("at_us"), F.col("tie").cast("long"), F.col("value").cast("string"))
    return named.withWatermark("at", lateness).groupBy("key").transformWithState(statefulProcessor=Watch(rounds, idle_us), outputStructType=WATCHES, outputMode="Append", timeMode="EventTime")


def session_for_state(spark: SparkSession) -> SparkSession:
    """A session beside spark that keeps state in RocksDB, as timers and values of keys need it."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return session
