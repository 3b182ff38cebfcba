"""Keyed state over a feed of activities: what each one has met, how far it is, and deletes that take its facts back.

State is kept by activity. What changes in it is given off as differences, so that counters by user, feature or status are sums of them, go up and
down, and need no state of their own. Later changes win whatever order the rows come in, so a feed that repeats itself or comes late ends alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from . import feeds

#: The stages an activity goes through; it is done when each has found something.
STAGES = ("peaks", "paths", "areas")
DIFFERENCE = "user_id long, activity_id long, what string, name string, delta int"
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def status_of(stages: set[str], deleted: bool) -> str:
    """queued, partial or done by the stages that have found something; deleted where a delete has left nothing."""
    if not stages:
        return "deleted" if deleted else "queued"
    return "done" if stages >= set(STAGES) else "partial"


class ActivityState(StatefulProcessor):
    """State of one activity, as one value that is asked for and put down once: facts (stage and feature, with the time of the last row that said so), the
    time of its last delete, its status and its timer. Times are microseconds."""

    def __init__(self, forget: timedelta):
        self.forget = forget // timedelta(milliseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("activity", "gone long, status string, last long, timer long, kinds array<string>, features array<string>, ats array<long>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.state.get()
        gone, status, last, timer, kinds, features, ats = old or (-1, None, -1, None, [], [], [])
        held = {(k, f): at for k, f, at in zip(kinds, features, ats, strict=True)}
        before = set(held)
        for row in rows:
            at = row["micros"]
            last = max(last, at)
            if row["deleted"]:
                gone = max(gone, at)
            elif row["kind"] is not None and row["feature_id"] is not None:
                fact = row["kind"], row["feature_id"]
                held[fact] = max(at, held.get(fact, -1))
        held = {k: at for k, at in held.items() if at > gone}
        now = status_of({kind for kind, _ in held}, gone >= 0)
        due = last // 1000 + self.forget
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.state.update((gone, now, last, due, [k for k, _ in held], [f for _, f in held], list(held.values())))
        changed = [(*k, 1) for k in set(held) - before] + [(*k, -1) for k in before - set(held)]
        if now != status:
            changed += [("status", now, 1)] + ([("status", status, -1)] if status is not None else [])
        for what, name, delta in sorted(changed):
            yield Row(user_id=key[0], activity_id=key[1], what=what, name=name, delta=delta)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """What nothing has been heard of for so long keeps its facts and status, but no state: a later row counts as of a new activity."""
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def differences(stream: DataFrame, forget: timedelta = timedelta(days=365), late: str = "30 days") -> DataFrame:
    """What a feed of rows (user_id, activity_id, kind: a stage or null, feature_id, at, deleted) changes: user_id, activity_id, what, name, delta.

    what is a stage, name a feature and delta 1 or -1 as the activity meets it or takes it back; or what is "status" and name the status that it comes
    to or leaves. Rows without keys or time are left out, and so are rows later than the watermark (of which `late` is the slack).
    """
    named = stream.select(F.col("user_id").cast("long"), F.col("activity_id").cast("long"), F.col("kind").cast("string"), F.col("feature_id").cast("string"), F.col("at").cast("timestamp"), F.coalesce("deleted", F.lit(False)).alias("deleted")).withColumn("micros", F.unix_micros("at"))
    timed = named.where("user_id is not null and activity_id is not null and at is not null").withWatermark("at", late)
    return timed.groupBy("user_id", "activity_id").transformWithState(ActivityState(forget), DIFFERENCE, "Append", "EventTime")


def keep_status(stream: DataFrame, folder: str, checkpoint: str, **options) -> StreamingQuery:
    """Appends differences() to <folder>, each batch once; the state is kept in a store of its own format, whatever the session's is."""
    conf = stream.sparkSession.conf
    before = conf.get(_STORE)
    conf.set(_STORE, _ROCKS)
    try:
        return feeds.append_to(differences(stream, **options), folder, checkpoint)
    finally:
        conf.set(_STORE, before)


def current_status(spark: SparkSession, folder: str) -> DataFrame:
    """activity by activity what holds now: user_id, activity_id, what, name."""
    log = spark.read.schema(DIFFERENCE).parquet(folder)
    return log.groupBy("user_id", "activity_id", "what", "name").agg(F.sum("delta").alias("n")).where("n > 0").drop("n")


def counters(spark: SparkSession, folder: str, by: list[str]) -> DataFrame:
    """Activities that hold each thing, by some of user_id, what and name; what has gone down to none is left out."""
    log = spark.read.schema(DIFFERENCE).parquet(folder)
    return log.groupBy(*by).agg(F.sum("delta").alias("n")).where("n <> 0")
