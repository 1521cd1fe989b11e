"""Event-time windows of a stream: exact users in keyed state, closed by timers at the watermark, late rows set apart."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.sinks import exists
from .bronze import LATENESS, STATE_STORE

#: Parts of a window by user, each a key of its own, so that a large workspace is not one task.
SHARDS = 16
KEY = ["workspace_id", "event_name", "window_start", "shard"]
OUT = "kind string, workspace_id string, event_name string, window_start timestamp, shard int, event_count long, users long, event_id string, occurred_at timestamp"
WINDOW = ["workspace_id", "event_name", "window_start"]


#: Batches whose users a part keeps apart before they are put together.
CHUNKS = 32


def pack(users: set[str]) -> bytes:
    return zlib.compress(json.dumps(sorted(users)).encode(), 1)


def unpack(chunk: bytes) -> list[str]:
    return json.loads(zlib.decompress(chunk))


class WindowUsers(StatefulProcessor):
    """Counts events and distinct users of one part of a window until the watermark passes its end.

    A batch adds its users as one value, so the calls to the state store are those of the parts of windows that it
    touches, not of its users. The users of a part are in memory when it closes, and when many batches are put together.
    """

    def __init__(self, minutes: int):
        self.length = timedelta(minutes=minutes)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counted = handle.getValueState("counted", "events long, chunks int")
        self.seen = handle.getListState("seen", "users binary")

    def _row(self, key: tuple, kind: str, events: int | None = None, users: int | None = None, rows: pd.DataFrame | None = None) -> pd.DataFrame:
        ids, times = ([None], [pd.NaT]) if rows is None else (rows["event_id"], rows["at"])
        out = pd.DataFrame({"event_id": list(ids), "occurred_at": list(times)})
        names = dict(zip(KEY, key, strict=True)) | {"kind": kind, "event_count": events, "users": users}
        out = out.assign(**names)[["kind", *KEY, "event_count", "users", "event_id", "occurred_at"]]
        return out.astype({"event_count": "Int64", "users": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end = int((pd.Timestamp(key[2]) + self.length).timestamp() * 1000)
        closed = end <= timerValues.getCurrentWatermarkInMs()
        had = self.counted.get() if not closed and self.counted.exists() else None
        events, chunks = had or (0, 0)
        users: set[str] = set()
        for pdf in rows:
            if closed:
                if len(pdf):
                    yield self._row(key, "late", rows=pdf)
                continue
            events += len(pdf)
            users.update(pdf["anonymous_id"].dropna())
        if not closed:
            if had is None:
                self.handle.registerTimer(end)
            if users and chunks >= CHUNKS:  # users of many batches: each is kept once again
                users |= self._seen()
                self.seen.put([(pack(users),)])
                chunks = 1
            elif users:
                self.seen.appendValue((pack(users),))
                chunks += 1
            self.counted.update((events, chunks))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events, _ = self.counted.get()
        users = len(self._seen())
        self.counted.clear()
        self.seen.clear()
        yield self._row(key, "closed", events, users)

    def _seen(self) -> set[str]:
        return {user for (chunk,) in self.seen.get() for user in unpack(chunk)}

    def close(self) -> None:
        pass


def window_start(minutes: int):
    return F.window("at", f"{minutes} minutes").start


def windowed(events: DataFrame, minutes: int = 60, allowed: str = LATENESS, shards: int = SHARDS) -> DataFrame:
    """A stream of events as rows of kind closed (a part of a window that ended) and late (an event whose window had).

    The watermark is the latest event time seen less the allowed lateness. It reaches the timers, but is taken off the
    rows themselves: Spark would drop late ones before the processor sees them. Events without a time or an id of a user
    are left to the batch. Append mode.
    """
    if not events.isStreaming:
        raise ValueError("a stream is needed; provisional_counts does the same for a batch")
    rows = events.where("occurred_at is not null and anonymous_id is not null").withColumn("_at", F.col("occurred_at").cast("timestamp")).withWatermark("_at", allowed)
    rows = rows.select("workspace_id", "event_name", "event_id", "anonymous_id", F.col("_at").alias("at", metadata={}))
    rows = rows.withColumn("window_start", window_start(minutes)).withColumn("shard", F.pmod(F.xxhash64("anonymous_id"), F.lit(shards)).cast("int"))
    rows = rows.withColumn("window_start", F.col("window_start").alias("window_start", metadata={}))
    return rows.groupBy(*KEY).transformWithStateInPandas(WindowUsers(minutes), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def run_windows(events: DataFrame, path: str, checkpoint: str, minutes: int = 60, allowed: str = LATENESS, shards: int = SHARDS, every: str | None = None):
    """Writes the closed parts and late events to path/kind=…, over all that is there; goes on at intervals with `every`.

    The file sink and the checkpoint make each row come once, also over restarts. The state is in RocksDB.
    """
    spark = events.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        writer = windowed(events, minutes, allowed, shards).writeStream.format("parquet").partitionBy("kind").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
        if every:
            return writer.trigger(processingTime=every).start()
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def _written(spark: SparkSession, path: str, kind: str) -> DataFrame:
    rows = spark.read.schema(OUT).parquet(path) if exists(spark, path) else spark.createDataFrame([], OUT)
    return rows.where(F.col("kind") == kind)


def closed_windows(spark: SparkSession, path: str) -> DataFrame:
    """workspace_id, event_name, window_start, event_count and users of the windows that have ended.

    The parts of a window hold different users and end at the same watermark, so their sums are exact.
    """
    rows = _written(spark, path, "closed").groupBy(*WINDOW).agg(F.sum("event_count").alias("event_count"), F.sum("users").alias("users"))
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def late_events(spark: SparkSession, path: str) -> DataFrame:
    """workspace_id, event_id, event_name and occurred_at of the events that came after their window had ended."""
    return _written(spark, path, "late").select("workspace_id", "event_id", "event_name", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"))
