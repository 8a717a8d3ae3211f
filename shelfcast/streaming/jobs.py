"""Streaming forms of ingestion, deduplication, request summaries and scoring."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfcast.operators.requestlog import LIMIT, WINDOW_SECONDS, quota_usage, request_counts, request_edges

LATENESS = "1 hour"


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with time zone."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def dedupe_stream(stream: DataFrame, ids: Sequence[str], ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """First row per id. Ids are forgotten once the watermark has passed them, which bounds the state."""
    return event_time(stream, ts).withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(ids))


def windowed_counts(log: DataFrame, window: str, lateness: str = LATENESS) -> DataFrame:
    """Request counts per window; a window is emitted when the watermark passes its end."""
    return request_counts(event_time(log).withWatermark("ts", lateness), window)


def gauge_changes(log: DataFrame, grain: str = "second", lateness: str = LATENESS) -> DataFrame:
    """Change of the number of open requests at each second of event time, kept as state per second.

    A request's end may lie far ahead of the batch that brings it: its second waits in the state until the
    watermark, which follows starts and ends alike, has passed it. ``running_gauge`` makes the gauge of them.
    """
    edges = request_edges(event_time(log), grain).withWatermark("at", lateness)
    return edges.groupBy("at").agg(F.sum("change").alias("change"))


def windowed_quota(log: DataFrame, limit: int, seconds: int, lateness: str = LATENESS) -> DataFrame:
    return quota_usage(event_time(log).withWatermark("ts", lateness), limit, seconds)


QUOTA_OUTPUT = T.StructType([
    T.StructField("client", T.StringType()),
    T.StructField("request_id", T.LongType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("window_start_us", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("over_limit", T.BooleanType()),
])


class AnchoredQuota(StatefulProcessor):
    """Open window of each client: its start and the requests counted so far.

    The state is two numbers per client. A micro-batch is bounded by the source's rate setting, and
    its rows arrive in chunks that are sorted by time before they are counted. With ``expire`` a timer stands
    at the end of the open window; once the watermark has passed it, no request can fall into the window and
    the client's state is dropped, as the next request opens a new window anyway.
    """

    def __init__(self, limit: int, seconds: int, expire: bool = False):
        self.limit = limit
        self.width = seconds * 1_000_000
        self.expire = expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start bigint, used bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts_us", "request_id"], kind="stable")
        ts = pdf["ts_us"].to_numpy()
        start, used = self.open.get() if self.open.exists() else (None, 0)
        starts, numbers = np.empty(len(ts), np.int64), np.empty(len(ts), np.int64)
        at = 0
        while at < len(ts):
            if start is None or ts[at] >= start + self.width:
                start, used = int(ts[at]), 0
            end = int(np.searchsorted(ts, start + self.width))
            starts[at:end] = start
            numbers[at:end] = used + np.arange(1, end - at + 1)
            used += end - at
            at = end
        self.open.update((int(start), int(used)))
        if self.expire:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            # Timers have milliseconds: the first one not before the window's end.
            self.handle.registerTimer(-(-(int(start) + self.width) // 1000))
        yield pd.DataFrame({
            "client": key[0], "request_id": pdf["request_id"].to_numpy(), "ts_us": ts,
            "window_start_us": starts, "n": numbers, "over_limit": numbers > self.limit,
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            start, _ = self.open.get()
            # A window opened since has a timer of its own.
            if expiredTimerInfo.getExpiryTimeInMs() * 1000 >= start + self.width:
                self.open.clear()
        yield pd.DataFrame({f.name: [] for f in QUOTA_OUTPUT.fields}).astype(EMPTY_TYPES)

    def close(self) -> None:
        pass


EMPTY_TYPES = {"client": "object", "request_id": "int64", "ts_us": "int64", "window_start_us": "int64", "n": "int64",
               "over_limit": "bool"}


def anchored_quota_stream(
    log: DataFrame, request_id: str, limit: int = LIMIT, seconds: int = WINDOW_SECONDS, lateness: str | None = None
) -> DataFrame:
    """Anchored quota windows over a stream whose batches are in time order.

    Needs ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider. With ``lateness`` the
    state of a client ends with its window: timers on event time drop it once the watermark, which trails
    the newest request by that much, has passed. Requests later than that are not counted.
    """
    timed = log if lateness is None else event_time(log).withWatermark("ts", lateness)
    rows = timed.select(
        F.col("client").cast("string").alias("client"),
        F.col(request_id).cast("bigint").alias("request_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        *([] if lateness is None else ["ts"]),
    )
    return rows.groupBy("client").transformWithStateInPandas(
        statefulProcessor=AnchoredQuota(limit, seconds, lateness is not None),
        outputStructType=QUOTA_OUTPUT,
        outputMode="Append",
        timeMode="None" if lateness is None else "EventTime",
    )
