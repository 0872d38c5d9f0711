"""Event-time operators: the same functions take a batch table or a stream."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

# The worker in which the driver asks a processor for its state finds no files that a session ships, so this module's classes are pickled whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Watermarks need ``timestamp``; the tables hold ``timestamp_ntz``.
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Event files of a folder as a stream, ``files`` to a micro-batch, with ts as an instant."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Counts and sums of each type in windows of a size, each starting a slide after the last."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    counted = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Each user's events with no pause longer than the gap between them."""
    grouped = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, late: str) -> DataFrame:
    """Each event_id once; ids are remembered as long as the watermark lets their repeats in."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def followed(first: DataFrame, then: DataFrame, late: str, within: str) -> DataFrame:
    """Events of one stream with those of another by the same user that follow within a time."""
    a = first.withWatermark("ts", late).select(F.col("user_id"), F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts"))
    b = then.withWatermark("ts", late).select(F.col("user_id").alias("then_user"), F.col("event_id").alias("then_id"), F.col("ts").alias("then_ts"))
    near = F.expr(f"user_id = then_user and then_ts >= first_ts and then_ts <= first_ts + interval {within}")
    return a.join(b, near).select("user_id", "first_id", "then_id")


def running_totals(events: DataFrame) -> DataFrame:
    """Each user's number of events and sum of values so far, kept as arbitrary state."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for frame in frames:
            n, total = n + len(frame), total + float(frame["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    schema = "user_id long, n long, total double"
    return events.groupBy("user_id").applyInPandasWithState(update, schema, "n long, total double", "update", GroupStateTimeout.NoTimeout)


class Balance(StatefulProcessor):
    """Per key: how many rows there were and the sum of their values, told after each batch that has some."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.balance = handle.getValueState("balance", "n long, total double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        n, total = self.balance.get() if self.balance.exists() else (0, 0.0)
        for frame in rows:
            n, total = n + len(frame), total + float(frame["value"].sum())
        self.balance.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    def close(self) -> None:
        pass


def balances(events: DataFrame) -> DataFrame:
    """As ``running_totals``, in Spark 4's form of arbitrary state, which wants the RocksDB state store."""
    return events.groupBy("user_id").transformWithStateInPandas(Balance(), "user_id long, n long, total double", "Append", "None")


class Silence(StatefulProcessor):
    """Per key: the times of events whose silence is still open, with one timer, for the end of the first. When the watermark has passed a time and the
    ``seconds`` after it, no event in between can come any more; if none is among the times that are held, the key was silent.

    A key's times are read and put back once a batch. Of those that another follows within ``seconds`` only such are held as are after the
    watermark: no row before them can come any more whose silence they would break."""

    def __init__(self, seconds: int):
        self.length = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "ms long, n long")

    def _open(self, times: dict[int, int]) -> list[int]:
        """The times that no other follows within the length, in order."""
        order = sorted(times)
        return [t for t, after in zip(order, [*order[1:], None], strict=False) if after is None or after > t + self.length]

    def _hold(self, times: dict[int, int], open_: list[int], watermark: int) -> None:
        some = set(open_)
        if held := [(ms, n) for ms, n in times.items() if ms > watermark or ms in some]:
            self.times.put(held)
        else:
            self.times.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        times = dict(self.times.get())
        before = self._open(times)[:1]
        for frame in rows:
            for ms, n in zip(*np.unique(frame["ts"].to_numpy("datetime64[ms]").astype("int64"), return_counts=True), strict=True):
                times[int(ms)] = times.get(int(ms), 0) + int(n)
        open_ = self._open(times)
        if before != open_[:1]:
            for t in before:
                self.handle.deleteTimer(t + self.length)
            self.handle.registerTimer(open_[0] + self.length)
        self._hold(times, open_, timer_values.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        end = max(watermark, expiredTimerInfo.getExpiryTimeInMs())
        times = dict(self.times.get())
        open_ = self._open(times)
        silent = [t for t in open_ if t + self.length <= end]
        counts = [times.pop(t) for t in silent]
        left = open_[len(silent) :]
        self._hold(times, left, watermark)
        if left:
            self.handle.registerTimer(left[0] + self.length)
        if silent:
            yield pd.DataFrame({"user_id": [key[0]] * len(silent), "silent_since": pd.to_datetime(silent, unit="ms"), "events_then": counts})

    def close(self) -> None:
        pass


def silences(events: DataFrame, seconds: int) -> DataFrame:
    """user_id, silent_since and events_then: a row for each time (in milliseconds) at which a user had an event and then none for ``seconds``, once the
    watermark has passed the end of that. State holds the times within ``seconds`` and the watermark's delay, as a list; it wants
    the RocksDB state store. Rows without a time are left out."""
    return events.select("user_id", "ts").where("ts is not null").groupBy("user_id").transformWithStateInPandas(Silence(seconds), "user_id long, silent_since timestamp, events_then long", "Append", "EventTime")
