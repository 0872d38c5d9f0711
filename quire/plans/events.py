"""Queries over events in batch form; the streaming operators are the same functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.intermediate import shared_folder
from ..sources.shipping import ship
from ..sources.tables import table
from ..streaming import events as E


def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tumbling(table(spark, sf_dir, "events"), "1 day")


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tumbling(table(spark, sf_dir, "events"), "12 hours", "6 hours")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sessions(table(spark, sf_dir, "events"), "6 hours")


def streamed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A complete-mode stream over the table, run until all that is there has been read. Each batch's whole result takes the place of the last in the
    shared folder."""
    events = spark.readStream.schema(E.SCHEMA).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    folder = shared_folder(spark)
    told = counted.writeStream.outputMode("complete").foreachBatch(lambda whole, _: whole.write.mode("overwrite").parquet(f"{folder}/out"))
    told.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counted.schema).parquet(f"{folder}/out")


def user_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouped pandas function: each user's share of events in their busiest type. Events are counted by type first, so a group has
    a row for each type, however busy its user is."""

    def profile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        top = rows.sort_values(["n", "event_type"], ascending=[False, True], na_position="last").iloc[0]
        return pd.DataFrame({"user_id": [key[0]], "top_type": [top["event_type"]], "share": [round(float(top["n"]) / int(rows["n"].sum()), 6)]})

    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.groupBy("user_id").applyInPandas(profile, "user_id long, top_type string, share double")


def scaled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar pandas function on Arrow batches."""

    @F.pandas_udf("double")
    def scale(value: pd.Series) -> pd.Series:
        return (value * 1.5).round(4)

    return table(spark, sf_dir, "events").select("event_id", scale("value").alias("scaled"))


def mean_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouped-aggregate pandas function. It has a group's values at once, so it is grouped by user, not by type."""

    @F.pandas_udf("double")
    def middle(value: pd.Series) -> float:
        return float(value.median())

    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(middle("value"), 4).alias("mid"))


def split_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python table function, joined laterally."""

    @F.udtf(returnType="digit string, nth long")
    class Digits:
        def eval(self, text: str):
            for i, c in enumerate(c for c in text or "" if c.isdigit()):
                yield c, i

    spark.udtf.register("quire_digits", Digits)
    table(spark, sf_dir, "events").createOrReplaceTempView("quire_events")
    return spark.sql("SELECT digit, count(*) AS n, max(nth) AS deepest FROM quire_events, LATERAL quire_digits(props) GROUP BY digit")


def mapped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pandas iterator function: what a file-wide set-up would be shared by, with rows left out and added."""

    def large(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            some = frame[frame["value"] > 100.0]
            yield pd.DataFrame({"event_id": some["event_id"], "above": (some["value"] - 100.0).round(4)})

    return table(spark, sf_dir, "events").select("event_id", "value").mapInPandas(large, "event_id long, above double")


def arrow_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar function on Arrow arrays."""

    @F.arrow_udf("long")
    def cents(value: pa.Array) -> pa.Array:
        return pc.cast(pc.round(pc.multiply(value, 100.0)), pa.int64())

    return table(spark, sf_dir, "events").select("event_id", cents("value").alias("cents"))


def paired_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables grouped together: each user's clicks beside their purchases, users of only one included. Both are summed
    first, so that a busy user is a row of each."""
    events = table(spark, sf_dir, "events")
    clicked = events.where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("n"))
    bought = events.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("buyer")).agg(F.count("*").alias("n"), F.sum("value").alias("spent"))

    def paired(key: tuple, clicks: pd.DataFrame, purchases: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [key[0]], "clicks": [int(clicks["n"].sum())], "purchases": [int(purchases["n"].sum())], "spent": [round(float(purchases["spent"].sum()), 2)]})

    return clicked.groupBy("user_id").cogroup(bought.groupBy("buyer")).applyInPandas(paired, "user_id long, clicks long, purchases long, spent double")


def argued_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by a table function whose argument is a table, partitioned by user and ordered by time, in Arrow batches. A session
    that is open at the end of a batch goes on in the next, so a user's rows are never together."""
    ship(spark)
    events = table(spark, sf_dir, "events").select("user_id", "ts")
    return _Sessions(events.asTable().partitionBy("user_id").orderBy("ts"))


@F.arrow_udtf(returnType="user_id long, session_start timestamp_ntz, session_end timestamp_ntz, n long")
class _Sessions:
    GAP = 6 * 3600 * 1_000_000

    def __init__(self):
        self.user, self.start, self.last, self.n = None, None, None, 0

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        if not rows.num_rows:
            return
        times = rows.column("ts").cast(pa.timestamp("us")).to_numpy(zero_copy_only=False).astype("int64")
        self.user = rows.column("user_id")[0].as_py()
        done = []
        for at in np.split(times, np.flatnonzero(np.diff(times) >= self.GAP) + 1):
            if self.n and at[0] - self.last >= self.GAP:
                done.append((self.start, self.last, self.n))
                self.n = 0
            self.start = int(at[0]) if not self.n else self.start
            self.last, self.n = int(at[-1]), self.n + len(at)
        if done:
            yield self._told(done)

    def terminate(self) -> Iterator[pa.Table]:
        if self.n:
            yield self._told([(self.start, self.last, self.n)])

    def _told(self, done: list[tuple[int, int, int]]) -> pa.Table:
        starts, lasts, counts = zip(*done, strict=True)
        time = lambda us: pa.array(us, pa.int64()).cast(pa.timestamp("us"))
        names = ["user_id", "session_start", "session_end", "n"]
        return pa.table([pa.array([self.user] * len(done), pa.int64()), time(starts), time([t + self.GAP for t in lasts]), pa.array(counts, pa.int64())], names=names)


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar and a table function written in SQL, which Spark inlines."""
    table(spark, sf_dir, "events").createOrReplaceTempView("quire_events")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION quire_band(v DOUBLE) RETURNS STRING RETURN CASE WHEN v < 50 THEN 'low' WHEN v < 200 THEN 'middle' ELSE 'high' END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION quire_of_type(t STRING) RETURNS TABLE (user_id BIGINT, value DOUBLE) RETURN SELECT user_id, value FROM quire_events WHERE event_type = t")
    return spark.sql("SELECT quire_band(value) AS band, count(*) AS n, count(DISTINCT user_id) AS users FROM quire_of_type('purchase') GROUP BY 1")


_SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, nth"""

QUERIES = {
    "tumbling_windows": (tumbling_windows, "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"),
    "sliding_windows": (
        sliding_windows,
        "SELECT w AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR]) AS w FROM events) GROUP BY 1, 2",
    ),
    "user_sessions": (user_sessions, _SESSIONS),
    "argued_sessions": (argued_sessions, _SESSIONS),
    "streamed_totals": (streamed_totals, "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1"),
    "user_profiles": (
        user_profiles,
        """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS nth FROM c)
SELECT user_id, event_type AS top_type, round(CAST(n AS DOUBLE) / total, 6) AS share FROM r WHERE nth = 1""",
    ),
    "scaled_values": (scaled_values, "SELECT event_id, round_even(value * 1.5, 4) AS scaled FROM events"),
    "mean_values": (mean_values, "SELECT user_id, round(median(value), 4) AS mid FROM events GROUP BY 1"),
    "mapped_values": (mapped_values, "SELECT event_id, round_even(value - 100.0, 4) AS above FROM events WHERE value > 100.0"),
    "arrow_values": (arrow_values, "SELECT event_id, CAST(round_even(value * 100.0, 0) AS BIGINT) AS cents FROM events"),
    "paired_users": (
        paired_users,
        """SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases, coalesce(round(sum(value) FILTER (event_type = 'purchase'), 2), 0.0) AS spent
FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1""",
    ),
    "sql_functions": (sql_functions, "SELECT CASE WHEN value < 50 THEN 'low' WHEN value < 200 THEN 'middle' ELSE 'high' END AS band, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_type = 'purchase' GROUP BY 1"),
    "split_properties": (split_properties, "SELECT d AS digit, count(*) AS n, max(nth) AS deepest FROM (SELECT unnest(regexp_extract_all(props, '[0-9]')) AS d, generate_subscripts(regexp_extract_all(props, '[0-9]'), 1) - 1 AS nth FROM events) GROUP BY 1"),
}
