"""Streams over the event table, run until all that is there has been read, and what their windows hold then."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.intermediate import shared_folder
from ..sources.tables import table
from ..streaming import events as E

#: How late an event may be.
LATE = "1 hour"
_ALL_FILES = 1 << 30
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _events(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    return E.read_stream(spark, f"{sf_dir}/events.parquet*", files)


def _appended(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """What the stream appends, written where all executors see it; in a ``folder`` where it has run before it goes on."""
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that arbitrary state wants, while a stream starts."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _instants(df: DataFrame, *names: str) -> DataFrame:
    """Back from instants to the tables' own times."""
    for name in names:
        df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df


def closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows that the watermark has passed."""
    return _instants(_appended(E.tumbling(_events(spark, sf_dir).withWatermark("ts", LATE), "1 day")), "window_start")


def closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that the watermark has passed."""
    return _instants(_appended(E.sessions(_events(spark, sf_dir).withWatermark("ts", LATE), "6 hours")), "session_start", "session_end")


def events_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream in which every event comes twice, each kept once."""
    twice = _events(spark, sf_dir)
    return _appended(E.deduplicated(twice.unionByName(twice), "1 day").select("event_id", "event_type"))


def streamed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and the purchases that follow them within six hours, as a join of two streams."""
    of = lambda kind: _events(spark, sf_dir).where(F.col("event_type") == kind)
    return _appended(E.followed(of("click"), of("purchase"), "1 day", "6 hours")).select("user_id", F.col("first_id").alias("click_id"), F.col("then_id").alias("purchase_id"))


def streamed_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arbitrary state: each user's number of events and sum of values, the last that each has had."""
    with _rocks(spark):
        updates = _appended(E.balances(_events(spark, sf_dir)))
    last = updates.groupBy("user_id").agg(F.max(F.struct("n", "total")).alias("last"))
    return last.select("user_id", "last.n", F.round("last.total", 2).alias("total"))


def silent_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time timers over a list of times: when users had their last event before six hours of silence. All files are read at once, as each
    batch costs every user, and so that no row of a later file is late."""
    with _rocks(spark):
        found = _appended(E.silences(_events(spark, sf_dir, _ALL_FILES).withWatermark("ts", LATE), 6 * 3600))
    return _instants(found, "silent_since")


def on_time_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late rows are left out: the errors of the first half come after all else, and the watermark has passed them.

    The stream runs over all else, stops, and goes on from its checkpoint when the late rows are there.
    """
    events = table(spark, sf_dir, "events")
    span = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    marked = events.crossJoin(F.broadcast(span)).withColumn("late", (F.col("event_type") == "error") & (F.col("ts") < F.col("low") + (F.col("high") - F.col("low")) / 2))
    folder = shared_folder(spark)
    for some in ("not late", "late"):
        marked.where(some).select(*events.columns).write.mode("append").parquet(f"{folder}/in")
        counted = E.tumbling(E.read_stream(spark, f"{folder}/in", _ALL_FILES).withWatermark("ts", LATE), "1 day")
        found = _appended(counted, folder)
    return _instants(found, "window_start").groupBy("event_type").agg(F.sum("n").alias("n"))


_CLOSED = "<= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"
QUERIES = {
    "closed_windows": (closed_windows, f"SELECT * FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2) WHERE window_start + INTERVAL 1 DAY {_CLOSED}"),
    "closed_sessions": (
        closed_sessions,
        f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, nth HAVING max(ts) + INTERVAL 6 HOUR {_CLOSED}""",
    ),
    "events_once": (events_once, "SELECT event_id, event_type FROM events"),
    "streamed_pairs": (streamed_pairs, "SELECT c.user_id, c.event_id AS click_id, p.event_id AS purchase_id FROM events c JOIN events p ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 6 HOUR"),
    "streamed_balances": (streamed_balances, "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1"),
    "silent_users": (
        silent_users,
        """WITH m AS (SELECT user_id, date_trunc('milliseconds', ts) AS t, count(*) AS n FROM events GROUP BY 1, 2), g AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS next FROM m)
SELECT user_id, t AS silent_since, n AS events_then FROM g WHERE (next IS NULL OR next > t + INTERVAL 6 HOUR) AND t + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    ),
    "on_time_events": (
        on_time_events,
        f"""WITH x AS (SELECT *, event_type = 'error' AND ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) AS late FROM events)
SELECT event_type, count(*) AS n FROM x WHERE NOT late AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM x WHERE NOT late) GROUP BY 1""",
    ),
}
