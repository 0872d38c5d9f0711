"""Streams against the batch form of the same operators, and late rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quire.plans import events as plans
from quire.plans import streams
from quire.sources.tables import table
from quire.streaming import events as E


def _ran(df, mode, name):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return {tuple(r) for r in df.sparkSession.table(name).collect()}


@pytest.fixture(scope="module")
def folder(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "events")
    events = table(spark, small, "events")
    bounds = events.approxQuantile("event_id", [1 / 3, 2 / 3], 0.0)
    for low, high in zip([-1.0, *bounds], [*bounds, 1e18], strict=True):  # one after the other, as streams read files in the order of their writing
        events.where((F.col("event_id") > low) & (F.col("event_id") <= high)).coalesce(1).write.mode("append").parquet(path)
    return path


def _batch(spark, small):
    return table(spark, small, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def test_closed_windows_equal_the_batch(spark, small, folder):
    stream = E.read_stream(spark, folder).withWatermark("ts", "1 hour")
    closed = _ran(E.tumbling(stream, "1 day"), "append", "closed")
    everything = {tuple(r) for r in E.tumbling(_batch(spark, small), "1 day").collect()}
    last = max(r[0] for r in everything)
    assert closed < everything and all(r[0] >= last - dt.timedelta(days=1) for r in everything - closed)
    assert _ran(E.tumbling(E.read_stream(spark, folder), "1 day"), "complete", "complete") == everything


def test_sessions(spark, small, folder):
    closed = _ran(E.sessions(E.read_stream(spark, folder).withWatermark("ts", "1 hour"), "6 hours"), "append", "sessions")
    everything = {tuple(r) for r in E.sessions(_batch(spark, small), "6 hours").collect()}
    assert closed < everything and len(closed) > 0.9 * len(everything)


def test_repeats_are_dropped(spark, small, folder):
    twice = E.read_stream(spark, folder)
    ids = _ran(E.deduplicated(twice.unionByName(twice), "1 day").select("event_id"), "append", "ids")
    assert len(ids) == spark.table("ids").count() == table(spark, small, "events").count()


def test_stream_join(spark, small, folder):
    def of(kind):
        return E.read_stream(spark, folder, 100).where(F.col("event_type") == kind)

    found = _ran(E.followed(of("click"), of("purchase"), "1 day", "6 hours"), "append", "pairs")
    expected = {tuple(r) for r in _pairs(spark, small)}
    assert found and found == expected


def _pairs(spark, small):
    from quire.plans.relational import clicks_before_purchases

    return clicks_before_purchases(spark, small).collect()


def test_arbitrary_state(spark, small, folder):
    totals = {}
    _ran(E.running_totals(E.read_stream(spark, folder)), "update", "totals")
    for r in spark.table("totals").collect():
        totals[r.user_id] = max(totals.get(r.user_id, (0, 0.0)), (r.n, round(r.total, 6)))
    expected = {r.user_id: (r.n, round(r.t, 6)) for r in table(spark, small, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("t")).collect()}
    assert totals.keys() == expected.keys()
    for user, (n, total) in totals.items():
        assert n == expected[user][0] and abs(total - expected[user][1]) < 1e-4


def test_state_of_the_newer_kind(spark, small):
    expected = {r.user_id: (r.n, r.t) for r in table(spark, small, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("t")).collect()}
    found = {r.user_id: (r.n, r.total) for r in streams.streamed_balances(spark, small).collect()}
    assert found.keys() == expected.keys() and all(found[u][0] == n and abs(found[u][1] - t) < 0.01 for u, (n, t) in expected.items())


def test_late_rows_are_counted_nowhere(spark, small):
    found = {r.event_type: r.n for r in streams.on_time_events(spark, small).collect()}
    everything = {r["event_type"]: r["count"] for r in table(spark, small, "events").groupBy("event_type").count().collect()}
    assert found["error"] < 0.7 * everything["error"] and found["click"] > 0.9 * everything["click"]


def test_late_rows_are_left_out(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    path = str(tmp_path / "late")
    for n, hours in enumerate(([0, 1], [30], [31], [2], [60])):
        rows = [(10 * n + i, at(h), 1, "click", 1.0, "{}") for i, h in enumerate(hours)]
        spark.createDataFrame(rows, E.SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = E.read_stream(spark, path).withWatermark("ts", "2 hours")
    counted = {(r[0].day, r[0].hour): r[2] for r in _ran(E.tumbling(stream, "6 hours"), "append", "late")}
    assert counted == {(1, 0): 2, (2, 6): 2}


def test_registered_stream(spark, small):
    assert plans.streamed_totals(spark, small).count() == 5


def _silences(rows, seconds, until):
    """Times (ms) after which a user has no event for so long, as plain lists; rows of user and hours."""
    out = []
    for user in {u for u, _ in rows}:
        times = sorted(h for u, h in rows if u == user)
        for t in sorted(set(times)):
            if not any(t < x <= t + seconds / 3600 for x in times) and t + seconds / 3600 <= until:
                out.append((user, t, times.count(t)))
    return sorted(out)


def test_silence_over_late_rows_and_a_restart(spark, tmp_path):
    """Rows that come late, but not too late, break a silence that seemed to be one; the stream stops and goes on."""
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    batches = [[(1, 0), (1, 0), (2, 1), (1, 9)], [(1, 5), (1, 8), (3, 11)], [(2, 4), (1, 12), (2, 30)], [(3, 31), (1, 60)]]
    folder = str(tmp_path / "silence")
    for n, rows in enumerate(batches):
        spark.createDataFrame([(10 * n + i, at(h), u, "click", 1.0, "{}") for i, (u, h) in enumerate(rows)], E.SCHEMA).coalesce(2).write.mode("append").parquet(f"{folder}/in")
        stream = E.read_stream(spark, f"{folder}/in", 100).withWatermark("ts", "8 hours")
        with streams._rocks(spark):
            found = streams._appended(E.silences(stream, 6 * 3600), folder)
    hours = lambda t: (t - at(0)).total_seconds() / 3600
    rows = [r for b in batches for r in b]
    assert sorted((r.user_id, hours(r.silent_since), r.events_then) for r in found.collect()) == _silences(rows, 6 * 3600, 52)


def test_silent_users(spark, small):
    found = sorted((r.user_id, r.silent_since, r.events_then) for r in streams.silent_users(spark, small).collect())
    start = dt.datetime(2024, 1, 1)
    rows = [(r.user_id, (r.ts.replace(microsecond=r.ts.microsecond // 1000 * 1000) - start).total_seconds() / 3600) for r in table(spark, small, "events").collect()]
    until = max(h for _, h in rows) - 1
    assert [(u, round((t - start).total_seconds() / 3600, 6), n) for u, t, n in found] == [(u, round(h, 6), n) for u, h, n in _silences(rows, 6 * 3600, until)]
    assert len(found) > 100


def test_silences_of_a_busy_user_take_time_in_proportion(spark, tmp_path):
    """3000 silences of one user, the last of which ends with the watermark, another user's row without a time, and files that go back in time."""
    import time

    from .oracle import compare, connection

    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(1, at(7 * i)) for i in range(3000)] + [(2, at(1)), (2, at(6)), (2, None), (3, at(7 * 2999 + 7))]
    rows = [(i, ts, u, "click", 1.0, "{}") for i, (u, ts) in enumerate(rows)]
    for part in (rows[1500:], rows[:1500]):
        spark.createDataFrame(part, E.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    began = time.time()
    found = streams.silent_users(spark, str(tmp_path))
    assert time.time() - began < 40
    con = connection(str(tmp_path / "none"))
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert found.count() == 3001
    assert compare(found, streams.QUERIES["silent_users"][1], con) == ""
