"""Odd rows in the queries whose users are summed before pandas groups them."""

from __future__ import annotations

from quire.plans import events

ROWS = [(1, 1, "click", 2.0), (2, 1, "click", None), (3, 1, None, 5.0), (4, 2, None, 1.0), (5, None, "purchase", 3.0), (6, 3, "purchase", None), (7, 4, "view", 1.0), (8, 4, "click", 1.0)]


def _table(spark, folder, rows) -> str:
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_profiles(spark, tmp_path):
    found = {tuple(r) for r in events.user_profiles(spark, _table(spark, tmp_path, ROWS)).collect()}
    assert found == {(1, "click", 0.666667), (2, None, 1.0), (None, "purchase", 1.0), (3, "purchase", 1.0), (4, "click", 0.5)}


def test_pairs(spark, tmp_path):
    found = {tuple(r) for r in events.paired_users(spark, _table(spark, tmp_path, ROWS)).collect()}
    assert found == {(1, 2, 0, 0.0), (None, 0, 1, 3.0), (3, 0, 1, 0.0), (4, 1, 0, 0.0)}


def test_empty(spark, tmp_path):
    folder = _table(spark, tmp_path, [])
    assert events.user_profiles(spark, folder).count() == events.paired_users(spark, folder).count() == 0
