"""Sketches beside exact counts: every group of the events, and every sketch."""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quire.operators.quantiles import quantiles
from quire.plans import registry

from .oracle import compare, connection

ROWS = [(None, i % 7, float(i)) for i in range(40)]  # a type that is null
ROWS += [("two", 1, 1.0), ("two", 2, 9.0), ("four", 1, 1.0), ("four", 1, 5.0), ("four", 3, 6.0), ("four", None, 90.0)]
ROWS += [("no value", 5, None), ("no value", 6, None), ("no user", None, 1.5), ("nothing", None, None)]
ROWS += [("odd", i, math.nan) for i in range(20)] + [("odd", i, float(i)) for i in range(9)] + [("endless", 1, math.inf), ("endless", 2, math.inf), ("endless", 3, -math.inf)]


def test_every_group_and_sketch(spark, tmp_path):
    types, users, values = zip(*ROWS, strict=True)
    pq.write_table(pa.table({"event_type": pa.array(types, pa.string()), "user_id": pa.array(users, pa.int64()), "value": pa.array(values, pa.float64())}), tmp_path / "events.parquet")
    run, sql = registry.queries()["distinct_estimates"], registry.oracle_sql()["distinct_estimates"]
    found = run(spark, str(tmp_path))
    assert compare(found, sql, connection(str(tmp_path))) == ""
    rows = {r.event_type: r for r in found.collect()}
    assert set(rows) == {t for t, *_ in ROWS} and sum(r.n for r in rows.values()) == len(ROWS)
    assert all(r.count_min_there for r in rows.values())


def test_neighbours(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 4.0), ("b", 3.0), (None, 1.0), (None, 8.0)], "g string, v double")
    rows = {r.g: tuple(r)[1:] for r in quantiles(df, "g", "v", {"mid": 0.5}, neighbours=True).collect()}
    assert rows == {"a": (pytest.approx(3.0), 2.0, 4.0), "b": (3.0, 3.0, 3.0), None: (pytest.approx(4.5), 1.0, 8.0)}
