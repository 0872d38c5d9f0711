from __future__ import annotations

import random

from pyspark.sql import functions as F

from quire.functions import variants
from quire.operators import sketches

JSON = [(1, '{"k": 69, "n": {"a": [1, "x", null]}}'), (2, "[1, 2.5]"), (3, "{bad"), (4, None), (5, '"s"'), (6, "{}"), (7, '{"k": "7", "b": true}'), (8, '{"k": "no number", "n": {"a": []}}'), (9, "null"), (10, "")]


def test_variants_nested_and_malformed(spark):
    df = spark.createDataFrame(JSON, "id long, t string").withColumn("v", variants.parsed(F.col("t")))
    got = {r.id: r for r in df.select("id", variants.field(F.col("v"), "$.k", "int").alias("k"), variants.field(F.col("v"), "$.n.a[1]", "string").alias("x"), F.col("v").isNull().alias("none")).collect()}
    assert {i: r.k for i, r in got.items() if r.k is not None} == {1: 69, 7: 7} and got[1].x == "x"
    assert [i for i, r in got.items() if r.none] == [3, 4, 10]
    each = variants.exploded(df, "v", ["id"]).select("id", "pos", "key", F.to_json("value").alias("value"))
    assert sorted(map(tuple, each.collect()), key=repr) == sorted(
        [(1, 0, "k", "69"), (1, 1, "n", '{"a":[1,"x",null]}'), (2, 0, None, "1"), (2, 1, None, "2.5"), (7, 0, "b", "true"), (7, 1, "k", '"7"'), (8, 0, "k", '"no number"'), (8, 1, "n", '{"a":[]}')], key=repr
    )
    nested = variants.exploded(df.select("id", variants.field(F.col("v"), "$.n", "variant").alias("n")), "n", ["id"])
    assert sorted((r.id, r.key) for r in nested.collect()) == [(1, "a"), (8, "a")]
    objects = df.where("id in (1, 7)").agg(variants.schema_of(F.col("v")).alias("s")).collect()[0].s
    assert objects == "OBJECT<b: BOOLEAN, k: VARIANT, n: OBJECT<a: ARRAY<VARIANT>>>"


def test_sketches_are_within_their_bounds(spark):
    """More users than a sketch holds, over days that share some of them, with nulls."""
    rng = random.Random(1)
    rows = [(None if rng.random() < 0.01 else int(rng.triangular(0, 60_000, 10_000)) + (20_000 if kind == "b" else 0), kind, f"2024-01-{rng.randint(1, 9):02d} 00:00:00", None if rng.random() < 0.01 else rng.expovariate(0.1)) for kind in "ab" for _ in range(40_000)]
    events = spark.createDataFrame(rows, "user_id long, event_type string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    stored = sketches.daily(events, ["event_type"])
    merged = sketches.merged(stored, ["event_type"])
    users = {k: {u for u, kind, *_ in rows if kind == k and u is not None} for k in "ab"}
    values = {k: sorted(v for _, kind, _, v in rows if kind == k and v is not None) for k in "ab"}
    for r in merged.select("event_type", F.theta_sketch_estimate("theta").alias("theta"), F.hll_sketch_estimate("hll").alias("hll"), F.kll_sketch_get_quantile_double("kll", F.lit(0.9)).alias("q"), F.kll_sketch_get_n_double("kll").alias("n")).collect():
        own = users[r.event_type]
        assert len(own) > 4096
        assert abs(r.theta - len(own)) <= 3 * sketches.ERROR["theta"] * len(own) and abs(r.hll - len(own)) <= 3 * sketches.ERROR["hll"] * len(own)
        rank = sum(v <= r.q for v in values[r.event_type]) / len(values[r.event_type])
        assert abs(rank - 0.9) <= 2 * sketches.ERROR["kll"] and r.n == len(values[r.event_type])
    common = sketches.in_common(merged, "event_type").collect()
    assert [(r.event_type, r.other) for r in common] == [("a", "b")]
    shared = len(users["a"] & users["b"])
    assert abs(common[0].common - shared) <= 4 * sketches.ERROR["theta"] * len(users["a"] | users["b"])


def test_sessions_that_go_on_in_the_next_batch(spark, small):
    """The table function gets a user's rows two at a time."""
    from quire.plans import events

    wanted = sorted(map(tuple, events.user_sessions(spark, small).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert sorted(map(tuple, events.argued_sessions(spark, small).collect())) == wanted
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_more_users_than_a_sketch_holds(spark, tmp_path):
    """Types of more than 4096 users, one of few and the null one, with users, values and times that are null."""
    from quire.plans import sketched

    from .oracle import compare, connection

    rng = random.Random(2)
    many = [(rng.randint(0, 9000) + (3000 if kind == "b" else 0), kind, f"2024-01-{rng.randint(1, 10):02d} 00:00:00", 1.0) for kind in "ab" for _ in range(12_000)]
    few = [(u, kind, "2024-01-03 00:00:00", None if u % 2 else float("nan")) for kind in ("c", None) for u in range(50)] + [(100_000, "alone", "2024-01-03 00:00:00", 1.0)]
    odd = [(None, "a", "2024-01-03 00:00:00", 1.0), (None, "none", "2024-01-03 00:00:00", 1.0), (7, "c", None, 1.0)]
    events = spark.createDataFrame(many + few + odd, "user_id long, event_type string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "events.parquet")
    con = connection(str(tmp_path))
    for name, (query, sql) in sketched.QUERIES.items():
        if name.startswith("sketched"):
            assert compare(query(spark, str(tmp_path)), sql, con) == "", name
