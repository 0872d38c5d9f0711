"""As-of joins in spans, exact quantiles by ranges and pages in blocks, against plain Python."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions.blocks import blocks
from quire.operators.joins import asof
from quire.operators.quantiles import quantiles

START = datetime(2024, 3, 9, 20)


@pytest.fixture
def many_parts(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "7")
    spark.conf.set(names[1], "false")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def _latest(lefts, rights):
    for i, k, t in lefts:
        times = [(u, v) for m, u, v in rights if k is not None and t is not None and m == k and u is not None and u <= t]
        last = max((u for u, _ in times), default=None)
        yield i, {v for u, v in times if u == last} or {None}


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize("hours", [1, 5, 24])
def test_asof_in_spans(spark, kind, zone, hours):
    """Most rows have one key; times meet, days pass without a right row, and clocks change in the zone."""
    rng = random.Random(hours)
    key = lambda: rng.choice(["hot"] * 6 + ["b", "c", None])
    time = lambda: None if rng.random() < 0.05 else START + timedelta(minutes=rng.randrange(5000))
    lefts = [(i, key(), time()) for i in range(150)]
    rights = [(key(), time(), j) for j in range(40)]
    rights += rights[:4]
    lefts += [(i, k, t) for i, (k, t, _) in enumerate(rights, 1000)]
    before = spark.conf.get("spark.sql.session.timeZone")
    text = lambda rows, at: [tuple(str(x) if n == at and x else x for n, x in enumerate(r)) for r in rows]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # A time that the clocks skip has no meaning in a zone, so instants are read as UTC.
        cast = lambda: F.to_timestamp(F.concat("t", F.lit("+00:00"))) if kind == "timestamp" else F.col("t").cast(kind)
        a = spark.createDataFrame(text(lefts, 2), "i int, k string, t string").withColumn("t", cast())
        b = spark.createDataFrame(text(rights, 1), "k string, t string, v int").withColumn("t", cast()).withColumnRenamed("t", "u")
        found = asof(a, b, "k", "t", "u", ["v"], hours).select("i", "v").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    expected = dict(_latest(lefts, rights))
    assert len(found) == len(lefts) and {r.i for r in found} == set(expected)
    assert all(r.v in expected[r.i] for r in found)


def test_asof_empty_sides(spark):
    a = spark.createDataFrame([(1, "x", START)], "i int, k string, t timestamp_ntz")
    b = spark.createDataFrame([], "k string, u timestamp_ntz, v int")
    assert [tuple(r) for r in asof(a, b, "k", "t", "u", ["v"]).select("i", "v").collect()] == [(1, None)]
    assert asof(a.where("false"), b, "k", "t", "u", ["v"]).count() == 0


def test_asof_names_that_clash(spark):
    """A left column may be called what the join uses itself, and have no order or hash."""
    a = spark.createDataFrame([("x", START, {"a": 1})], "k string, _time timestamp_ntz, _right map<string,int>")
    b = spark.createDataFrame([("x", START, 7)], "k string, u timestamp_ntz, _side int")
    row = asof(a, b, "k", "_time", "u", ["_side"]).collect()[0]
    assert tuple(row) == ("x", START, {"a": 1}, 7)


SHARES = {"low": 0.0, "q1": 0.25, "mid": 0.5, "most": 0.9, "high": 1.0}


def test_quantiles(spark, many_parts):
    rng = random.Random(9)
    rows = [("hot", rng.uniform(-50, 50)) for _ in range(3000)] + [("hot", 3.25)] * 1500
    rows += [(rng.choice("abc"), float(rng.randrange(6))) for _ in range(400)]
    rows += [(None, float(v)) for v in range(31)] + [("one", 2.5), ("none", None), ("hot", None), (None, None), ("two", -1.0), ("two", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = {r.g: r for r in quantiles(df, "g", "v", SHARES).collect()}
    groups = {g: [v for h, v in rows if h == g and v is not None] for g in {g for g, _ in rows}}
    assert set(found) == {g for g, values in groups.items() if values}
    for g, r in found.items():
        for name, share in SHARES.items():
            assert r[name] == pytest.approx(float(np.quantile(groups[g], share)), abs=1e-9), (g, name)
    assert quantiles(df.where("false"), "g", "v", SHARES).count() == 0


def test_a_group_lies_in_several_parts(spark, many_parts):
    """One group of different values: no task orders more than its range of them."""
    df = spark.range(20_000).select(F.lit("x").alias("g"), (F.col("id") * 7919 % 20_011).cast("double").alias("v"))
    sizes = [r["count"] for r in df.groupBy("g", "v").count().drop("count").repartitionByRange("g", "v").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 7 and max(sizes) < 2 * 20_000 / 7
    r = quantiles(df, "g", "v", {"mid": 0.5}).collect()[0]
    assert r.mid == float(np.median([i * 7919 % 20_011 for i in range(20_000)]))


def _blocks(spark, *pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    return [[tuple(b) for b in r.blocks] for r in blocks(rows, "i", "html").orderBy("i").collect()]


LONG = " ".join(f"word{i}" for i in range(30))


def test_blocks(spark):
    page = f"""<html><head><title>Not shown</title><script>"</p>"</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<!-- <p>hidden</p> --><DIV><a href=x>all</a> <A HREF=y>is</A> <a>linked here</a></DIV><article><h1>Short</h1><p>{LONG}<br/>&amp;lt; tail</p><aside><p>{LONG}</p></aside><p>{LONG} <a>one</a></p></article><footer>&copy; {LONG}"""
    found = _blocks(spark, page)[0]
    assert [(b[0][:12], b[1], round(b[2], 3), b[3], b[4]) for b in found] == [
        ("Home", 1, 1.0, True, False),
        ("all is linke", 4, 1.0, False, False),
        ("Short", 1, 0.0, False, True),
        (LONG[:12], 30, 0.0, False, True),
        ("&lt; tail", 2, 0.0, False, True),
        (LONG[:12], 30, 0.0, True, False),
        (LONG[:12], 31, round(1 / 31, 3), False, True),
        ("© word0 word", 31, 0.0, True, False),
    ]


def test_odd_pages(spark):
    found = _blocks(spark, None, "", "<p></p> <div>\n</div>", "alone", "<p>a</p><p>b</p><p>c</p>", f"<nav>x <nav>y</nav> {LONG}", "<navy>no region</navy>", f"<p>{LONG}")
    assert found[:3] == [[], [], []]
    assert found[3] == [("alone", 1, 0.0, False, False)]
    assert [b[4] for b in found[4]] == [False] * 3
    assert [(b[1], b[3], b[4]) for b in found[5]] == [(1, True, False), (1, True, False), (30, False, True)]
    assert found[6] == [("no region", 2, 0.0, False, False)] and found[7] == [(LONG, 30, 0.0, False, True)]


def test_a_long_page_takes_linear_time(spark):
    found = _blocks(spark, "".join(f"<p>{LONG} {i}</p>" for i in range(20_000)))[0]
    assert len(found) == 20_000 and all(b[4] for b in found)
