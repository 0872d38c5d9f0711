"""Components and nearest vectors against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quire.operators.graphs import components
from quire.operators.search import approximate_nearest, nearest
from quire.plans import links


def _components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {x: find(x) for x in list(root)}


def test_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(1000, 1200)]
    some = [(rng.randrange(300), rng.randrange(300)) for _ in range(120)]
    edges = [*chain, *some, *some[:20], (5, 5), (-3, 900), (None, 1), (2, None)]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == _components(edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _vectors(rng, n):
    return [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 8)).astype(np.float32))]


def _nearest(asked, rows, k):
    out = set()
    for q, a in asked:
        scored = []
        for i, b in rows:
            if b is not None and any(b) and i != q and a is not None and any(a):
                x, y = np.array(a, float), np.array(b, float)
                scored.append((-round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 9), i))
        out |= {(q, i, rank + 1) for rank, (_, i) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("most", [3, 50_000])
def test_nearest(spark, most):
    rows = _vectors(np.random.default_rng(1), 90)
    rows += [(90, rows[0][1]), (91, rows[0][1]), (92, None), (93, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    asked = [r for r in rows if r[0] % 9 == 0 or r[0] > 89]
    found = nearest(df.where("vec_id % 9 = 0 or vec_id > 89"), df, 4, most).collect()
    assert {(r.query_id, r.vec_id, r["rank"]) for r in found} == _nearest(asked, rows, 4)
    assert nearest(df.where("false"), df, 4).count() == 0 and nearest(df, df.where("false"), 4).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_the_approximate_search(spark, sf):
    folder = f"/root/testdata/{sf}"
    exact = {(r.query_id, r.vec_id) for r in links.nearest_vectors(spark, folder).collect()}
    found = {(r.query_id, r.vec_id) for r in links.approximate_vectors(spark, folder).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_approximate_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [0.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = approximate_nearest(df, df, 1).collect()
    assert (0, 1, 1.0) in {(r.query_id, r.vec_id, r.similarity) for r in found} and not {2, 3, None} & {r.query_id for r in found}
    assert approximate_nearest(df.where("false"), df.where("false"), 1).count() == 0


def test_only_probed_cells_are_searched(spark):
    """Two directions far apart: the nearest are on a query's own side, so one cell is enough, and it sees no other."""
    rows = [(i, [1.0, 0.01 * i]) for i in range(20)] + [(100 + i, [-1.0, 0.01 * i]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = approximate_nearest(df.where("vec_id in (0, 100)"), df, 15, cells=2).collect()
    assert len(found) == 30 and all((r.query_id < 100) == (r.vec_id < 100) for r in found)


def test_a_task_gives_its_best_once(spark):
    """However many batches a task reads, no more than k rows a query and task come out; ties go to the least id in any of them."""

    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(500)] + [(500, None), (501, [0.0] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    asked = vectors.where("vec_id % 50 = 0")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        found = nearest(asked, vectors, 4)
        got = {(r.query_id, r["rank"]): r.vec_id for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and any(v)}
    for q in [i for i in unit if i % 50 == 0]:
        order = sorted((i for i in unit if i != q), key=lambda i: (-round(float(unit[q] @ unit[i]), 9), i))[:4]
        assert [got[q, k] for k in range(1, 5)] == order
