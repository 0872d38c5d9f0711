"""Nearest vectors of a stated query set: exactly, and approximately, among the cells around a query."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.intermediate import written
from ..sources.shipping import ship
from .ranking import top_per_group

#: Query vectors that are held against the table in one pass, their bytes, and those that are held against a batch at once.
PASS, PASS_BYTES, _QUERIES_AT_ONCE = 50_000, 64 << 20, 1024
#: Vectors that centres are fitted on, about, rounds of fitting, and the share of the nearest that is aimed at.
SAMPLE, ROUNDS, RECALL = 20_000, 8, 0.95

_PAIRS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("similarity", pa.float64())])


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    return top_per_group(pairs, ["query_id"], [F.desc("similarity"), F.asc("vec_id")], k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, most: int = PASS) -> DataFrame:
    """query_id, vec_id, similarity (cosine) and rank: the k vectors nearest to each query, itself left out.

    ``queries`` and ``vectors`` have vec_id and embedding. Queries go over the table in passes of at most ``most``;
    each task gives at most k rows for each query, so what is shuffled is small and nothing is
    collected but the queries of one pass. Of equal similarities (to 9 digits) the least id is nearest. Null vectors, and
    vectors without a length, are near to nothing.
    """
    return _searched(queries, vectors, k, most, None, 0)


def approximate_nearest(queries: DataFrame, vectors: DataFrame, k: int, recall: float = RECALL, cells: int | None = None, most: int = PASS, sample: int = SAMPLE) -> DataFrame:
    """As ``nearest``, among the vectors whose nearest centre is one of the centres nearest to the query.

    The centres (``cells`` of them, or the square root of the sample's size) are fitted on about ``sample`` vectors chosen by
    a hash of their id; every vector is searched. How many centres a query probes is the least number that finds
    ``recall`` of the nearest vectors within the sample, so vectors in clusters are searched in few
    cells and vectors in all directions in many.
    """
    rows = _drawn(vectors, sample)
    centres = _centres(rows, cells)
    return _searched(queries, vectors, k, most, centres, _probes(rows, centres, k, recall))


def _searched(queries: DataFrame, vectors: DataFrame, k: int, most: int, centres: np.ndarray | None, probes: int) -> DataFrame:
    ship(queries.sparkSession)
    results = []
    passes = _passes(queries, most)
    now, more = next(passes, None), next(passes, None)
    while now is not None:
        shared = queries.sparkSession.sparkContext.broadcast((*now, centres))
        found = vectors.select("vec_id", "embedding").mapInArrow(partial(_held_against, shared, k, probes), "query_id long, vec_id long, similarity double")
        if more is not None:  # a pass's queries are let go before the next one's are read
            found = written(found, "nearest")
            shared.destroy()
        results.append(found)
        now, more = more, next(passes, None)
    if not results:
        return _ranked(queries.sparkSession.createDataFrame([], "query_id long, vec_id long, similarity double"), k)
    return _ranked(reduce(DataFrame.unionByName, results), k)


class _Best:
    """The k best vectors of each query so far: by similarity, of equal ones the least id."""

    def __init__(self, queries: int, k: int):
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.similarity = np.full((queries, k), -np.inf)

    def add(self, at: np.ndarray, ids: np.ndarray, own: np.ndarray, similarity: np.ndarray) -> None:
        """``similarity`` of the queries numbered ``at``, whose ids are ``ids``, to the vectors ``own``, ascending."""
        similarity[ids[:, None] == own[None]] = -np.inf
        k = self.ids.shape[1]
        best = np.argsort(-similarity, axis=1, kind="stable")[:, :k]
        both = np.concatenate([self.similarity[at], np.take_along_axis(similarity, best, axis=1)], axis=1)
        names = np.concatenate([self.ids[at], own[best]], axis=1)
        order = np.argsort(names, axis=1, kind="stable")
        order = np.take_along_axis(order, np.argsort(-np.take_along_axis(both, order, axis=1), axis=1, kind="stable"), axis=1)[:, :k]
        self.similarity[at], self.ids[at] = np.take_along_axis(both, order, axis=1), np.take_along_axis(names, order, axis=1)


def _held_against(shared, k: int, probes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k best vectors of all batches of a task for every query, among those of the cells that it probes: given once, at the end."""
    ids, matrix, centres = shared.value
    probed = None if centres is None else np.argsort(-(matrix @ centres.T), axis=1, kind="stable")[:, :probes]
    best = _Best(len(ids), k)
    for b in batches:
        own, rows = _unit(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist())
        if not len(own):
            continue
        order = np.argsort(own, kind="stable")  # among equals the least id comes first
        own, rows = own[order], rows[order]
        cell = np.zeros(len(own), np.int64) if probed is None else np.argmax(rows @ centres.T, axis=1)
        for c in np.unique(cell):
            asking = np.arange(len(ids)) if probed is None else np.flatnonzero((probed == c).any(1))
            mine = cell == c
            for at in range(0, len(asking), _QUERIES_AT_ONCE):
                some = asking[at : at + _QUERIES_AT_ONCE]
                best.add(some, ids[some], own[mine], np.round(matrix[some] @ rows[mine].T, 9))
    found = np.isfinite(best.similarity)
    query = np.repeat(ids, k).reshape(best.ids.shape)
    yield pa.RecordBatch.from_arrays([pa.array(query[found]), pa.array(best.ids[found]), pa.array(best.similarity[found])], schema=_PAIRS)


def _drawn(vectors: DataFrame, sample: int) -> np.ndarray:
    """About ``sample`` vectors of length 1, in an order of their own."""
    share = min(1.0, sample / max(1, vectors.count()))
    drawn = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share * (1 << 20)
    some = vectors.where(drawn & F.col("embedding").isNotNull()).select("vec_id", "embedding").toArrow()
    _, rows = _unit(some.column("vec_id").to_pylist(), some.column("embedding").to_pylist())
    return rows[np.lexsort(rows.T)] if len(rows) else rows


def _centres(rows: np.ndarray, cells: int | None) -> np.ndarray | None:
    """Centres of directions by k-means; None where there is no vector."""
    if not len(rows):
        return None
    rng = np.random.default_rng(7)
    centres = rows[rng.choice(len(rows), min(len(rows), cells or int(len(rows) ** 0.5)), replace=False)]
    for _ in range(ROUNDS):
        cell = np.argmax(rows @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, cell, rows)
        length = np.sqrt((total**2).sum(1, keepdims=True))
        centres = np.where(length > 0, total / np.maximum(length, 1e-12), centres)
    return centres


def _probes(rows: np.ndarray, centres: np.ndarray | None, k: int, recall: float) -> int:
    """The least number of cells around a vector that hold ``recall`` of its k nearest in the sample."""
    if centres is None or len(rows) < 2:
        return 1
    asked = np.random.default_rng(8).choice(len(rows), min(len(rows), 500), replace=False)
    near = rows[asked] @ rows.T
    near[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(rows) - 1)]
    cell = np.argmax(rows @ centres.T, axis=1)
    place = np.argsort(np.argsort(-(rows[asked] @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(place, cell[best], axis=1).ravel()
    return int(np.searchsorted(np.cumsum(np.bincount(needed)), recall * len(needed))) + 1


def _unit(ids: list, vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of length 1, for those that have a length."""
    kept = [(i, v) for i, v in zip(ids, vectors, strict=True) if i is not None and v is not None and any(v)]
    if not kept:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    matrix = np.array([v for _, v in kept], np.float64)
    return np.array([i for i, _ in kept], np.int64), matrix / np.sqrt((matrix**2).sum(1, keepdims=True))


def _passes(queries: DataFrame, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries in parts of at most ``most`` vectors and about ``PASS_BYTES`` bytes."""
    some, held = [], 0
    for r in queries.select("vec_id", "embedding").toLocalIterator():
        some.append((r["vec_id"], r["embedding"]))
        held += 8 * len(r["embedding"] or ())
        if len(some) == most or held >= PASS_BYTES:
            yield _unit(*zip(*some, strict=True))
            some, held = [], 0
    if some and len((found := _unit(*zip(*some, strict=True)))[0]):
        yield found
