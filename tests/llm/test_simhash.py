from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from quire.llm import golay, queries, simhash
from quire.llm.frames import table
from quire.operators import graphs


def _brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashed = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def _brute_classes(items):
    """(fp, id) pairs -> id of the least member of each item's class."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if (items[i][0] ^ items[j][0]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (_, doc_id) in enumerate(items):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [least[find(i)] for i in range(len(items))]


def test_all_documents(spark, small):
    rows = [(r.doc_id, _brute_fingerprint(r.text)) for r in table(spark, small, "documents").collect()]
    classes = _brute_classes([(fp, i) for i, fp in rows])
    expected = {(i, f"{fp:016x}", c) for (i, fp), c in zip(rows, classes, strict=True)}
    assert {tuple(r) for r in queries.op6_golay_simhash(spark, small).collect()} == expected
    assert len(set(classes)) < len(rows)


def test_golay_keys():
    code = golay.Code()
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 4000)
    number, key = code.keys(v)
    sizes = np.bincount(number)
    assert set(sizes) == {1, 6}
    sets = [set() for _ in v]
    for n, k in zip(number, key, strict=True):
        sets[n].add(int(k))
    assert all(len(s) == n for s, n in zip(sets, sizes, strict=True))
    for bit in range(23):
        number, key = code.keys(v ^ (1 << bit))
        near = [set() for _ in v]
        for n, k in zip(number, key, strict=True):
            near[n].add(int(k))
        assert all(a & b for a, b in zip(sets, near, strict=True))


def test_keys_meet_for_any_three_errors():
    code, rng = golay.Code(), random.Random(2)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        number, key = simhash.fuzzy_keys(np.array([a, b], np.uint64), code)
        assert set(key[number == 0]) & set(key[number == 1])


@pytest.mark.parametrize("block", [4, 4096])
def test_classes_of_many_near_fingerprints(spark, block):
    rng = random.Random(block)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for centre in list(fps)[:3]:
        for _ in range(40):
            fp = centre
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                fp ^= 1 << bit
            fps.add(fp)
    rows = [(fp, i) for i, fp in enumerate(sorted(fps))]
    signed = [(i, fp - (1 << 64) if fp >> 63 else fp) for fp, i in rows]
    distinct = spark.createDataFrame([(fp,) for _, fp in signed], "fp long")
    found = {r.node: r.root for r in graphs.components(simhash.links(distinct, block=block)).collect()}
    groups = {}
    for (i, fp), c in zip(signed, _brute_classes(rows), strict=True):
        groups.setdefault(c, set()).add(fp)
    for members in groups.values():
        assert {found.get(fp, fp) for fp in members} == {min(members)}


def test_odd_rows(odd, empty):
    from .conftest import ROWS

    found = sorted(simhash.near_duplicates(odd).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(found) == len(ROWS) and simhash.near_duplicates(empty).count() == 0
    by_id = {r.doc_id: r for r in found}
    assert by_id[3].fingerprint == by_id[5].fingerprint == "0" * 16 and by_id[5].component_id == 3
    assert by_id[9].component_id == by_id[1].component_id == 1 and by_id[None].component_id is None


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1001, 1000), (7, 7)]
    found = {r.node: r.root for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
