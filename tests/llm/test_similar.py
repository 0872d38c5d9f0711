from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from quire.llm import similar
from quire.llm.frames import table


def _brute(texts):
    """All pairs of texts of likeness 0.8 or more, by their five-word shingles as plain tuples."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    likeness = lambda a, b: len(a & b) / len(a | b)
    return {(i, j) for j in range(len(sets)) for i in range(j) if likeness(sets[i], sets[j]) >= 0.8}


def _kept(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return {i for i in range(n) if root[i] == i}


def test_stage_against_brute_force(spark, empty):
    """Copies with some words changed, of likeness about 0.6 to 1."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 400))]
        texts.append(" ".join(words))
        for changes in range(8):
            copy = list(words)
            for _ in range(changes * len(words) // 180 + 1):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    pairs = _brute(texts)
    assert len(pairs) > 150
    docs = spark.createDataFrame([(i, t, "en", "a/x", len(t)) for i, t in enumerate(texts)], empty.schema)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == _kept(len(texts), pairs)


def test_all_documents(spark, small):
    docs = table(spark, small, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    kept = _kept(len(rows), _brute([t for _, t in rows]))
    assert {r.doc_id for r in similar.keep_one(docs).collect()} == {rows[i][0] for i in kept}


def test_odd_rows(odd, empty):
    kept = similar.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda i: i or -1) == [None, 1, 2, 3, 4, 7, 8, 11]
    assert similar.keep_one(empty).count() == 0


def test_a_large_group_of_near_copies(spark, empty):
    """Copies of one text that are mostly not alike enough to each other; the blocks hold a few of them."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(90)]
    texts = []
    for _ in range(160):
        copy = list(words)
        for _ in range(rng.choice([1, 2, 2, 3, 3, 4, 6])):
            copy[rng.randrange(len(copy))] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    pairs = _brute(texts)
    assert len(pairs) < 0.4 * 160 * 159 / 2
    docs = spark.createDataFrame([(i, t, "en", "a/x", len(t)) for i, t in enumerate(texts)], empty.schema)
    kept = _kept(len(texts), pairs)
    assert 10 < len(kept) < 130
    assert {r.doc_id for r in similar.keep_one(docs, block=2000).collect()} == kept


def test_forest_against_all_pairs():
    rng = random.Random(7)
    for both_sides in (False, True):
        for _ in range(40):
            n = rng.randint(2, 25)
            sets = [np.unique(np.array([rng.randrange(30) + 100 * rng.randrange(3) for _ in range(rng.randint(1, 12))], np.int64)) for _ in range(n)]
            sets += [np.union1d(sets[rng.randrange(n)], [999]) for _ in range(n)]
            left = [not both_sides or rng.random() < 0.5 for _ in sets]
            kinds = [rng.randrange(2 * n) for _ in sets]
            wanted = {
                (i, j)
                for j in range(2 * n)
                for i in range(j)
                if (left[i] != left[j] or all(left)) and similar.alike(sets[i], sets[j])
            }
            same = [(kinds.index(k), i) for i, k in enumerate(kinds) if kinds.index(k) != i]
            found = similar._forest(list(range(2 * n)), kinds, left, sets)
            assert all((min(x), max(x)) in wanted for x in found)
            assert _kept(2 * n, same + found) == _kept(2 * n, same + sorted(wanted))


def test_fingerprints_near_each_other_are_paired(spark):
    """What Golay keys give, by plain components of all pairs at most three bits apart, equal fingerprints included."""
    rng = random.Random(8)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for f in rng.choices(fps, k=80)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(i, f, []) for i, f in enumerate(signed)], "node long, fp long, keys array<long>")
    found = [(r.a, r.b) for r in similar._near_fingerprints(nodes).collect()]
    wanted = [(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert len(wanted) > 30 and _kept(len(fps), found) == _kept(len(fps), wanted)


def test_fingerprints_follow_likeness():
    rng = random.Random(9)
    sketch = similar.Sketch()
    words = [f"w{rng.randrange(500)}" for _ in range(3000)]
    bits = lambda f: f & (1 << 64) - 1
    own = bits(sketch(" ".join(words))[3])
    near = bits(sketch(" ".join(["changed", *words[1:]]))[3])
    far = bits(sketch(" ".join(rng.sample(words, len(words))))[3])
    assert (own ^ near).bit_count() <= 3 < (own ^ far).bit_count() and sketch("")[3] == sketch(None)[3] == 0


def test_verified_pairs_of_a_hot_leader(spark):
    """A leader's pairs are dealt to several tasks; what they find joins what all alike pairs join."""
    rng = random.Random(10)
    base = list(range(1000))
    sets = [sorted({*base[rng.randint(0, 400) :], *range(5000, 5000 + rng.randint(0, 100))}) for _ in range(200)] + [[]]
    nodes = spark.createDataFrame(list(enumerate(sets)), "node long, hashes array<long>")
    pairs = [(0, i) for i in range(1, 201)] + [(i, i + 1) for i in range(1, 199, 2)]
    likeness = lambda i, j: len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]})
    wanted = [p for p in pairs if likeness(*p) >= 0.8]
    assert 30 < len(wanted) < 280
    for most in (7, 2000):
        found = [(r.a, r.b) for r in similar._verified(spark.createDataFrame(pairs, "a long, b long"), nodes, most).collect()]
        assert {*found} <= {*wanted} and _kept(201, found) == _kept(201, wanted)


def test_a_very_long_text_and_its_copy(spark, empty):
    rng = random.Random(11)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    texts = [" ".join(words), " ".join([*words[:290_000], *words[:5000]]), " ".join(words[: len(words) // 2]), "", None, "one", "One", "one two three four five six seven"]
    docs = spark.createDataFrame([(i, t, "en", "a/x", 0) for i, t in enumerate(texts)], empty.schema)
    assert sorted(r.doc_id for r in similar.keep_one(docs).collect()) == [0, 2, 3, 5, 7]
