from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from quire.llm import lm_score


def test_every_pair_has_its_own_cell():
    ids = np.array([a for x in range(1500) for y in range(0, 1500, 2) for a in (x, y)])
    pairs = set(zip([0, *ids[:-1].tolist()], ids.tolist(), strict=True))
    assert len(pairs) > 1 << 20 and len(np.unique(lm_score._cells(ids))) == len(pairs)


@pytest.mark.parametrize("hot", [1, 20, 1 << 19])
def test_scores_against_plain_counts(spark, hot):
    rng = random.Random(6)
    words = ["the", "cat", "dog", "house", "ran", "zebra", "quick", "of"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(60)]
    ids_of = lm_score.ByteIds()
    ids = {i: lm_score._ids(t, ids_of).tolist() for i, t in rows}
    counts = []
    for part in (range(20), range(20, 60)):
        counts.append([Counter(x for i in part for x in ids[i]), Counter(x for i in part for x in [0, *ids[i][:-1]]), Counter(p for i in part for p in zip([0, *ids[i][:-1]], ids[i], strict=True))])
    sizes = [sum(c[0].values()) for c in counts]

    def loss(i, model):
        (u, c, b), scale = counts[model], sizes[0] / sizes[model]
        uni = lambda x: (u[x] * scale + 1000 / lm_score.IDS) / (sizes[0] + 1000)
        return -sum(math.log((b[p] * scale + 4 * uni(p[1])) / (c[p[0]] * scale + 4)) for p in zip([0, *ids[i][:-1]], ids[i], strict=True)) / len(ids[i])

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lm_score.score(docs, docs.where("doc_id < 20").select("doc_id"), hot=hot).collect()
    assert len(found) == 60
    for r in found:
        assert abs(r.target_loss - loss(r.doc_id, 0)) < 1e-4 and abs(r.background_loss - loss(r.doc_id, 1)) < 1e-4
