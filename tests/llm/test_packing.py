from __future__ import annotations

import random
from collections import defaultdict

import pytest

from quire.llm import packing


def _texts(kind):
    rng = random.Random(7)
    if kind == "equal":
        return [b"".join(i.to_bytes(4, "little") for i in range(1300))] * 300
    sizes = [1300] * 100 + [rng.randint(1, 2047) for _ in range(200)]
    return [b"".join(rng.randrange(50_000).to_bytes(4, "little") for _ in range(n)) for n in sizes]


@pytest.mark.parametrize("kind", ["equal", "mixed"])
def test_a_block_has_no_window_more_than_its_tokens_need(kind):
    texts = _texts(kind)
    packer = packing._Packer(2048, 256, 0)
    for i, ids in enumerate(texts):
        packer.add(i, ids)
    packer.settle()
    windows, documents = defaultdict(int), defaultdict(list)
    for doc_id, start, length, crc, n, sequence, offset in sorted(packer.rows, key=lambda r: r[5:]):
        assert offset == windows[sequence] and length > 0
        assert (doc_id, start, length, crc, n) == packing._piece(doc_id, texts[doc_id], start, length, len(texts[doc_id]) // 4)
        windows[sequence] += length
        documents[doc_id].append((start, length))
    assert max(windows.values()) <= 2048 and len(windows) == -(-sum(map(len, texts)) // 4 // 2048)
    for doc_id, ids in enumerate(texts):
        at = 0
        for start, length in sorted(documents[doc_id]):
            assert start == at
            at += length
        assert at == len(ids) // 4
