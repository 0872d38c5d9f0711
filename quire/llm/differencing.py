"""Karmarkar-Karp multiway differencing: items into k subsets of nearly equal sum."""

from __future__ import annotations

import heapq


def difference(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """Split the items into ``k`` subsets; returns (sum, item numbers) for each, smallest sum first.

    Every item starts as a partial partition with the item in one subset and nothing in the
    others. The two partial partitions with the largest imbalance (largest less smallest
    subset) are merged so that the heaviest subset of one meets the lightest of the other,
    until a single partition is left. Empty subsets are kept implicit, so a partition
    costs as much as it has filled subsets. Equal sizes are taken in item order, so the
    result is a function of ``sizes`` and ``k`` alone. No items: k empty subsets.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    heap = [(-(s if k > 1 else 0), i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        empty = k - len(a)
        met = [
            x if i < empty else (x[0] + a[i - empty][0], a[i - empty][1] + x[1])
            for i, x in enumerate(reversed(b))
        ]
        merged = met + a[max(0, len(b) - empty) :]
        merged.sort(key=_total)
        low = merged[0][0] if len(merged) == k else 0
        heapq.heappush(heap, (low - merged[-1][0], serial, merged))
        serial += 1
    filled = heap[0][2] if heap else []
    return [(0, []) for _ in range(k - len(filled))] + filled


def _total(subset: tuple[int, list[int]]) -> int:
    return subset[0]
