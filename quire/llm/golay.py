"""The perfect binary Golay code of length 23, as keys that survive a changed bit."""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, REDUNDANT = 23, 11
#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _remainder(v: int) -> int:
    for bit in range(LENGTH - 1, REDUNDANT - 1, -1):
        if v >> bit & 1:
            v ^= GENERATOR << (bit - REDUNDANT)
    return v


class Code:
    """Tables by syndrome: the error of at most 3 bits, and the five errors of 4 bits if that has 3."""

    def __init__(self):
        single = np.array([_remainder(1 << i) for i in range(LENGTH)])
        self.single = single
        self.nearest = np.zeros(1 << REDUNDANT, np.int64)
        self.far = np.zeros(1 << REDUNDANT, bool)
        others: list[list[int]] = [[] for _ in range(1 << REDUNDANT)]
        for weight in range(1, 5):
            for bits in combinations(range(LENGTH), weight):
                error = sum(1 << b for b in bits)
                syndrome = int(np.bitwise_xor.reduce(single[list(bits)]))
                if weight <= 3:
                    self.nearest[syndrome] = error
                    self.far[syndrome] = weight == 3
                else:
                    others[syndrome].append(error)
        self.others = np.array([o if self.far[s] else [0] * 5 for s, o in enumerate(others)], np.int64)
        self.low = self._table(0, 12)
        self.high = self._table(12, 11)

    def _table(self, at: int, bits: int) -> np.ndarray:
        out = np.zeros(1 << bits, np.int64)
        for i in range(bits):
            out[1 << i : 2 << i] = out[: 1 << i] ^ self.single[at + i]
        return out

    def keys(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The 12-bit indices of all codewords within distance 4 of each 23-bit vector, with the
        vectors' numbers: one index, or six.

        The code is perfect, so a vector v is within 3 of one codeword c; a vector that
        differs from v in one bit is within 4 of c. Two such vectors therefore share a key.
        """
        syndrome = self.low[vectors & 0xFFF] ^ self.high[vectors >> 12]
        first = (vectors ^ self.nearest[syndrome]) >> REDUNDANT
        far = np.flatnonzero(self.far[syndrome])
        more = (vectors[far][:, None] ^ self.others[syndrome[far]]) >> REDUNDANT
        number = np.concatenate([np.arange(len(vectors)), np.repeat(far, 5)])
        return number, np.concatenate([first, more.ravel()])
