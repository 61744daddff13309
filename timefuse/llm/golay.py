"""The binary Golay code [23,12,7] as a fuzzy hash of short bit strings.

The code is perfect: each 23-bit string lies within three bits of exactly one
code word, so decoding maps it to one 12-bit index. Decoding the string and all
its one-bit neighbours gives a few indices (six in most cases); a string one
bit away decodes to one of them.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _syndrome(v: np.ndarray) -> np.ndarray:
    r = v.astype(np.uint32)
    for bit in range(22, 10, -1):
        r = np.where(r >> np.uint32(bit) & np.uint32(1), r ^ np.uint32(GENERATOR << (bit - 11)), r)
    return r


@lru_cache(maxsize=1)
def _errors() -> np.ndarray:
    """The error pattern (three bits at most) of each of the 2048 syndromes."""
    patterns = np.array([sum(1 << b for b in c) for k in range(4) for c in combinations(range(23), k)], dtype=np.uint32)
    table = np.zeros(2048, dtype=np.uint32)
    table[_syndrome(patterns)] = patterns
    return table


def index(v: np.ndarray) -> np.ndarray:
    """The 12-bit index of the code word nearest to each 23-bit value."""
    v = v.astype(np.uint32)
    return ((v ^ _errors()[_syndrome(v)]) >> np.uint32(11)).astype(np.int64)


def near_indices(v: np.ndarray, bits: int) -> np.ndarray:
    """Per value, the distinct indices of it and its neighbours at one of the
    low ``bits`` bits: a matrix padded with -1, as wide as the longest row."""
    v = v.astype(np.uint32)
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint32)
    found = np.sort(index(v[:, None] ^ flips[None, :]), axis=1)
    fresh = np.ones(found.shape, dtype=bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    out = np.full((len(v), int(fresh.sum(axis=1).max(initial=1))), -1, dtype=np.int64)
    row, col = np.nonzero(fresh)
    out[row, fresh.cumsum(axis=1)[row, col] - 1] = found[row, col]
    return out
