"""The perfect binary Golay code (23, 12): every 23-bit word lies within 3 bits of exactly one codeword."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, INFORMATION = 23, 12
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def codewords() -> np.ndarray:
    """The 4,096 codewords; a codeword's index is the message it carries."""
    rows = np.array([GENERATOR << i for i in range(INFORMATION)], dtype=np.uint32)
    words = np.zeros(1, dtype=np.uint32)
    for row in rows:
        words = np.concatenate([words, words ^ row])
    return words


@cache
def decoder() -> np.ndarray:
    """The nearest codeword's index for each of the 2^23 words (16 MB, once per worker)."""
    errors = [0]
    for weight in (1, 2, 3):
        errors += [sum(1 << i for i in bits) for bits in combinations(range(LENGTH), weight)]
    words, table = codewords(), np.empty(1 << LENGTH, dtype=np.uint16)
    index = np.arange(len(words), dtype=np.uint16)
    for error in errors:
        table[words ^ np.uint32(error)] = index
    return table


def nearby(words: np.ndarray) -> np.ndarray:
    """For each word the indices of the codewords of itself and of all words one bit away.

    Returns shape (n, 6). Words 3 bits off their codeword have 6 different
    indices, others repeat their only one. A word's own index comes first, and two
    words that differ in one bit have each other's own index among theirs.
    """
    table = decoder()
    own = table[words]
    flips = table[words[:, None] ^ (np.uint32(1) << np.arange(LENGTH, dtype=np.uint32))[None, :]]
    flips.sort(axis=1)
    new = np.ones(flips.shape, dtype=bool)
    new[:, 1:] = flips[:, 1:] != flips[:, :-1]
    new &= flips != own[:, None]
    out = np.repeat(own[:, None], 6, axis=1)
    row, column = np.nonzero(new)
    place = np.cumsum(new, axis=1)[row, column]
    out[row, place] = flips[row, column]
    return out
