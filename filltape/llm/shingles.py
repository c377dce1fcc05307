"""Words of a text as 64-bit hashes, and hashes of runs of words, inside tasks."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(29))


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` words; shorter texts have none."""
    count = len(hashes) - width + 1
    if count < 1:
        return np.empty(0, np.uint64)
    total = hashes[:count].copy()
    for offset in range(1, width):
        total *= _FACTOR
        total += hashes[offset : offset + count]
    return mixed(total)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words, A-Z in lower case.

    A shorter text is one run of all its words; a text without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(runs(word_hashes(words), min(width, len(words))))
