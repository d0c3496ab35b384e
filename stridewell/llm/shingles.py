"""Word shingles of texts as 64-bit hashes, in Python workers."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M2
        x = (x ^ (x >> np.uint64(27))) * M3
        return x ^ (x >> np.uint64(31))


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` of the hashes h, in order."""
    n = len(h) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = (out + h[i : i + n]) * M1
            out ^= out >> np.uint64(29)
        return out + np.uint64(width)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted hashes of the runs of `width` words of a text; of a shorter text, of all its words; none without words."""
    words = text.encode().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(mix(rolled(word_hashes(words), min(width, len(words)))))
