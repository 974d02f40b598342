"""Sets of distinct word shingles and their MinHash signatures."""

from __future__ import annotations

import numpy as np

from .words import NON_SPACE, hash_words, mix

_SALT = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[bytes], width: int = 5):
    """(values, bounds): sorted distinct hashes of each text's shingles of ``width`` words.

    A text of fewer words, but not none, has its whole word sequence as one
    shingle; a text without words has an empty set.
    """
    words, bounds = hash_words(texts, NON_SPACE)
    n = np.diff(bounds)
    with np.errstate(over="ignore"):
        last = max(len(words) - width + 1, 0)
        rolled = np.zeros(last, dtype=np.uint64)
        for k in range(width):
            rolled += words[k : k + last] * _SALT[k]
        rolled = mix(rolled)
    sets = []
    for i in range(len(texts)):
        a, m = int(bounds[i]), int(n[i])
        if m >= width:
            sets.append(np.unique(rolled[a : a + m - width + 1]))
        elif m:
            with np.errstate(over="ignore"):
                whole = (words[a : a + m] * _SALT[:m]).sum(dtype=np.uint64) + np.uint64(m) * _SALT[-1]
            sets.append(mix(np.array([whole], dtype=np.uint64)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    sizes = np.fromiter((len(s) for s in sets), dtype=np.int64, count=len(sets))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


class MinHasher:
    """``count`` universal hash functions (multiply, add, keep the high half); ``sign`` takes their minima over each set."""

    def __init__(self, count: int, seed: int = 1):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.a = rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, count, dtype=np.uint64)

    def sign(self, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """One row of uint32 minima for each nonempty set; rows of empty sets are all ones."""
        out = np.full((len(bounds) - 1, len(self.a)), 0xFFFFFFFF, dtype=np.uint32)
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            at = bounds[:-1][full]
            with np.errstate(over="ignore"):
                for k in range(len(self.a)):
                    high = ((values * self.a[k] + self.b[k]) >> np.uint64(32)).astype(np.uint32)
                    out[full, k] = np.minimum.reduceat(high, at)
        return out
