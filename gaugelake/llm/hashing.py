"""Hashes of words and their mixing, in NumPy."""

from __future__ import annotations

import numpy as np
import xxhash

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * _C1
    x = (x ^ (x >> np.uint64(30))) * _C2
    return x ^ (x >> np.uint64(29))


def runs_mixed(h: np.ndarray, width: int, start: int = 0) -> np.ndarray:
    """One hash for every ``width`` consecutive ones of ``h``."""
    n = len(h) - width + 1
    out = np.full(n, start, np.uint64)
    for k in range(width):
        out = mixed(out + h[k:n + k])
    return out


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive ones of ``h``."""
    done = 1
    while 2 * done <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    rest = width - done
    return np.minimum(h[:-rest], h[rest:]) if rest else h
