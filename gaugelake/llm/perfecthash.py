"""Minimal perfect hashes of byte strings, in shards, with the strings stored for verification.

A shard places its keys level by level: a bit array with room for twice the keys that are left takes those
that meet no other key in it, the rest go on to the next level. A key's slot is the number of bits set
before its own, so slots run from 0 without a gap. A string that is no key may meet a set bit as well;
comparing it with the key of that slot tells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from gaugelake.llm.hashing import mixed

#: Seed of Spark's ``xxhash64``, so that both sides deal keys to the same shard.
SEED = 42
LEVELS, ROOM = 24, 2
_LEVEL_SEED = 0x9E3779B97F4A7C15


def hashes(keys: list[bytes]) -> np.ndarray:
    """As Spark's ``xxhash64`` of one string, unsigned."""
    return np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in keys), np.uint64, len(keys))


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    """As ``pmod(xxhash64(key), n)``."""
    return h.view(np.int64) % n


class PerfectHash:
    """Slots 0 to n - 1 for n different keys."""

    def __init__(self, keys: list[bytes]):
        h, left = hashes(keys), np.arange(len(keys))
        slots = np.empty(len(keys), np.int64)
        self.words: list[np.ndarray] = []
        self.ranks: list[np.ndarray] = []  # set bits before each word, those of earlier levels included
        placed = 0
        while len(left) and len(self.words) < LEVELS:
            n_words = -(-ROOM * len(left) // 64)
            at = self._places(h[left], len(self.words), n_words)
            alone = np.bincount(at, minlength=64 * n_words)[at] == 1
            words = np.zeros(n_words, np.uint64)
            np.bitwise_or.at(words, at[alone] >> 6, np.uint64(1) << (at[alone] & 63).astype(np.uint64))
            counts = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self.words.append(words)
            self.ranks.append(placed + np.concatenate(([0], counts[:-1])))
            slots[left[alone]] = self._ranked(len(self.words) - 1, at[alone])
            placed += int(counts[-1])
            left = left[~alone]
        # keys of one and the same hash never part
        self.rest = {keys[i]: placed + k for k, i in enumerate(left.tolist())}
        slots[left] = placed + np.arange(len(left))
        self.keys = pa.array(keys, pa.binary()).take(pa.array(np.argsort(slots)))

    def __len__(self) -> int:
        return len(self.keys)

    @staticmethod
    def _places(h: np.ndarray, level: int, n_words: int) -> np.ndarray:
        seed = np.uint64(_LEVEL_SEED * (level + 1) % 2**64)
        return (mixed(h + seed) % np.uint64(64 * n_words)).astype(np.int64)

    def _ranked(self, level: int, at: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ranks[level][at >> 6] + np.bitwise_count(self.words[level][at >> 6] & below)

    def slots(self, keys: pa.Array, h: np.ndarray) -> np.ndarray:
        """The slot of each of ``keys`` (whose ``hashes`` are ``h``), -1 for what is no key."""
        found = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for level, words in enumerate(self.words):
            at = self._places(h[left], level, len(words))
            hit = (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            found[left[hit]] = self._ranked(level, at[hit])
            left = left[~hit]
        if self.rest:
            for i in left.tolist():
                found[i] = self.rest.get(keys[i].as_py(), -1)
        hits = np.flatnonzero(found >= 0)
        same = pc.equal(self.keys.take(pa.array(found[hits])), keys.take(pa.array(hits)))
        found[hits[~same.to_numpy(zero_copy_only=False)]] = -1
        return found
