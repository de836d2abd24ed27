"""A minimal perfect hash over distinct 64-bit keys, built and probed with numpy.

Each level hashes the keys that are left into twice as many bits; keys alone on their bit
stay there, the others go to the next level. A key's index is the rank of its bit.
"""

from __future__ import annotations

import io

import numpy as np

_LEVELS = 48


def mix(keys: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser that spreads all input bits."""
    x = keys + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class MinimalHash:
    """Maps each of n distinct keys to its own index below n; any other key to -1 or to
    some index, so the caller compares a stored fingerprint."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.rest = sizes, words, rest
        self.begin = np.cumsum(sizes) - sizes
        ones = np.bitwise_count(words).astype(np.int64)
        self.rank = np.cumsum(ones) - ones
        self.placed = int(ones.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalHash:
        left, sizes, words = keys.astype(np.uint64), [], []
        while len(left) and len(sizes) < _LEVELS:
            n = -(-2 * len(left) // 64) * 64
            at = (mix(left, len(sizes)) % np.uint64(n)).astype(np.int64)
            alone = np.bincount(at, minlength=n) == 1
            sizes.append(n)
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        empty = np.zeros(0, dtype=np.uint64)
        return cls(np.array(sizes, dtype=np.int64), np.concatenate(words) if words else empty, np.sort(left))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, (n, begin) in enumerate(zip(self.sizes.tolist(), self.begin.tolist())):
            if not len(todo):
                return out
            at = (mix(keys[todo], level) % np.uint64(n)).astype(np.int64) + begin
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[here]] = self.rank[at[here] >> 6] + below[here]
            todo = todo[~here]
        if len(todo) and len(self.rest):
            at = np.searchsorted(self.rest, keys[todo])
            here = self.rest[np.minimum(at, len(self.rest) - 1)] == keys[todo]
            out[todo[here]] = self.placed + at[here]
        return out

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        for part in (self.sizes, self.words, self.rest):
            np.save(out, part)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> MinimalHash:
        source = io.BytesIO(data)
        return cls(np.load(source), np.load(source), np.load(source))
