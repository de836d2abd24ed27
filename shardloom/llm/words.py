"""Words of whole texts as numpy arrays: one 64-bit hash each, by polynomial prefix sums."""

from __future__ import annotations

import numpy as np

from ._common import kept
from .mph import mix

#: Maps A-Z to lower case and all ASCII but letters and digits to a space.
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_P = 0x9E3779B97F4A7C15 | 1
_Q = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = kept()


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1), modulo 2**64; kept and extended."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base & (1 << 64) - 1, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[base] = have
    return have[:n]


def normal(text: bytes | None) -> bytes:
    """Lower-cased ``text`` whose words are separated by single or more spaces."""
    return text.translate(WORD_TABLE) if text else b""


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of normal ``texts``, the number of words of each text, and the
    byte position of each word in the texts joined by one space."""
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    inside = data != 0x20
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.r_[0, edge]
    start, end = edge[0::2], edge[1::2]
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    counts = np.diff(np.r_[0, np.searchsorted(start, np.cumsum(sizes))])
    if not len(start):
        return np.zeros(0, dtype=np.uint64), counts, start
    total = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_P, len(data)), dtype=np.uint64)
    before = np.where(start > 0, total[np.maximum(start - 1, 0)], np.uint64(0))
    return mix((total[end - 1] - before) * powers(_Q, len(data))[start], 1), counts, start


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, in order, across the ends of texts as well."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out = out * np.uint64(_P) + words[i : i + n]
    return mix(out, k)
