"""Word hashes and hashes of word runs, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_B = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_B, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)
#: Words a worker keeps hashes of at most.
KEPT = 200_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        self[word] = made = xxhash.xxh3_64_intdigest(word)
        return made


_hashes = _Hashes()


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of text (bytes.split() cuts at space and 0x09-0x0D)."""
    words = text.split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _grown(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 2 * len(_powers), 1 << 16)
        _powers, _inverses = (np.cumprod(np.where(np.arange(n) == 0, np.uint64(1), np.uint64(b)), dtype=np.uint64) for b in (_B, _INVERSE))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words (polynomials modulo 2^64, from prefix sums)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    _grown(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers[:n], dtype=np.uint64)])
    return mix((sums[k:] - sums[:-k]) * _inverses[: n - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w values, by doubling."""
    if len(x) < w:
        return x[:0]
    n, size, m = len(x) - w + 1, 1, x
    while 2 * size <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[:n], m[w - size : w - size + n])


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
