"""Hashed words of whole texts in numpy: what the shingle and substring operators have in common."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

_UP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_DOWN = pow(_UP, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes, so that near inputs spread."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Known(dict):
    """Word to its 64-bit hash; forgets everything when it is full."""

    most = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class WordHasher:
    """Hashes of words, and of any run of words, of one text after the other."""

    def __init__(self) -> None:
        self.known = _Known()
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        up, down = np.full(n, _UP, np.uint64), np.full(n, _DOWN, np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)

    def words(self, text: str | None) -> list[bytes]:
        """Words as UTF-8: bytes split at exactly space and the five ASCII control blanks."""
        return (text or "").encode().split()

    def sums(self, words: Iterable[bytes], n: int) -> np.ndarray:
        """Prefix sums from which ``runs`` takes the hash of any run of words."""
        if len(self.up) <= n:
            self._grow(2 * n)
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, n)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(h * self.up[:n], dtype=np.uint64, out=out[1:])
        return out

    def runs(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of words[start:end], for arrays of starts and ends."""
        return mix((sums[end] - sums[start]) * self.down[start])
