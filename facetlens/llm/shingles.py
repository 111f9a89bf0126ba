"""Word hashes and sets of word shingles, worked out in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import lower_words

U = np.uint64
STEP = U(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of each word, remembered in a worker up to a bound and then afresh."""

    BOUND = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), U, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive entries, by prefix and suffix minima of blocks of w."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, x.dtype)
    size = -(-len(x) // w) * w
    p = np.full(size, np.iinfo(x.dtype).max, x.dtype)
    p[: len(x)] = x
    p = p.reshape(-1, w)
    left = np.minimum.accumulate(p, axis=1).ravel()
    right = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def runs(h: np.ndarray, width: int) -> np.ndarray:
    """One hash for each `width` consecutive entries; all of them as one if there are fewer."""
    w = min(width, len(h))
    out = np.zeros(len(h) - w + 1, U)
    for k in range(w):
        out = out * STEP + h[k : len(h) - w + 1 + k]
    return mixed(out + U(w))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes."""
    words = lower_words(text)
    return np.unique(runs(word_hashes(words), width)) if words else np.zeros(0, U)
