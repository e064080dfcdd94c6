"""Word and shingle hashes of texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_P = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen lately; emptied when large."""

    MOST = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()


def lower_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over the word (a bijection)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def windows(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """A hash for each window of width words in order; with fewer words one of the whole sequence."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(width, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * _P + h[i : i + n]
    return mix(out)


def shingle_set(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    return np.unique(windows(words, width))
