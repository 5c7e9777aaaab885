"""Word shingles as 64-bit numbers, with numpy inside tasks.

Words are runs of characters other than ASCII white space, A-Z lower-cased; a
shingle is five consecutive words, a shorter text is one shingle of all its
words.  A shingle's number mixes the 64-bit hashes of its words; two different
shingles share one with probability 2^-64.
"""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


class WordHashes(dict):
    """64-bit hash of each word seen, emptied when ``limit`` words are kept."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: bytes) -> np.ndarray:
        """Hashes of the text's words in order."""
        words = text.lower().split()  # of bytes: ASCII letters and white space only
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _HALF)) * _MIX
    return x ^ (x >> _HALF)


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Number of the shingle at each position (one for a short text)."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        h = np.full(n, np.uint64(width))
        for i in range(width):
            h = mixed(h * _ODD + words[i:i + n])
        return h
