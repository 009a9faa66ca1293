"""Words of whole texts as 64-bit hashes, and rolling hashes of word windows, vectorised over batches of documents."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import LONGEST_KEPT, mix64

#: Words remembered by one worker before it forgets them all; with LONGEST_KEPT a bound on memory, not on the result.
WORD_MEMO = 200_000
#: Odd multipliers of the two window hashes.
ROLL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class WordHashes(dict):
    """bytes to 64-bit hash, filled on demand."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= LONGEST_KEPT:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > WORD_MEMO:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, size: int, roll: int = 0) -> np.ndarray:
    """Hash of each run of `size` words; windows that cross documents must be masked by the caller."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for k in range(1, size):
        h *= ROLL[roll]
        h += words[k : k + n]
    return mix64(h)


def batch_windows(hashes: WordHashes, texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, document of each window, start of each window in its document, start in the batch) of whole texts."""
    return list_windows(hashes, [t.split() for t in texts], size)


def list_windows(hashes: WordHashes, lists: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    words = hashes.of([w for x in lists for w in x])
    per_doc = np.maximum(counts - size + 1, 0)
    doc = np.repeat(np.arange(len(lists)), per_doc)
    first = np.cumsum(per_doc) - per_doc
    start = np.arange(len(doc)) - first[doc]
    at = start + (np.cumsum(counts) - counts)[doc]
    return words, doc, start, at
