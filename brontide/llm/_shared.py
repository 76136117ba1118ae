"""What several operators of this subpackage use."""

from __future__ import annotations

import numpy as np
import xxhash

from ..operators.staging import shared_dir, stored
from ._repeats import mix

store = stored


class WordHashes(dict):
    """64-bit hashes of words (bytes); forgets when it grows large."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k consecutive words; of the whole sequence if it is shorter."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    h = mix(words[: n - width + 1] + np.uint64(width))
    for j in range(1, width):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[j : n - width + 1 + j])
    return np.unique(h)
