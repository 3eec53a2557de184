"""Rows of numbers per distinct word, computed once per worker process and looked up ever after."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import numpy as np


class WordTable(dict):
    """Word to row number; ``rows`` holds what ``compute(words)`` returns for them, one row each.

    At most ``most`` words are kept between calls: the table starts anew when it is larger, which changes no result.
    """

    def __init__(self, compute: Callable[[list[bytes]], np.ndarray], most: int = 200_000):
        super().__init__()
        self._compute, self._most, self._new, self._blocks, self.rows = compute, most, [], 0, None

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self._new.append(word)
        return at

    def look_up(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Row numbers of the words of each text, valid until the next call."""
        if len(self) > self._most:
            self.clear()
            self.rows, self._blocks = None, 0
        get = self.__getitem__
        out = [np.fromiter(map(get, words), dtype=np.int32, count=len(words)) for words in texts]
        if self._new:
            made = self._compute(self._new)
            need = self._blocks + len(made)
            if self.rows is None or need > len(self.rows):
                grown = np.empty((max(need, 2 * self._blocks, 1024), made.shape[1]), made.dtype)
                if self._blocks:
                    grown[: self._blocks] = self.rows[: self._blocks]
                self.rows = grown
            self.rows[self._blocks : need] = made
            self._blocks, self._new = need, []
        return out


def subwords(word: bytes, sizes: tuple[int, ...], buckets: int) -> list[int]:
    """Hashed byte n-grams of a marked word, and the word itself."""
    marked = b"<" + word + b">"
    out = [crc32(marked) % buckets]
    for n in sizes:
        out += [crc32(marked[i : i + n]) % buckets for i in range(len(marked) - n + 1)]
    return out


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of non-empty lists in one array, and where each list starts."""
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    numbers = np.fromiter((x for xs in lists for x in xs), dtype=np.int64, count=int(sizes.sum()))
    return numbers, np.concatenate(([0], np.cumsum(sizes)[:-1]))
