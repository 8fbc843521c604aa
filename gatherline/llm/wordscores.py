"""Documents as sums over their words: each distinct word is scored once per worker."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np


class WordScores:
    """A bounded table of word → row of numbers, filled for the words of one block at a time."""

    def __init__(self, compute: Callable[[list], np.ndarray], width: int, limit: int = 300_000):
        self.compute, self.width, self.limit = compute, width, limit
        self.index: dict = {}
        self.rows = np.zeros((1 << 12, width))

    def totals(self, words: list[list]) -> np.ndarray:
        """Sum of the words' rows for each document."""
        if len(self.index) > self.limit:
            self.index.clear()
        missing = list(set(chain.from_iterable(words)).difference(self.index))
        if missing:
            at, end = len(self.index), len(self.index) + len(missing)
            if end > len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros((max(end, 2 * len(self.rows)) - len(self.rows), self.width))))
            self.rows[at:end] = self.compute(missing)
            self.index.update(zip(missing, range(at, end), strict=True))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        which = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64, int(lengths.sum()))
        out = np.zeros((len(words), self.width))
        some = np.flatnonzero(lengths)
        if len(some):
            starts = np.concatenate(([0], np.cumsum(lengths)))[:-1][some]
            out[some] = np.add.reduceat(self.rows[which], starts, axis=0)
        return out


def spans(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each string begins (one more for the end)."""
    return np.frombuffer(b"".join(strings), np.uint8), np.concatenate(([0], np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))))
