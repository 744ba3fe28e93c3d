"""Results per distinct word, held in flat arrays, so that frequent words are computed once."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence
from itertools import repeat

import numpy as np

LIMIT = 500_000  # words held by one Python worker; beyond it the cache starts anew


class WordCache:
    """Maps words to lists of whole numbers by `compute`, which gets distinct unknown words.

    The cache is emptied when it holds more than `limit` words, so its memory is bounded; that
    changes no result.
    """

    def __init__(self, compute: Callable[[list], Sequence[Sequence[int]]], limit: int = LIMIT) -> None:
        self.compute, self.limit = compute, limit
        self.clear()

    def clear(self) -> None:
        self.place: dict[Hashable, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _add(self, words: list) -> None:
        results = self.compute(words)
        first, count = len(self.place), len(words)
        sizes = np.fromiter(map(len, results), np.int64, count)
        values = np.fromiter((x for r in results for x in r), np.int32, int(sizes.sum()))
        while first + count > len(self.starts):
            self.starts, self.sizes = (np.r_[x, np.zeros_like(x)] for x in (self.starts, self.sizes))
        while self.used + len(values) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        self.flat[self.used : self.used + len(values)] = values
        self.sizes[first : first + count] = sizes
        self.starts[first : first + count] = self.used + np.cumsum(sizes) - sizes
        self.used += len(values)
        self.place.update(zip(words, range(first, first + count)))

    def __call__(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """The results of all words one after another, and how many each word has."""
        if len(self.place) > self.limit:
            self.clear()
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        lost = np.flatnonzero(at < 0)
        if len(lost):
            missing = [words[i] for i in lost.tolist()]
            self._add(list(dict.fromkeys(missing)))
            at[lost] = np.fromiter(map(self.place.__getitem__, missing), np.int64, len(lost))
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        positions = np.arange(total) + np.repeat(self.starts[at] - (ends - sizes), sizes)
        return self.flat[positions], sizes
