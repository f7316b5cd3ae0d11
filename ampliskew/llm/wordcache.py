"""Bounded cache from a chunk of text to its token ids, kept by a Python worker across tasks."""

from __future__ import annotations

from itertools import chain

import numpy as np


class ChunkCache(dict):
    """Chunk to its place in one flat array of ids; a chunk seen for the first time gets the next place.

    ``encode(chunks)`` returns the ids of each chunk. With over ``limit`` chunks the cache starts anew. Only speed
    depends on it.
    """

    def __init__(self, encode, limit: int = 1_000_000):
        super().__init__()
        self.encode, self.limit = encode, limit
        self._reset()

    def _reset(self):
        self.clear()
        self.new: list[str] = []
        self.flat, self.start = np.zeros(1 << 16, "i4"), np.zeros(1 << 16, "i8")

    def __missing__(self, chunk: str) -> int:
        place = self[chunk] = len(self)
        self.new.append(chunk)
        return place

    def ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and for each text where its own end."""
        if len(self) > self.limit:
            self._reset()
        known = len(self)
        sizes = np.fromiter(map(len, texts), "i8", len(texts))
        places = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), "i4", int(sizes.sum()))
        if self.new:
            self._append(known, self.encode(self.new))
            self.new = []
        length = self.start[places + 1] - self.start[places]
        ends = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat(self.start[places] - ends[:-1], length)
        at += np.arange(len(at))
        return self.flat[at], ends[np.cumsum(sizes)]

    def _append(self, known: int, got: list[list[int]]):
        n = np.fromiter(map(len, got), "i8", len(got))
        first = int(self.start[known])
        self.start = roomy(self.start, known + len(n) + 1)
        self.start[known + 1:known + 1 + len(n)] = first + np.cumsum(n)
        last = first + int(n.sum())
        self.flat = roomy(self.flat, last)
        self.flat[first:last] = np.fromiter(chain.from_iterable(got), "i4", last - first)


def roomy(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[:len(a)] = a
    return out


def encoded(cache: ChunkCache, keys: list[list[str] | None], odd: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array and their ends; ``odd`` has the ids of the texts whose keys are None."""
    flat, ends = cache.ids([k or [] for k in keys])
    if not odd:
        return flat, ends
    out, n, rest = [], [], iter(odd)
    for k, a, b in zip(keys, np.concatenate([[0], ends[:-1]]), ends):
        own = flat[a:b] if k is not None else np.asarray(next(rest), "i4")
        out.append(own)
        n.append(len(own))
    return np.concatenate(out), np.cumsum(n)
