"""k-mers of Arrow batches as packed numbers: two bits a base, rolled along all sequences of a batch at once."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Longest word that is packed; 4^8 counters of a word length take 512 KiB.
MAX_K = 8
SKIP, OTHER = 4, 5  # N, and letters that aren't packed
_CODE = np.full(256, OTHER, "u1")
_CODE[[ord(x) for x in "ACGTN"]] = range(5)


@lru_cache(MAX_K)
def spelled(k: int) -> pa.Array:
    """All words of length k in the order of their numbers."""
    out = [""]
    for _ in range(k):
        out = [w + x for w in out for x in "ACGT"]
    return pa.array(out)


class Rolled:
    """Windows of all sequences of a batch: ``windows(k, scope)`` gives (sequence number, packed word), rare letters apart."""

    def __init__(self, sequences: pa.Array, w: int = 30):
        sequences = sequences.cast(pa.binary())
        size = pc.fill_null(pc.binary_length(sequences), 0).to_numpy().astype("i8")
        offsets = np.frombuffer(sequences.buffers()[1], "i4")[sequences.offset:sequences.offset + len(sequences) + 1]
        data = np.frombuffer(sequences.buffers()[2] or b"", "u1")[offsets[0]:offsets[-1]] if len(sequences) else np.zeros(0, "u1")
        if len(data) != size.sum():  # nulls that hold bytes
            data = np.frombuffer(b"".join(x for x in sequences.to_pylist() if x), "u1")
        self.data, self.w = data, w
        self.owner = np.repeat(np.arange(len(size)), size)
        self.start = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
        self.size = size[self.owner]
        letters = _CODE[data]
        self.skips, self.others = (np.append(0, np.cumsum(letters == x)) for x in (SKIP, OTHER))
        self.code, self.k, self.letters = np.zeros(len(data), "i4"), 0, (letters & 3).astype("i4")

    def _roll(self, k: int) -> np.ndarray:
        """Numbers of the words of length k at every position; words past the end are cut off later."""
        if k < self.k:
            self.code, self.k = np.zeros(len(self.data), "i4"), 0
        while self.k < k:
            n = len(self.data) - self.k
            self.code = (self.code[:max(n, 0)] << 2) | self.letters[self.k:]
            self.k += 1
        return self.code

    def windows(self, k: int, scope: str):
        """(sequence numbers, words, positions of windows with letters that can't be packed); words with N are left out."""
        code = self._roll(k)
        n = len(code)
        inside = self.start[:n] + k <= self.size[:n]
        if scope == "head":
            inside &= self.start[:n] + k <= self.w
        elif scope == "tail":
            inside &= self.start[:n] >= self.size[:n] - self.w
        inside &= self.skips[k:k + n] == self.skips[:n]
        packed = inside & (self.others[k:k + n] == self.others[:n])
        return self.owner[:n][packed], code[packed], np.flatnonzero(inside & ~packed)

    def counted(self, k: int, scope: str):
        """(sequence numbers, words, counts) of packed words and a Counter of (sequence number, text) of the others."""
        owner, code, odd = self.windows(k, scope)
        keys, n = np.unique(owner * 4**k + code, return_counts=True)
        texts = Counter((int(self.owner[i]), self.data[i:i + k].tobytes().decode("latin-1")) for i in odd.tolist())
        return keys >> 2 * k, keys & (4**k - 1), n, texts
