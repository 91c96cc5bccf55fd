"""Words and pieces of whole Arrow string columns by byte classes, for operators whose separators or case differ from vec.Tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from sieveline.llm.vec import _LOWER, _P, Tokens, U, mix

#: Byte classes: part of a word, between words, between pieces (and so between words too).
WORD, GAP, BREAK = 0, 1, 2


def classes(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[list(gaps)] = GAP
    kind[list(breaks)] = BREAK
    return kind


class Words(Tokens):
    """Words of consecutive rows under a table of byte classes. `linked` tells of each word whether the one before it is in the same piece of the same row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, fold: bool = True):
        d = data[offsets[0] : offsets[-1]]
        off = offsets - offsets[0]
        self.data, n = _LOWER[d] if fold else d, len(d)
        k = kind[d]
        solid = k == WORD
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        self.start = np.flatnonzero(solid & (~before | edge[:n]))
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(off) - 1), self.count)
        breaks = np.cumsum(k == BREAK, dtype=np.int64)[self.start]
        self.linked = np.zeros(len(self.start), bool)
        self.linked[1:] = (breaks[1:] == breaks[:-1]) & (self.doc[1:] == self.doc[:-1])

    def runs(self, k: int) -> np.ndarray:
        """Of each word, whether it and the k - 1 after it are in one piece."""
        ok = np.ones(len(self.start), bool)
        for j in range(1, k):
            stop = max(0, len(ok) - j)
            ok[stop:] = False
            ok[:stop] &= self.linked[j:]
        return ok

    def joined(self, at: np.ndarray, k: int) -> pa.Array:
        """The k words from each place on, with one blank between, as strings."""
        data = np.append(self.data, np.uint8(32))
        begin, size = np.full((len(at), 2 * k - 1), len(data) - 1), np.ones((len(at), 2 * k - 1), np.int64)
        for j in range(k):
            begin[:, 2 * j], size[:, 2 * j] = self.start[at + j], self.end[at + j] - self.start[at + j]
        begin, size = begin.ravel(), size.ravel()
        ends = np.cumsum(size)
        flat = data[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.append(0, ends[2 * k - 2 :: 2 * k - 1]).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(flat))


def gram_keys(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """64-bit keys of the k words from each place on."""
    x = h[at].copy()
    for j in range(1, k):
        x = x * _P + h[at + j]
    return mix(x + U(k))
