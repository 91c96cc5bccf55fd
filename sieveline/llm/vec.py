"""Vectorised tokenising and hashing of whole Arrow string columns with numpy.

No Python object is made per token: token bounds come from byte masks and the token hashes from
wrapped prefix sums of a random-table polynomial (64 bits, finalised by a splitmix step). At 2**64
values, a billion distinct tokens collide with a chance of about 3 %."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240501))
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_P = U(0x9E3779B97F4A7C15)
_P_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POW: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        for k, p in enumerate((_P, _P_INV)):
            x = np.full(size, p, U)
            x[0] = 1
            _POW[k] = np.multiply.accumulate(x)
    return _POW[0], _POW[1]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, step: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about step bytes, so that work arrays stay small; one row is never split."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + step, "right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end
        row = end


class Tokens:
    """Tokens of consecutive rows: start, end (in data), doc (row from 0), first (index of each row's first token; one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        base = offsets[0]
        d = _LOWER[data[base : offsets[-1]]]
        off = offsets - base
        self.data, n = d, len(d)
        solid = ~((d == 32) | ((d >= 9) & (d <= 13)))
        edge = np.zeros(n + 1, bool)
        edge[off] = True  # a row starts or ends here
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = solid[:-1], solid[1:]
        self.start = np.flatnonzero(solid & (~before | edge[:n]))
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(off) - 1), self.count)

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, U)
        power, inverse = _powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, U)
        np.cumsum(_TABLE[self.data] * power[: len(self.data)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(U))


def shingles(h: np.ndarray, t: Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each k-token shingle; a row with fewer tokens has its whole sequence as one."""
    n = len(h)
    short = np.flatnonzero((t.count > 0) & (t.count < k))
    full = np.zeros(0, U)
    rows = np.zeros(0, np.int64)
    if n >= k:
        ok = t.doc[: n - k + 1] == t.doc[k - 1 :]
        at = np.flatnonzero(ok)
        full = h[at].copy()
        for j in range(1, k):
            full = full * _P + h[at + j]
        full, rows = mix(full + U(k)), t.doc[at]
    if len(short):
        extra = np.empty(len(short), U)
        with np.errstate(over="ignore"):
            for i, row in enumerate(short):
                x = U(0)
                for v in h[t.first[row] : t.first[row + 1]]:
                    x = x * _P + v
                extra[i] = x + U(int(t.count[row]))
        full, rows = np.concatenate([full, mix(extra)]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        full, rows = full[order], rows[order]
    return full, rows
