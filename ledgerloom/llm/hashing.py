"""Vectorised word and n-gram hashing over Arrow string columns.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; as these six bytes never occur
inside a multi-byte UTF-8 sequence, words can be found on bytes. Everything here works on whole
texts; a text is never cut, long ones are only hashed in pieces that end at word boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_GRAM = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
_BYTE = np.random.Generator(np.random.PCG64(977)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes hashed in one numpy pass, which bounds the memory of the temporary arrays.
CHUNK_BYTES = 1 << 19


@lru_cache(maxsize=16)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < 2**bits."""
    n = 1 << bits
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = _powers(base, max(12, int(n).bit_length()))
    return p[:n], q[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (murmur3's)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, without copying; a null is an empty text."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column = column.cast(pa.string()) if not pa.types.is_string(column.type) else column
        kind = np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        length = np.where(np.asarray(column.is_valid()), np.diff(off), 0)
        if (length != np.diff(off)).any():  # a null slot may hold bytes
            keep = np.asarray(column.is_valid())
            raw = np.concatenate([raw[a:b] for a, b, k in zip(off[:-1], off[1:], keep) if k] or [raw[:0]])
            off = np.concatenate([[0], np.cumsum(length)])
    return raw[off[0] : off[-1]], off - off[0]


class Words:
    """Words of a run of texts: byte spans in ``data``, hashes, and ``bounds[i]:bounds[i+1]`` of text i."""

    __slots__ = ("bounds", "data", "ends", "hashes", "offsets", "starts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None):
        """cuts: further places at which words end."""
        self.data, self.offsets = data, offsets
        n = len(data)
        if n == 0:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.hashes = np.zeros(0, np.uint64)
            self.bounds = np.zeros(len(offsets), np.int64)
            return
        solid = ~_SPACE[data]
        first = np.empty(n + 1, dtype=bool)  # a text begins here
        first[:] = False
        first[offsets] = True
        if cuts is not None:
            first[cuts] = True
        before = np.empty(n, dtype=bool)
        before[0] = False
        before[1:] = solid[:-1]
        self.starts = np.flatnonzero(solid & (~before | first[:-1]))
        after = np.empty(n, dtype=bool)
        after[-1] = False
        after[:-1] = solid[1:]
        self.ends = np.flatnonzero(solid & (~after | first[1:])) + 1
        self.hashes = self._hash()
        self.bounds = np.searchsorted(self.starts, offsets)

    def _hash(self) -> np.ndarray:
        out, starts, ends = np.empty(len(self.starts), np.uint64), self.starts, self.ends
        at = 0
        while at < len(starts):
            lo = int(starts[at])
            to = max(at + 1, int(np.searchsorted(ends, lo + CHUNK_BYTES, "right")))
            hi = int(ends[to - 1])
            p, q = powers(_BASE, hi - lo)
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_BYTE[self.data[lo:hi]] * p, out=total[1:])
            s, e = starts[at:to] - lo, ends[at:to] - lo
            out[at:to] = mix((total[e] - total[s]) * q[s])
            at = to
        return out

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def grams(hashes: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` words; position i covers words i to i+size-1."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    p, q = powers(_GRAM[which], n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * p, out=total[1:])
    return mix((total[size:] - total[: n - size + 1]) * q[: n - size + 1])


def pieces(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, one past the last, bytes, offsets) for runs of whole texts of about ``limit`` bytes."""
    data, offsets = text_buffers(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def runs(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """The same with Words."""
    for lo, hi, data, offsets in pieces(column, limit):
        yield lo, hi, Words(data, offsets)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest value in each window of ``width`` (the leftmost of equal ones)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    index, covered = np.arange(len(values)), 1  # doubling: window of 2**j from two of 2**(j-1)
    while covered * 2 <= width:
        a, b = index[: len(index) - covered], index[covered:]
        index = np.where(values[b] < values[a], b, a)
        covered *= 2
    a, b = index[:n], index[width - covered : width - covered + n]
    return np.where(values[b] < values[a], b, a)
