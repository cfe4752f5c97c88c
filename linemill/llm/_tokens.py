"""Vectorised hashing of texts: bytes, words or lines of a whole Arrow column at once, in bounded memory.

Texts stay UTF-8 bytes. A word is a maximal run of bytes of a class, which is exact for classes that hold all or
none of the bytes from 0x80 on. Hashes are polynomials modulo 2^64 over random byte values, finished by a mixer, the
same for equal words on every machine.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_ALL = (1 << 64) - 1
#: Bytes of text that are hashed at once.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_VALUES = mix((np.arange(1, 257, dtype=U)) * U(0xD1342543DE82EF95))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for first, last in spans:
        out[first : last + 1] = True
    return out


#: After lower-casing A-Z: digits, letters and everything beyond ASCII.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: All but the space and the control characters 9 to 13.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
NOT_NEWLINE = ~byte_class((0x0A, 0x0A))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, base, U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i, i < n."""
    a, b = _powers(1 << max(21, (n - 1).bit_length()))
    return a[:n], b[:n]


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes, and where each text begins (one more entry: where the last ends); nulls are empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], column.type)
    a = a.cast(pa.large_string()) if not pa.types.is_large_string(a.type) else a
    a = a.fill_null("") if a.null_count else a
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def trim(function: Callable) -> Callable:
    """A function after which freed memory goes back to the system: workers live on between tasks, and what a chunk took
    would stay with them."""

    @functools.wraps(function)
    def run(*args):
        try:
            return function(*args)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return run


class Words:
    """``start``, ``end`` (bytes), ``hash`` of each word of all texts; ``of_text``: index of each text's first word."""

    def __init__(self, data: np.ndarray, at: np.ndarray, member: np.ndarray, lower: bool = True):
        starts, ends, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], len(data)
        for lo in range(0, n, BLOCK):
            hi = min(lo + BLOCK, n)
            cut = np.zeros(hi - lo + 1, bool)
            cut[at[np.searchsorted(at, lo) : np.searchsorted(at, hi, side="right")] - lo] = True
            around = np.zeros(hi - lo + 2, bool)  # from the byte before to the byte behind
            from_, to = max(lo - 1, 0), min(hi + 1, n)
            around[from_ - lo + 1 : to - lo + 1] = member[data[from_:to]]
            starts.append(np.flatnonzero(around[1:-1] & (cut[:-1] | ~around[:-2])) + lo)
            ends.append(np.flatnonzero(around[1:-1] & (cut[1:] | ~around[2:])) + lo + 1)
        self.start, self.end = np.concatenate(starts), np.concatenate(ends)
        self.of_text = np.searchsorted(self.start, at)
        self.hash = np.empty(len(self.start), U)
        i = 0
        while i < len(self.start):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + BLOCK, side="right")))
            lo, hi = int(self.start[i]), int(self.end[j - 1])
            up, down = powers(hi - lo + 1)
            block = data[lo:hi]
            sums = np.zeros(hi - lo + 1, U)
            np.cumsum(BYTE_VALUES[LOWER[block] if lower else block] * up[:-1], out=sums[1:])
            s, e = self.start[i:j] - lo, self.end[i:j] - lo
            self.hash[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U))
            i = j

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.of_text) - 1), np.diff(self.of_text))

    def last(self) -> np.ndarray:
        """For each word the index behind its text's last word."""
        return np.repeat(self.of_text[1:], np.diff(self.of_text))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, U)
    c = 1
    for j in range(k):
        c = c * 0xD6E8FEB86659FD93 & _ALL
        out += hashes[j : j + n] * U(c)
    return mix(out)


def window_minimum(values: np.ndarray, w: int) -> np.ndarray:
    """For each w consecutive values the index of the least, of equal ones the last."""
    n = len(values)
    if n < w:
        return np.zeros(0, np.int32)
    best, arg, size = values, np.arange(n, dtype=np.int32), 1
    while size < w:
        d = min(size, w - size)
        right = best[d:] <= best[:-d]
        best, arg = np.where(right, best[d:], best[:-d]), np.where(right, arg[d:], arg[:-d])
        size += d
    return arg


def slices(batch: pa.RecordBatch | pa.Table, column: str, limit: int = 4 << 20):
    """A batch's rows in order, cut where more than ``limit`` bytes of text would come together."""
    col = batch[column]
    sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0)
    total = np.cumsum(np.asarray(sizes.combine_chunks() if isinstance(sizes, pa.ChunkedArray) else sizes))
    lo = 0
    while lo < batch.num_rows:
        before = int(total[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
