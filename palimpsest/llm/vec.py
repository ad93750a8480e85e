"""Words of Arrow string columns as NumPy arrays: spans and 64-bit hashes, without a Python object for each word.

A word's hash takes its bytes eight at a time, each step through a bijective mixer; words over LONG bytes are hashed
by xxh3 instead, so that one long word costs no loop.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
LONG = 200
#: Bytes of text that are held as NumPy arrays at once (a longer text is one piece by itself).
PIECE = 2 << 20

SPACES = bytes([0x20, 9, 10, 11, 12, 13])


def lut(separators: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(separators)] = True
    return table


WHITE = lut(SPACES)
NOT_ASCII_LETTER = np.array([c < 0x80 and not chr(c).isalpha() for c in range(256)])
SAME = np.arange(256, dtype=np.uint8)
ASCII_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (the finaliser of splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(1)
def low_bytes() -> np.ndarray:
    """Masks of the lowest 0 to 8 bytes."""
    return np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n; kept up to one piece, made anew beyond it."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        made = []
        for base in (BASE, INVERSE):
            p = np.full(size, base, U64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if size > 4 * PIECE:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


class Words:
    """Words of consecutive texts: ``start``/``end`` are byte positions in ``data``, ``first[i]:first[i + 1]`` are text i's."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, fold: np.ndarray = SAME):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = ~separators[data]
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edges = offsets[1:-1]
            edges = edges[(edges > 0) & (edges < n)]
            begins[edges] = inside[edges]
            ends[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.fold = fold

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.fold[self.data] if self.fold is not SAME else self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each pair: eight bytes at a time, read at any place through an overlapping view."""
    if not len(start):
        return np.zeros(0, U64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    size = end - start
    h = mix((eight[start] & low_bytes()[np.minimum(size, 8)]) + U64(BASE) * size.astype(U64))
    at, done = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(at):
        left = size[at] - done
        h[at] = mix((h[at] * U64(BASE)) ^ (eight[start[at] + done] & low_bytes()[np.minimum(left, 8)]))
        at, done = at[left > 8], done + 8
    for i in np.flatnonzero(size > LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return h


def tidy(run: Callable) -> Callable:
    """run, after which the worker gives freed memory back: workers stay for later tasks, and their peaks would add up."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return tidied


def pieces(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about PIECE bytes; nulls are empty texts."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for chunk in chunks:
        arr = chunk.fill_null("").cast(pa.large_string())
        if not len(arr):
            continue
        _, offs, body = arr.buffers()
        offsets = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + len(arr) + 1]
        data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(arr):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
            yield row + i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j
        row += len(arr)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive hashes (across text borders too: the caller masks those)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for k in range(size):
        out = out * U64(BASE) + hashes[k : k + n]
    return mix(out + U64(size))


def long_windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """As windows(), by prefix sums: its cost doesn't grow with the size."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    return range_hashes(hashes, np.arange(n), np.full(n, size))


def range_hashes(hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of hashes[start:start + size] for each pair."""
    up, down = powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(mix(hashes) * up[: len(hashes)], out=sums[1:])
    return mix((sums[start + size] - sums[start]) * down[start] + size.astype(U64))
