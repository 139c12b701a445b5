"""Vectorised access to the UTF-8 bytes of Arrow text columns.

Python stages of this subpackage never turn a text into a ``str`` when bytes
suffice: they look at the Arrow buffer, find words with a 256-entry table and
hash all words of a block with one prefix sum. Nulls read as empty texts, and
a text of any length is hashed in slabs, so memory is bounded by the text
itself plus a constant.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once (a longer text is a block of its own).
BLOCK_BYTES = 4 << 20

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(_U)
_BASE = int(_rng.integers(1, 2**62)) | 1
_MASK = (1 << 64) - 1
_SLAB = 1 << 20


def give_back() -> None:
    """Returns freed memory to the system: workers are used again by later stages, and what they hold counts against their executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def gives_back(run: Callable) -> Callable:
    """A stage on batches that gives its memory back when its task ends."""

    @wraps(run)
    def inner(*arguments, **options):
        try:
            yield from run(*arguments, **options)
        finally:
            give_back()

    return inner


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW: np.ndarray | None = None
_INV: np.ndarray | None = None


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if _POW is None or len(_POW) < n:
        size = max(n, _SLAB + 4096)
        _POW, _INV = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _POW, _INV


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on unsigned 64-bit arrays."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: ASCII white space separates words; every other byte belongs to one.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Letters, digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Byte values after lower-casing A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_TABLE_PLAIN = _BYTE.copy()
_TABLE_LOWER = _BYTE[LOWER]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of maximal runs of word bytes inside each row, and each row's first word number."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    mask = word[data]
    brk = np.zeros(n + 1, dtype=bool)
    brk[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    np.logical_not(mask[:-1], out=before[1:])
    starts = np.flatnonzero(mask & (before | brk[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = True
    np.logical_not(mask[1:], out=after[:-1])
    ends = np.flatnonzero(mask & (after | brk[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans must be in order and not overlap."""
    out = np.empty(len(starts), dtype=_U)
    table = _TABLE_LOWER if lower else _TABLE_PLAIN
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + _SLAB, "right")))
        hi = int(ends[j - 1])
        power, inverse = _tables(hi - lo + 1)
        total = np.zeros(hi - lo + 1, dtype=_U)
        np.cumsum(table[data[lo:hi]] * power[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * inverse[s] + (e - s).astype(_U) * _U(0x9E3779B97F4A7C15)
        i = j
    return mix64(out)


class Rolling:
    """Rolling hashes of runs of entries: one prefix sum of entries times powers gives the hash of any run of at most ``most``.

    Prefix sums are made in slabs that overlap by ``most``, so tables of powers stay of bounded size.
    """

    def __init__(self, hashes: np.ndarray, most: int):
        self.n, self.most = len(hashes), most
        self.slab = max(_SLAB, most)
        self.sums = []
        for lo in range(0, max(1, self.n), self.slab):
            part = hashes[lo : lo + self.slab + most]
            total = np.zeros(len(part) + 1, dtype=_U)
            np.cumsum(part * _tables(len(part) + 1)[0][: len(part)], out=total[1:])
            self.sums.append(total)

    def windows(self, k: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hash of each run of k entries, or of those that start ``at`` (ascending); row borders are the caller's business."""
        m = self.n - k + 1
        if m <= 0 or (at is not None and not len(at)):
            return np.zeros(0, dtype=_U)
        out = np.empty(m if at is None else len(at), dtype=_U)
        for number, total in enumerate(self.sums):
            lo = number * self.slab
            if at is None:
                own, i, j = np.arange(max(0, min(self.slab, m - lo))), lo, min(lo + self.slab, m)
            else:
                i, j = np.searchsorted(at, [lo, lo + self.slab])
                own = at[i:j] - lo
            if j > i:
                out[i:j] = (total[own + k] - total[own]) * _tables(len(total))[1][own]
        return mix64(out ^ _U(k * 0xD6E8FEB86659FD93 & _MASK))


def windows(hashes: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of each run of k consecutive entries, or of those that start ``at``, ascending."""
    return Rolling(hashes, k).windows(k, at)


def code_points(data: np.ndarray) -> np.ndarray:
    """Running count of code points: entry i is the number that start before byte i."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
