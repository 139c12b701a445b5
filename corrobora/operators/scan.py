"""Many quotes looked for in the bytes of many texts at once.

In UTF-8 a quote's bytes stand in a text's bytes only where its characters do.
Each quote has an anchor, eight of its bytes (all of a shorter one) read as one
number: the one that the fewest quotes share. A block of texts reads the number
at each of its bytes, asks whether an anchor begins with its first three bytes,
and looks it up; where an anchor stands, the whole quote is compared, eight
bytes at a time. Cost grows with the texts' bytes and the places of anchors;
memory is bounded by a batch of texts and the quotes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast

_U = np.uint64
_MIX, _WIDE, _NEAR = _U(0x9E3779B97F4A7C15), 8, 3
#: Bytes looked up, places compared and rows taken at a time.
SLAB, PLACES, ROWS = 1 << 16, 1 << 18, 256


def _padded(raw: np.ndarray) -> np.ndarray:
    return np.concatenate([raw, np.zeros(_WIDE, np.uint8)])


def _numbers(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; a view."""
    return np.ndarray((len(padded) - _WIDE,), "<u8", padded, strides=(1,))


def _first(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


class _Table:
    """Which hashes numbers of k bytes have; others are told at once."""

    def __init__(self, numbers: np.ndarray, k: int):
        bits = min(24, max(16, len(numbers).bit_length() + 4))
        self.mask, self.shift, self.known = _U((1 << 8 * k) - 1), _U(64 - bits), np.zeros(1 << bits, bool)
        self.known[self._hash(numbers & self.mask)] = True

    def _hash(self, numbers: np.ndarray) -> np.ndarray:
        return (numbers * _MIX) >> self.shift

    def places(self, numbers: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.known[self._hash(numbers & self.mask)])


class Quotes:
    """Quotes in UTF-8, each once and none empty, with their numbers."""

    def __init__(self, quotes: list[bytes], numbers: list[int]):
        self.number, self.size = np.array(numbers, np.int64), np.array([len(q) for q in quotes], np.int64)
        self.start = _first(self.size)
        self.blob = _padded(np.frombuffer(b"".join(quotes), np.uint8))
        own = _numbers(self.blob)
        self.lead = np.zeros(len(quotes), np.int64)  # bytes of a quote before its anchor
        owner = np.repeat(np.arange(len(quotes)), self.size)
        lead = np.arange(len(owner)) - self.start[owner]
        inside = np.flatnonzero(lead <= self.size[owner] - _WIDE)
        if len(inside):
            owner, lead = owner[inside], lead[inside]
            _, inverse, counts = np.unique(own[inside], return_inverse=True, return_counts=True)
            order = np.lexsort((lead, counts[inverse], owner))
            ids, first = np.unique(owner[order], return_index=True)
            self.lead[ids] = lead[order][first]
        wide, value = np.minimum(self.size, _WIDE), own[self.start + self.lead]
        self.anchors = [self._anchors(value, np.flatnonzero(wide == k), int(k)) for k in np.unique(wide)]
        self.near = _Table(value[wide >= _NEAR], _NEAR)

    @staticmethod
    def _anchors(value: np.ndarray, ids: np.ndarray, k: int) -> tuple:
        """For the anchors of k bytes: k, their hashes, anchors in order, where their quotes begin, how many they are, quotes."""
        table = _Table(value[ids], k)
        ids = ids[np.argsort(value[ids] & table.mask, kind="stable")]
        keys, n = np.unique(value[ids] & table.mask, return_counts=True)
        return k, table, keys, _first(n), n, ids

    def _same(self, text: np.ndarray, begin: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which quotes of more than eight bytes stand where they begin; shorter ones do."""
        own, size, start = _numbers(self.blob), self.size[ids], self.start[ids]
        same, left, done = np.ones(len(ids), bool), np.flatnonzero(size > _WIDE), 0
        while len(left):
            at = np.minimum(done, size[left] - _WIDE)
            equal = text[begin[left] + at] == own[start[left] + at]
            same[left[~equal]] = False
            done += _WIDE
            left = left[equal & (size[left] > done)]
        return same

    def found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of texts and numbers of quotes that they contain, each pair once."""
        column = texts.cast(pa.large_string()).fill_null("")
        if not len(column) or column.buffers()[2] is None or not self.anchors:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        border = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        text = _numbers(_padded(np.frombuffer(column.buffers()[2], np.uint8)[border[0] : border[-1]]))
        border, pairs = border - border[0], [np.zeros(0, np.int64)]
        for slab in range(0, len(text), SLAB):
            numbers = np.ascontiguousarray(text[slab : slab + SLAB])
            near = self.near.places(numbers)
            opened = numbers[near]
            for k, table, keys, first, n, ids in self.anchors:
                at = table.places(numbers if k < _NEAR else opened)
                at = at if k < _NEAR else near[at]
                value = numbers[at] & table.mask
                key = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
                hit = keys[key] == value
                at, key = at[hit] + slab, key[hit]
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(n[key]) // PLACES)) + 1):
                    many = n[key[part]]
                    own = ids[np.repeat(first[key[part]] - _first(many), many) + np.arange(many.sum())]
                    begin = np.repeat(at[part], many)
                    row = np.searchsorted(border, begin, "right") - 1
                    begin -= self.lead[own]
                    inside = np.flatnonzero((begin >= border[row]) & (begin + self.size[own] <= border[row + 1]))
                    row, own, begin = row[inside], own[inside], begin[inside]
                    same = self._same(text, begin, own)
                    pairs.append(np.unique(row[same] * len(self.size) + own[same]))
        rows, own = np.divmod(np.unique(np.concatenate(pairs)), len(self.size))
        return rows, self.number[own]


def scan(batches: Iterator[pa.RecordBatch], quotes: Broadcast) -> Iterator[pa.RecordBatch]:
    """(doc_id, number) of batches of doc_id and text."""
    for batch in batches:
        for i in range(0, len(batch), ROWS):
            some = batch.slice(i, ROWS)
            rows, numbers = quotes.value.found(some.column("text"))
            yield pa.RecordBatch.from_arrays([some.column("doc_id").take(pa.array(rows)), pa.array(numbers)], ["doc_id", "number"])
