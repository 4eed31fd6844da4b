"""Texts of an Arrow batch as one array of bytes, and words and hashes over it without a loop per word.

All functions are pure and vectorised; Spark decides which rows a task sees. A slice holds at most
:data:`SLICE_BYTES` of text, or one longer text, so memory is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

# The word class of the contracts, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z, as bytes of
# UTF-8: digits, a-z and every byte above 0x7F. Other bytes are 0.
LOWER = np.zeros(256, np.uint8)
LOWER[0x30:0x3A] = np.arange(0x30, 0x3A)
LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
LOWER[0x80:] = np.arange(0x80, 0x100)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges (from, to) with at most ``limit`` bytes each, or a single longer row."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield start, stop
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _powers(base: int, count: int) -> np.ndarray:
    known = _POWERS[base]
    while len(known) < count:
        factor = np.uint64(pow(base, len(known), 1 << 64))
        known = np.concatenate([known, known * factor])
    _POWERS[base] = known
    return known[:count]


class Spans:
    """Hashes of any byte ranges of ``data`` in constant time each."""

    def __init__(self, data: np.ndarray):
        values = mix(data.astype(np.uint64) + np.uint64(0x51_7CC1))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values * _powers(_BASE, len(data)), out=self.sums[1:])
        self.undo = _powers(_INVERSE, len(data) + 1)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.undo[starts] + (ends - starts).astype(np.uint64))


class Words(NamedTuple):
    data: np.ndarray  # bytes in lower case, 0 between words
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray  # the row each word belongs to
    first: np.ndarray  # per row the index of its first word, and one more
    hashes: np.ndarray

    def text(self, start: int, stop: int) -> str:
        """Words ``start`` to ``stop`` joined by blanks."""
        return " ".join(
            self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace") for i in range(start, stop)
        )


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of all rows, in order; no word crosses rows."""
    low = LOWER[data]
    inside = low != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(low, starts, ends, row, first, Spans(low).hash(starts, ends))


def grams(hashes: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words within a row, and the index of the first word of each."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(count, np.uint64)
    for i in range(size):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + count]
    at = np.flatnonzero(row[:count] == row[size - 1 :])
    return mix(total[at] + np.uint64(size)), at


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of ``width`` consecutive values, two passes whatever the width."""
    count = len(values) - width + 1
    if count <= 0:
        return np.zeros(0, values.dtype)
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
