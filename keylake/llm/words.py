"""Words of whole texts as numpy arrays, one Arrow batch at a time.

A word is a maximal run of 0-9, A-Z (lower-cased), a-z and bytes above 0x7F of the UTF-8 text. Texts are worked on in
segments of about a megabyte, so memory follows the number of words of a batch and not the length of its longest text.
A word's hash is a polynomial over its bytes, from differences of one running sum; it is the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Byte -> lower-cased word byte, 0 for separators.
WORD_BYTE = np.zeros(256, np.uint8)
for _b in range(256):
    if 48 <= _b <= 57 or 97 <= _b <= 122 or _b >= 128:
        WORD_BYTE[_b] = _b
    elif 65 <= _b <= 90:
        WORD_BYTE[_b] = _b + 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SEGMENT, 1 << (n - 1).bit_length()) + 1
    if size not in _powers:
        up, down = np.full(size, _BASE, U), np.full(size, _INVERSE, U)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits; one to one."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(29))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


@dataclass
class Words:
    """Words of a batch: hash, row, and byte range in data; rows counts all rows, empty and null ones too."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    rows: int
    data: np.ndarray
    prefixes: np.ndarray | None = None  # hashes of the words' first bytes, if asked for; 0 where the word is not longer

    def per_row(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def text(self, first: int, last: int) -> list[bytes]:
        """The lower-cased words first to last - 1."""
        return [WORD_BYTE[self.data[s:e]].tobytes() for s, e in zip(self.start[first:last], self.end[first:last], strict=True)]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most, as word arrays are larger than their texts."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def words(column: pa.Array | pa.ChunkedArray, prefixes: tuple[int, ...] = ()) -> Words:
    """Words of a column; also hashes of their prefixes of these lengths in bytes."""
    offsets, data = raw(column)
    parts, at, end = [], int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(at + SEGMENT, end)
        while stop < end and stop > at and WORD_BYTE[data[stop - 1]] and WORD_BYTE[data[stop]]:
            stop -= 1
        if stop == at:  # one word longer than a segment
            stop = at + SEGMENT
            while stop < end and len(gap := np.flatnonzero(WORD_BYTE[data[stop : stop + SEGMENT]] == 0)) == 0:
                stop = min(stop + SEGMENT, end)
            stop = stop + int(gap[0]) if stop < end else end
        parts.append(_segment(offsets, data, at, stop, prefixes))
        at = stop
    if not parts:
        none = np.zeros(0, np.int64)
        return Words(none.view(U), none, none, none, len(offsets) - 1, data, np.zeros((0, len(prefixes)), U))
    value, row, start, end, prefix = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Words(value, row, start, end, len(offsets) - 1, data, prefix)


def _segment(offsets: np.ndarray, data: np.ndarray, at: int, stop: int, prefixes: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    byte = WORD_BYTE[data[at:stop]]
    inside = byte != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    lo, hi = np.searchsorted(offsets, [at, stop])
    cut = offsets[lo:hi] - at  # texts that begin in this segment
    first[cut] = inside[cut]
    cut = cut[cut > 0] - 1
    last[cut] = inside[cut]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power_tables(len(byte))
    running = np.cumsum(byte.astype(U) * up[: len(byte)], dtype=U)
    before = np.where(start > 0, running[start - 1], U(0))
    prefix = np.zeros((len(start), len(prefixes)), U)
    for k, size in enumerate(prefixes):
        longer = np.flatnonzero(end - start > size)
        prefix[longer, k] = mix((running[start[longer] + size - 1] - before[longer]) * down[start[longer]] + U(1_000_003 * size))
    value = running[end - 1] - before
    value = mix(value * down[start] + (end - start).astype(U))
    row = np.searchsorted(offsets, start + at, side="right") - 1
    return value, row, start + at, end + at, prefix


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its first word) of every run of size consecutive words of one row."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = w.hash[:n].copy()
    for k in range(1, size):
        h = h * U(0xD6E8FEB86659FD93) + w.hash[k : k + n]
        h ^= h >> U(32)
    at = np.flatnonzero(w.row[:n] == w.row[size - 1 :])
    return mix(h[at] + U(size)), at


def word_hashes(terms: list[str]) -> np.ndarray:
    """Hashes of single words, by the same rule."""
    w = words(pa.array(terms, pa.string()))
    keep = np.flatnonzero(w.per_row() == 1)
    return w.hash[np.isin(w.row, keep)]


def member(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is it there, place) of values in an ordered array."""
    if not len(ordered):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    place = np.searchsorted(ordered, values)
    place[place == len(ordered)] = 0
    return ordered[place] == values, place


def unsigned_to_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
