"""Words and word hashes of many texts at once, by NumPy over an Arrow column's bytes.

A word is a maximal run of bytes other than space and 0x09-0x0D, which in UTF-8 are the code points
outside ``[\\x20\\x09-\\x0D]``. Hashes are 64-bit: a polynomial over the word's bytes, taken from prefix
sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 18
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_SHINGLE = 0xD1342543DE82EF95


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: shifts and odd multipliers spread every input bit."""
    x = x ^ U(seed)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_BYTE = mix(np.arange(1, 257, dtype=U), 0x51)
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        base = _BASE if which == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(n, SLICE_BYTES + 1), base, U)
        steps[0] = 1
        _powers[which] = np.cumprod(steps)
    return _powers[which][:n]


@dataclass
class Slice:
    """Some consecutive rows of a batch: their bytes, and where each row's text begins in them (one more at the end)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Of a slice: each word's byte range, and for each row the index of its first word (one more at the end)."""

    start: np.ndarray
    end: np.ndarray
    rows: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column's rows in order, about limit bytes at a time, a longer text alone. Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, len(column))
        yield Slice(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def words(s: Slice, solid: np.ndarray | None = None) -> Words:
    """The maximal runs of bytes where solid holds (those other than space, if None), each within its row."""
    solid = ~IS_SPACE[s.data] if solid is None else solid
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = s.offsets[(s.offsets > 0) & (s.offsets < len(s.data))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, np.searchsorted(start, s.offsets))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """For range_hash: sums[e] - sums[s] is the polynomial of data[s:e] times the base to the power s."""
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * _power("up", len(data)), out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for each range, the same wherever the bytes stand."""
    down = _power("down", len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(_SHINGLE))


def word_hashes(s: Slice, w: Words) -> np.ndarray:
    return range_hash(prefix_sums(s.data), w.start, w.end)


def shingles(h: np.ndarray, rows: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows inside the rows, and for each row the index of its first (one more at the end).

    A row of fewer than k words, but at least one, has one shingle: all its words.
    """
    n = np.diff(rows)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    first = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    at = rows[:-1][row] + np.arange(first[-1]) - first[:-1][row]
    width = np.minimum(n, k)[row]
    total = np.zeros(len(at), U)
    padded = np.concatenate([h, np.zeros(k, U)])
    for i in range(k):
        total = total * U(_SHINGLE) + np.where(i < width, padded[at + i], U(0))
    return mix(total, 0x5A), first


def min_per_row(values: np.ndarray, first: np.ndarray, empty: int) -> np.ndarray:
    """The least of each row's values; empty where a row has none."""
    out = np.full(len(first) - 1, empty, values.dtype)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.minimum.reduceat(values, first[:-1][full])
    return out


def mix_light(x: np.ndarray) -> np.ndarray:
    """Enough for the order of already mixed values times an odd factor: one shift lets low bits weigh in too."""
    return x ^ (x >> U(29))
