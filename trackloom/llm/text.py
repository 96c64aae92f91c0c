"""Vectorised views of UTF-8 text in Arrow batches: slabs of whole rows, words, and 64-bit hashes of byte ranges.

A slab holds whole texts of about SLAB bytes together (one longer text is a slab by itself), so memory is bounded by
the slab or the longest text, not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLAB = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(salt))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    base = 0x5851F42D4C957F2D
    inverse = pow(base, -1, 1 << 64)

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = self._grow(n, self.base), self._grow(n, self.inverse)
        return self.up, self.down

    @staticmethod
    def _grow(n: int, base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


_POWERS = _Powers()
BYTES = seeds(256, 17)
#: The same for text whose A-Z count as a-z.
LOWER = BYTES.copy()
LOWER[65:91] = BYTES[97:123]
#: White space of the word rule: blank and 09 to 0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Running sums from which range_hash() takes the hash of any range of codes (already 64-bit values)."""
    up, _ = _POWERS.upto(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _POWERS.upto(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and offsets.size else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def slabs(column: pa.Array | pa.ChunkedArray, size: int = SLAB) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, bytes, offsets from 0) of one slab after another; every row is in one of them."""
    if not len(column):
        return
    data, offsets = utf8(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word: a run of bytes that aren't white space, within a row."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    ink = ~SPACE[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = ink[:-1]
    start = np.flatnonzero(ink & (~before | fresh[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = ink[1:]
    end = np.flatnonzero(ink & (~after | fresh[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1
