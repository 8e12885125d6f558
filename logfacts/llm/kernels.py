"""Numpy helpers that see an Arrow string column as one byte buffer, a bounded slice at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Lower case for A-Z only; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The separators: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes after one another, and each text's start (with the end of the last). Null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def slices(starts: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most that many bytes each; a longer text is a range of its own."""
    row, rows = 0, len(starts) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + most, side="right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads a change of any bit over all 64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    ones = np.ones(size + 1, dtype=np.uint64)
    up, down = ones.copy(), ones
    up[1:], down[1:] = U64(_BASE), U64(_INVERSE)
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, for at least that many positions."""
    return _powers(max(SLICE_BYTES, 1 << max(size, 1).bit_length()))


def prefix_hash(code: np.ndarray) -> np.ndarray:
    """Running sums from which range_hash gets the hash of any range of the codes (small unsigned integers)."""
    up, _ = powers(len(code))
    total = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum(code.astype(np.uint64) * up[: len(code)], out=total[1:])
    return total


def range_hash(total: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of the codes first..last (last not included); equal ranges have equal hashes wherever they are."""
    _, down = powers(len(total))
    return mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's hash (A-Z lower-cased), first byte and text index; words end at separators and at the end of a text."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    solid = ~SPACE[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    inner = starts[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    opens[inner] |= solid[inner]
    closes[inner - 1] |= solid[inner - 1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    total = prefix_hash(LOWER[data] + np.uint16(1))
    return range_hash(total, first, last), first, np.searchsorted(starts, first, side="right") - 1
