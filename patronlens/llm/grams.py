"""Words and shingles of Arrow text columns as numpy arrays of 64-bit hashes.

A batch's bytes are taken as they lie in Arrow memory and worked on in pieces of about
``PIECE_BYTES``, so memory stays bounded whatever the batch; one longer text is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True



class _Kept(dict):
    """A cache that travels empty: functions sent to workers do not carry what the driver has computed."""

    def __reduce__(self):
        return _Kept, ()


_powers: dict[int, np.ndarray] = _Kept()


def powers_of(base: int, size: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64; the longest array of each base is kept up to a few pieces' length."""
    held = _powers.get(base)
    if held is not None and len(held) >= size:
        return held
    steps = np.full(max(size, PIECE_BYTES), base, dtype=np.uint64)
    steps[0] = 1
    made = np.multiply.accumulate(steps)
    if size <= 4 * PIECE_BYTES:
        _powers[base] = made
    return made


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def pieces(offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


class Words(NamedTuple):
    """Words of the rows ``first`` to ``last``: byte positions in ``data``, hashes, and each row's word range."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray


def words(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[Words]:
    """Words of a string column: runs without white space (0x20, 0x09-0x0D), A-Z lower-cased."""
    data, offsets = text_bytes(column)
    for first, last in pieces(offsets, size):
        low = LOWER[data[offsets[first]: offsets[last]]]
        borders = offsets[first: last + 1] - offsets[first]
        inside = ~SPACE[low]
        before = np.zeros(len(low), dtype=bool)
        before[1:] = inside[:-1]
        before[borders[:-1][borders[:-1] < len(low)]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(low), dtype=bool)
        after[:-1] = inside[1:]
        after[borders[1:][borders[1:] > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        sums = np.zeros(len(low) + 1, dtype=np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers_of(BASE, len(low) + 1)[: len(low)], out=sums[1:])
        raw = (sums[ends] - sums[starts]) * powers_of(INVERSE, len(low) + 1)[starts]
        hashes = mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        yield Words(first, last, low, starts, ends, hashes, np.searchsorted(starts, borders))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; fewer words are one run; no words, none."""
    if len(hashes) == 0:
        return hashes
    size = min(size, len(hashes))
    count = len(hashes) - size + 1
    total = np.full(count, size, dtype=np.uint64)
    for i in range(size):
        total = mix(total * np.uint64(BASE) + hashes[i: i + count])
    return np.unique(total)
