"""Vectorised helpers over Arrow string buffers: word boundaries, word hashes, shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text worked on at once.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs give equal outputs on every executor."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Hash of a byte after A-Z is lower-cased; white space counts nothing.
WORD_BYTE = np.where(SPACE, U(0), BYTE[LOWER])
STEP = U(0xD1342543DE82EF95)


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[U(1)], np.full(max(n - 1, 0), STEP)]), dtype=np.uint64)


def as_strings(column) -> pa.Array:
    """One array with nulls made empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return pc.fill_null(column, "").cast(pa.large_string())


def slices(strings: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) of consecutive runs of at most so many bytes, one row at least."""
    n = len(strings)
    if not n:
        return
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + n + 1]
    data = np.frombuffer(strings.buffers()[2], np.uint8) if strings.buffers()[2] is not None and strings.buffers()[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of every word; words never cross rows."""
    inside = ~SPACE[data]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    before[cut], after[cut - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words with A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else np.arange(len(data)) - np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(data))))])
    sums = np.add.reduceat(WORD_BYTE[data] * powers(int(place.max()) + 1)[place], starts)
    return mix(sums + (ends - starts).astype(np.uint64))


def shingle_sets(strings: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each row, the sorted distinct hashes of its shingles of so many words; with fewer words, of the whole sequence."""
    for first, end, data, offsets in slices(strings):
        starts, ends, row = words(data, offsets)
        hashes = word_hashes(data, starts, ends)
        rolled = mix(hashes + U(size))
        for k in range(1, size):
            rolled = mix(rolled[: len(hashes) - k] * STEP + hashes[k:]) if len(hashes) > k else rolled[:0]
        bounds = np.searchsorted(row, np.arange(end - first + 1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(rolled[a : b - size + 1])
            elif b > a:
                whole = U(b - a)
                with np.errstate(over="ignore"):
                    for h in hashes[a:b]:
                        whole = mix(np.array([whole * STEP + h], np.uint64))[0]
                yield np.array([whole], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
