"""Hashed word shingles of Arrow text columns, computed with numpy over whole byte buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_BYTE[65:91] = _BYTE[97:123]  # A-Z read as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_SOLID = np.where(_SPACE, np.uint64(0), _BYTE)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes of text; a longer text is a range of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, and for each row the number of words before it (with an end)."""
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    low, high = int(ends[0]), int(ends[-1])
    raw = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
    ends = ends - low
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = ends[:-1][ends[:-1] < len(raw)]
    first[inner] = solid[inner]  # a row's first byte starts a word whatever stands before it
    starts = np.flatnonzero(first)
    before = np.searchsorted(starts, ends)
    if not len(starts):
        return np.zeros(0, np.uint64), before
    raw, starts = raw[starts[0] :], starts - starts[0]
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(starts, append=len(raw)))
    powers = np.ones(int(place.max()) + 1, np.uint64)
    powers[1:] = _BASE
    powers = np.multiply.accumulate(powers)
    value = _SOLID[raw] * powers[place]
    return mix(np.add.reduceat(value, starts)), before


_STEP = (np.arange(1, 4097, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def sequences(words: np.ndarray, before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the `size` words from each word on, and which of them stay inside their row."""
    if len(words) < size:
        return np.zeros(len(words), np.uint64), np.zeros(len(words), bool)
    total = np.zeros(len(words), np.uint64)
    n = len(words) - size + 1
    for k in range(size):
        total[:n] += words[k : k + n] * _STEP[k]
    row_end = np.repeat(before[1:], np.diff(before))
    return mix(total), np.arange(len(words)) + size <= row_end


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; one for a shorter text, none for one without words."""
    for lo, hi in slices(column):
        words, before = word_hashes(column.slice(lo, hi - lo))
        made, _ = sequences(words, before, size)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(made[a : b - size + 1])
            elif b > a:
                terms = np.append(words[a:b] * _STEP[: b - a], _STEP[40 + b - a])
                yield mix(np.sum(terms, dtype=np.uint64, keepdims=True))
            else:
                yield np.zeros(0, np.uint64)
