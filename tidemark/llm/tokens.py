"""Array helpers over Arrow string columns: word bounds and 64-bit word and window hashes.

Words are the maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``; in UTF-8 those bytes never
occur inside another character, so byte bounds and character bounds agree. Every function works on
one slice of an Arrow batch, whose size ``slices`` bounds, so memory does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, 1 << 10, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_Q = 0x9E3779B97F4A7C15 | 1
_Q_INV = pow(_Q, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that low and high bits both depend on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``most`` bytes; one longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the offset of each row (null: empty)."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the index of its first word (one more at the end)."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def places(n: int) -> np.ndarray:
    """Odd multipliers for places 0 .. n-1 of a word; those beyond the table come from the same mixer."""
    if n <= len(_PLACE):
        return _PLACE
    return np.concatenate([_PLACE, mix(np.arange(len(_PLACE), n, dtype=np.uint64)) | np.uint64(1)])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes (multilinear over a byte table, then mixed)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    where = np.zeros(len(data), np.int64)
    where[starts] = starts
    where = np.arange(len(data)) - np.maximum.accumulate(where)
    terms = _BYTE[data]
    terms *= places(int(sizes.max()) + 1)[np.minimum(where, sizes.max())]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    return mix(total[ends] - total[starts] + sizes.astype(np.uint64))


_powers = {_Q: np.ones(1, np.uint64), _Q_INV: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


class Rolling:
    """Hashes of word spans in constant time each, from prefix sums of ``word hash * Q**place``."""

    def __init__(self, words: np.ndarray):
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(_Q, len(words)), dtype=np.uint64)])
        self.undo = powers(_Q_INV, len(words) + 1)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One hash for each half-open span of words; equal word sequences give equal hashes anywhere."""
        return mix((self.total[end] - self.total[start]) * self.undo[start] + (end - start).astype(np.uint64))
