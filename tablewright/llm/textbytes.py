"""Texts of an Arrow batch as one byte array, with words and segment hashes found by whole-array steps.

All helpers work on bounded slices (:func:`slices`), so a task's memory does not grow with its partition. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows with at most ``limit`` bytes of text (one row at least).

    Gives the rows, their bytes, and the start of each text in them with the total as last entry.
    """
    texts = batch.column(column).fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


_powers: dict[int, np.ndarray] = {}


def _power(base: int, size: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < size:
        steps = np.full(max(-(-size // 65536), 1) * 65536, base, np.uint64)
        steps[0] = 1
        held = np.multiply.accumulate(steps)
        if len(held) <= 4 * SLICE_BYTES:
            _powers[base] = held
    return held[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (one to one)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial of the bytes; :func:`segment_hash` takes it."""
    sums = np.zeros(len(data) + 1, np.uint64)
    terms = sums[1:]
    np.take(_letters(), data, out=terms, mode="clip")  # in place, as these are the largest arrays of a slice
    terms *= _power(_BASE, len(data))
    np.cumsum(terms, out=terms)
    return sums


def segment_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes from ``start`` to ``end``, the same wherever they stand."""
    return mix((sums[end] - sums[start]) * _power(_INVERSE, len(sums))[start] + (end - start).astype(np.uint64))


@lru_cache(1)
def _word_byte() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return table


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8 bytes."""
    out = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    if len(data) > 1:
        high = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[high] += 32
    return out


def runs(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that stay within a text: first byte, byte after the last, and row."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    edges = starts[:-1][starts[:-1] < len(inside)]
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    before[edges] = False
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    first = np.flatnonzero(inside & ~before)
    return first, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, first, "right") - 1


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters and digits (every byte above ASCII counts as a letter): start, end, row."""
    return runs(_word_byte()[data], starts)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
