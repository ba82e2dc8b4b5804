"""Words of texts as numpy arrays, for the operators that scan word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quarrymill.llm.anchors import mix64

_SLOTS = 64
_TABLE = mix64(np.arange(_SLOTS * 256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)).reshape(-1)


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer of words with one space between each two."""
    if not len(buffer):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(buffer == 32)
    return np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(buffer)]))


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word buffer[start : end]; words are not empty, in order, one byte apart.

    Sums a table value for each (byte, place); places repeat after 64 bytes, so long words
    can share a hash.  Users compare the words themselves before they act on a match.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(buffer), dtype=np.int32)
    lengths = (ends - starts).astype(np.int32)
    steps = np.append(lengths[:-1] + 1, len(buffer) - starts[-1])
    place -= np.repeat(starts.astype(np.int32), steps)
    place &= _SLOTS - 1
    place <<= 8
    place |= buffer
    values = _TABLE[place]
    values[ends[:-1]] = 0
    return mix64(np.add.reduceat(values, starts) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a task turns few texts into Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
