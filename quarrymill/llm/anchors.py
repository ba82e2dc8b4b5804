"""Content-defined anchors: the routing step of exact repeated-window search.

Every window of `window` symbols picks the position of its smallest k-gram hash
(leftmost on ties).  The choice depends on the window's content alone, so equal
windows pick the same k-gram at the same offset wherever they stand.  Shipping
one row per *anchor* (about 2 / (window - k + 2) of the positions) and grouping
by the k-gram therefore brings all equal windows together without shipping one
row per window.

All functions work on one concatenated numpy array of symbols in which document
borders are given by offsets; no window crosses a border.
"""

from __future__ import annotations

import numpy as np

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def kgram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of symbols[i : i + k] for each i (len(symbols) - k + 1 values).

    Built by doubling, so the cost is log2(k) passes rather than k.
    """
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = symbols.astype(np.uint64) + np.uint64(1)
    if symbols.dtype != np.uint8:
        power = mix64(power)
    out, done, length, bits = None, 0, 1, k
    while bits:
        if bits & 1:
            if out is None:
                out = power
            else:
                m = len(power) - done
                out = out[:m] * _MUL + mix64(power[done : done + m]) if done else power
            done += length
        bits >>= 1
        if bits:
            m = len(power) - length
            power = power[:m] * _MUL + mix64(power[length:])
            length *= 2
    return mix64(out[:n])


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the least of values[i : i + width], for each full window.

    Works by doubling on (value, position) pairs.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = np.arange(len(values), dtype=np.int32 if len(values) < 2**31 else np.int64)
    least, length = values, 1
    while length * 2 <= width:
        m = len(least) - length
        left, right = least[:m], least[length:]
        take = right < left
        best = np.where(take, best[length:], best[:m])
        least = np.where(take, right, left)
        length *= 2
    if length < width:
        gap = width - length
        m = len(least) - gap
        best = np.where(least[gap:] < least[:m], best[gap:], best[:m])
    return best[:n]


def anchors(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, k: int):
    """Anchors of all windows of the documents symbols[starts[d] : ends[d]].

    Returns (hash, position, first, last, doc): the k-gram's hash and position, and
    the first and last start of the windows that picked it.  Documents must be
    listed in order and must not overlap.
    """
    empty = np.zeros(0, np.int64)
    hashes = kgram_hashes(symbols, k)
    picks = sliding_argmin(hashes, window - k + 1)
    if not len(picks):
        return np.zeros(0, np.uint64), empty, empty, empty, empty
    counts = np.maximum(ends - starts - window + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.uint64), empty, empty, empty, empty
    doc = np.repeat(np.arange(len(starts)), counts)
    base = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    begin = np.arange(total) + base
    pick = picks[begin]
    new = np.ones(total, bool)
    new[1:] = (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], total) - 1
    where = pick[at].astype(np.int64)
    return hashes[where], where, begin[at], begin[last], doc[at]
