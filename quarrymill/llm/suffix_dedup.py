"""Removal of text that an earlier document already holds, by longest-previous-factor arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from quarrymill.llm.repeats import LAST, Windows, marked


def suffix_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order of suffixes given as 8-byte columns; each round sorts only what still ties."""
    order = np.argsort(columns[0], kind="stable")
    run = np.zeros(len(order), np.int64)
    change = columns[0][order][1:] != columns[0][order][:-1]
    run[1:] = np.cumsum(change)
    for column in columns[1:]:
        tied = np.zeros(len(order), bool)
        same = run[1:] == run[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        inner = np.lexsort((column[order[at]], run[at]))
        order[at] = order[at][inner]
        values = column[order]
        run[1:] = np.cumsum((run[1:] != run[:-1]) | (values[1:] != values[:-1]))
    return order


def nearest_smaller(values: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """For each place, the least of `common` back to the nearest place of a smaller value (0: none).

    common[i] belongs to the step from i - 1 to i.  Steps back by pointer jumping and stops
    below `least`, as shorter matches do not matter.
    """
    n = len(values)
    back = np.arange(n) - 1
    low = common.copy()
    open_ = np.flatnonzero((back >= 0) & (low >= least))
    while len(open_):
        open_ = open_[values[back[open_]] >= values[open_]]
        to = back[open_]
        low[open_] = np.minimum(low[open_], low[to])
        back[open_] = back[to]
        open_ = open_[(back[open_] >= 0) & (low[open_] >= least)]
    low[back < 0] = 0
    return low


def longest_previous_factors(text: np.ndarray, starts: np.ndarray, docs: np.ndarray, depth: int) -> np.ndarray:
    """Length, up to depth, of the longest match of text[start:] with a start of a smaller doc.

    Lengths under depth are lower bounds.  Each start has depth bytes of its own text.
    """
    n = len(text)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = text
    for step in (1, 2, 4):
        wide[: len(wide) - step] = (wide[: len(wide) - step] << np.uint64(8 * step)) | wide[step:]
    offsets = sorted({min(o, max(depth - 8, 0)) for o in range(0, depth, 8)})
    columns = [wide[starts + o] for o in offsets]
    if depth < 8:
        columns = [columns[0] >> np.uint64(8 * (8 - depth))]
    order = suffix_order(columns)
    common = np.zeros(len(order), np.int64)
    equal = np.ones(max(len(order) - 1, 0), bool)
    for o, column in zip(offsets, columns):
        values = column[order]
        equal &= values[1:] == values[:-1]
        common[1:][equal] = min(o + 8, depth)
    rank = docs[order]
    before = nearest_smaller(rank, common, depth)
    after = nearest_smaller(rank[::-1], np.append(0, common[1:][::-1]), depth)[::-1]
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(before, after)
    return out


def _resolver(depth: int):
    def resolve(regions, counts, least, times):
        text = np.frombuffer(b"".join(regions), np.uint8)
        sizes = np.array([len(r) for r in regions])
        begins = np.cumsum(sizes) - sizes
        total = int(counts.sum())
        first = np.cumsum(counts) - counts
        starts = np.arange(total) - np.repeat(first - begins, counts)
        lpf = longest_previous_factors(text, starts, np.repeat(least, counts), depth)
        return np.split(lpf >= depth, first[1:])

    return resolve


def covered(starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that windows of this size cover."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(starts[1:] > starts[:-1] + size)
    return starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + size


def suffix_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte covered by a `length`-byte string that also starts in a document of a smaller id.

    Suffixes are sorted with those that share a content anchor (see repeats.py); in suffix
    order, the nearest suffixes of a smaller document on either side give the longest
    previous factor, and a start is removed when that reaches `length`.  Equal regions of
    text are merged beforehand into the one of the smallest document: the other copies
    stand next to it in suffix order and have it as their earlier match.

    Returns (doc_id, n_bytes, starts, ends, kept): the removed runs as byte offsets and the
    remaining bytes.  A null text is empty; a null id comes after all others and returns as
    null; rows with the same id never match each other; other columns are ignored.
    """

    def finish(i, text, hits):
        starts, ends = covered(hits, length)
        parts, at = [], 0
        for s, e in zip(starts.tolist(), ends.tolist()):
            parts.append(text[at:s])
            at = e
        parts.append(text[at:])
        return (None if i == LAST else i, len(text), starts.tolist(), ends.tolist(), b"".join(parts))

    k = max(1, min(24, length // 2), length - 40)
    spec = Windows(length, k, False, True, _resolver(length))
    return marked(docs, spec, finish, "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary", id_col, text_col)
