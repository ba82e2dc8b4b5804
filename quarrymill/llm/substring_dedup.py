"""Word passages that stand more than once in the corpus, by FM-indexes over shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quarrymill.llm.repeats import LAST, Windows, marked
from quarrymill.llm.suffix_dedup import covered


class WaveletTree:
    """A sequence of small numbers as one bit vector a level, with counts every 64 bits."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            padded = np.zeros((len(bit) // 64 + 1) * 64, bool)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.bits.append(words)
            self.counts.append(np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))
        self.base = self._down(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, (words, counts, zeros) in enumerate(zip(self.bits, self.counts, self.zeros)):
            block = at >> 6
            ones = counts[block] + np.bitwise_count(words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> (self.levels - 1 - i)) & 1 > 0, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol stands before place `at`."""
        return self._down(symbol, at) - self.base[symbol]


class FMIndex:
    """BWT of a sequence of numbers (0 ends each part) in a wavelet tree, with LCP intervals."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        n = len(text)
        ranks = [text.astype(np.int64)]
        step = 1
        while True:
            rank = ranks[-1]
            key = rank * (n + n_symbols + 1)
            key[: n - step] += rank[step:] + 1
            order = np.argsort(key)
            new = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1 or step >= n:
                break
            ranks.append(rank)
            step *= 2
        self.suffixes, self.n = order, n
        common = np.zeros(n + 1, np.int64)
        a, b = order[:-1].copy(), order[1:].copy()
        for level in range(len(ranks) - 1, -1, -1):
            size = 1 << level
            inside = np.flatnonzero((a < n) & (b < n))
            same = inside[ranks[level][a[inside]] == ranks[level][b[inside]]]
            same = same[(a[same] + size <= n) & (b[same] + size <= n)]
            common[1:n][same] += size
            a[same] += size
            b[same] += size
        common[0] = common[n] = -1
        self.common = common
        self.before, self.after = _smaller(common), (n - _smaller(common[::-1]))[::-1]
        bwt = text[order - 1]
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=n_symbols)))
        self.tree = WaveletTree(bwt, n_symbols)

    def extended(self, symbol, low, high):
        """The interval of symbol + pattern from that of the pattern."""
        start = self.first[symbol]
        return start + self.tree.rank(symbol, low), start + self.tree.rank(symbol, high)

    def parent(self, low, high):
        """The interval of the longest shorter pattern that stands in more places, and its length."""
        side = np.where(self.common[low] >= self.common[high], low, high)
        depth = self.common[side]
        root = depth <= 0
        return np.where(root, 0, self.before[side]), np.where(root, self.n, self.after[side]), np.maximum(depth, 0)


def _smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it that holds a smaller value (0 at the border)."""
    back = np.arange(len(values)) - 1
    open_ = np.flatnonzero(back >= 0)
    while len(open_):
        open_ = open_[values[back[open_]] >= values[open_]]
        back[open_] = back[back[open_]]
        open_ = open_[back[open_] >= 0]
    return np.maximum(back, 0)


def matching_statistics(index: FMIndex, weights: np.ndarray, text: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place of the streamed sequences text[begin : end], the longest match of weight 2 or more.

    One backward search for each sequence, all sequences at once: extend to the left while
    the match keeps its weight, else give up the right end (the parent interval).
    """
    heavy = np.append(0, np.cumsum(weights[index.suffixes]))
    out = np.zeros(len(text), np.int64)
    at = ends - 1
    low, high, length = np.zeros(len(at), np.int64), np.full(len(at), index.n), np.zeros(len(at), np.int64)
    alive = np.flatnonzero(at >= begins)
    while len(alive):
        a, b = index.extended(text[at[alive]], low[alive], high[alive])
        good = heavy[b] - heavy[a] >= 2
        win, lose = alive[good], alive[~good]
        low[win], high[win] = a[good], b[good]
        length[win] += 1
        out[at[win]] = length[win]
        at[win] -= 1
        none = lose[length[lose] == 0]
        at[none] -= 1
        cut = lose[length[lose] > 0]
        low[cut], high[cut], length[cut] = index.parent(low[cut], high[cut])
        alive = alive[at[alive] >= begins[alive]]
    return out


def _resolver(window: int):
    def resolve(regions, counts, least, times):
        words = b" \0 ".join(regions).split(b" ")
        words.append(b"\0")
        codes, names = pd.factorize(np.array(words, dtype=object))
        mark = int(codes[-1])
        text = codes.astype(np.int64) + 1
        text[codes == mark] = 0
        # a word that is itself one NUL byte would be taken for a border
        sizes = np.array([r.count(b" ") + 1 for r in regions])
        ends = np.cumsum(sizes + 1) - 1
        border = np.zeros(len(text), bool)
        border[ends] = True
        text[(text == 0) & ~border] = mark + 1
        index = FMIndex(text, len(names) + 1)
        weights = np.repeat(times, sizes + 1)
        found = matching_statistics(index, weights, text, ends - sizes, ends)
        return [found[b : b + c] >= window for b, c in zip((ends - sizes).tolist(), counts.tolist())]

    return resolve


def substring_dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a run of `window` words that also starts anywhere else.

    Each shard of candidate passages (see repeats.py) gets an FM-index over its words; the
    passages are streamed through it by backward search, and the matching statistics tell
    where a match found at least twice reaches `window` words.  All copies go, also those
    within one document.

    Words are runs of bytes other than space and 0x09-0x0D.  Returns (doc_id, n_words,
    starts, ends, kept): removed runs as word offsets, and the kept words joined by one
    space.  A null text has no words; a null id returns as null; rows with the same id are
    documents of their own and so repeat each other; other columns are ignored.
    """

    def finish(i, text, hits):
        words = text.split()
        starts, ends = covered(hits, window)
        parts, at = [], 0
        for s, e in zip(starts.tolist(), ends.tolist()):
            parts += words[at:s]
            at = e
        parts += words[at:]
        return (None if i == LAST else i, len(words), starts.tolist(), ends.tolist(), b" ".join(parts).decode("utf-8", "replace"))

    k = max(1, min(12, window // 2), window - 40)
    spec = Windows(window, k, True, False, _resolver(window))
    return marked(docs, spec, finish, "doc_id long, n_words long, starts array<long>, ends array<long>, kept string", id_col, text_col)
