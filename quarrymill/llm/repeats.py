"""Exact search for repeated windows over a corpus, as five Spark steps.

1. Documents are dealt into groups of bounded size by a hash.
2. Each group lists its anchors' hashes (see anchors.py), already reduced to one entry a
   hash, dealt into buckets by hash.
3. Each bucket finds the hashes that can repeat and tells each group which of its own do.
   A hash found in very many places is marked hot.
4. Each group cuts the text around its repeating anchors (regions), and these are dealt
   by anchor hash.  Hot anchors are split into their single windows, each once a group and
   dealt by the whole window's hash, so no key gathers many different texts.
5. A resolver (suffix array or FM-index) decides for each region which windows repeat.
   The answers go back to the groups, which mark the documents.

Steps 2 to 4 only route: false alarms cost time, never results.  Nothing is capped and
nothing is collected by the driver except one sum of text sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.anchors import anchors
from quarrymill.llm.words import word_hashes, word_spans

#: Bytes of text in a group of documents.
GROUP_BYTES = 12 << 20
#: Symbols handled at once by numpy within a group.
PIECE = 1 << 19
#: A hash in more groups, or more often in one group, than this is split by window.
HOT_GROUPS, HOT_IN_GROUP = 256, 64
#: Buckets of regions for each group of documents.
BUCKETS = 2
#: One row for each group and bucket: the regions' bytes in one compressed blob, and for each region its size, the least
#: document that has it in the group, how often it stands there, and where (document within the group, first window).
REGIONS = "bucket int, g int, regions binary, sizes array<int>, least array<long>, times array<int>, owners array<int>, begins array<long>"
#: The windows that repeat, as bits from the region's first window, for regions that have any.
ANSWERS = "g int, masks array<long>, times array<int>, owners array<int>, begins array<long>"
LAST = 2**63 - 1


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its size."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


@dataclass(frozen=True)
class Windows:
    """What repeats: `size` symbols (bytes or words) in a row, anchored by k-grams of `k`.

    across: only repeats in different documents count.
    resolve(regions, symbols per region, least doc, occurrences) -> a bool array of window
    starts for each region.
    """

    size: int
    k: int
    words: bool
    across: bool
    resolve: Callable


class Group:
    """The texts of one group, sorted, as symbols with document borders."""

    def __init__(self, table: pa.Table, words: bool):
        rows = sorted(zip(table["doc"].to_pylist(), table["text"].to_pylist()))
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.texts = [b" ".join(r[1].split()) if words else r[1] for r in rows]
        self.words = words

    def pieces(self, window: int) -> Iterator[tuple]:
        """(buffer, symbols, byte starts, byte ends, doc, symbol starts, ends, skipped symbols) of a bounded size."""
        parts: list[tuple] = []
        size = 0
        for d, text in enumerate(self.texts):
            if self.words:
                at, skipped = 0, 0
                while at < len(text):
                    end = text.find(b" ", at + 8 * PIECE)
                    end = len(text) if end < 0 else end
                    stop = end
                    for _ in range(window - 1):  # the next window-1 words belong to windows that begin here
                        if stop >= len(text):
                            break
                        stop = text.find(b" ", stop + 1)
                        stop = len(text) if stop < 0 else stop
                    parts.append((text[at:stop], d, skipped))
                    size += stop - at
                    skipped += text.count(b" ", at, end) + 1
                    at = end + 1
                    if size >= 4 * PIECE:
                        yield self._piece(parts)
                        parts, size = [], 0
            else:
                for at in range(0, max(len(text) - window + 1, 0), PIECE):
                    part = text[at : at + PIECE + window - 1]
                    parts.append((part, d, at))
                    size += len(part)
                    if size >= PIECE:
                        yield self._piece(parts)
                        parts, size = [], 0
        if parts:
            yield self._piece(parts)

    def _piece(self, parts):
        docs = np.array([p[1] for p in parts])
        skipped = np.array([p[2] for p in parts], np.int64)
        if not self.words:
            buffer = b"".join(p[0] for p in parts)
            symbols = np.frombuffer(buffer, np.uint8)
            ends = np.cumsum([len(p[0]) for p in parts])
            return buffer, symbols, None, None, docs, ends - np.array([len(p[0]) for p in parts]), ends, skipped
        buffer = b" ".join(p[0] for p in parts)
        raw = np.frombuffer(buffer, np.uint8)
        first, last = word_spans(raw)
        counts = np.array([p[0].count(b" ") + 1 for p in parts])
        ends = np.cumsum(counts)
        return buffer, word_hashes(raw, first, last), first, last, docs, ends - counts, ends, skipped


def grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(g, doc, text as bytes), dealt into groups of about GROUP_BYTES; null ids come last, null texts are empty."""
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // GROUP_BYTES))
    key = F.pmod(F.xxhash64("doc"), F.lit(n)).cast("int")
    return rows.withColumn("g", key).repartition(n, "g"), n


def marked(docs: DataFrame, spec: Windows, finish: Callable, schema: str, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: finish(id, text bytes, window starts that repeat as sorted array) -> tuple of schema."""
    texts, n = grouped(docs, id_col, text_col)
    window, k, by_words, across = spec.size, spec.k, spec.words, spec.across
    resolve = spec.resolve
    n_buckets = n * BUCKETS
    if window - k >= 62:
        raise ValueError("an anchor has up to window - k + 1 windows, which must fit 62 bits")

    def found(group: Group):
        for buffer, symbols, b0, b1, docs_, s, e, skipped in group.pieces(window):
            h, _, first, last, d = anchors(symbols, s, e, window, k)
            yield buffer, b0, b1, h, first, last, docs_[d], first - s[d] + skipped[d]

    def listed(key, table):
        hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, _, h, _, _, d, _ in found(Group(table, by_words)):
            hashes.append(h)
            owners.append(d)
        h, d = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(h, kind="stable")  # documents come in order, so they stay so within a hash
        h, d = h[order], d[order]
        new = np.append(True, h[1:] != h[:-1])[: len(h)]
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(h)))
        many = (d[at + size - 1] != d[at]) if across else size > 1
        h = h[at]
        value = ((((h >> np.uint64(32)) & np.uint64(2**29 - 1)) << np.uint64(2)) | (size > HOT_IN_GROUP).astype(np.uint64) << np.uint64(1) | many.astype(np.uint64)).astype(np.int32)
        bucket = (h % np.uint64(n)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, value = bucket[order], value[order]
        at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(value)), pa.int32()), pa.array(value))
        return pa.table({"bucket": pa.array(bucket[at]), "g": pa.array(np.full(len(at), key[0].as_py(), np.int32)), "hashes": lists})

    def shared(key, table):
        column = table["hashes"].combine_chunks()
        value = column.flatten().to_numpy()
        g = np.repeat(table["g"].to_numpy(), np.diff(column.offsets.to_numpy()))
        kind = value >> 2
        order = np.argsort(kind, kind="stable")
        at = np.flatnonzero(np.append(True, np.diff(kind[order]) != 0)[: len(order)])
        size = np.diff(np.append(at, len(order)))
        flags = np.bitwise_or.reduceat(value[order] & 3, at) if len(at) else at
        repeats = (size > 1) | (flags & 1 > 0)
        hot = (size > HOT_GROUPS) | (flags & 2 > 0)
        which = order[np.repeat(repeats, size)]
        told = ((kind[which] << 1) | np.repeat(hot, size)[np.repeat(repeats, size)]).astype(np.int32)
        order = np.argsort(g[which], kind="stable")
        g, told = g[which][order], told[order]
        at = np.flatnonzero(np.append(True, g[1:] != g[:-1])[: len(g)])
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(told)), pa.int32()), pa.array(told))
        return pa.table({"g": pa.array(g[at], pa.int32()), "bucket": pa.array(np.full(len(at), key[0].as_py(), np.int32)), "hashes": lists})

    def cut(key, left, right):
        parts: list[tuple] = []
        hot_rows: dict[bytes, list] = {}
        if len(left) and len(right):
            column = right["hashes"].combine_chunks()
            told = column.flatten().to_numpy()
            bucket = np.repeat(right["bucket"].to_numpy(), np.diff(column.offsets.to_numpy())).astype(np.int64)
            wanted = (bucket << 29) | (told >> 1)
            order = np.argsort(wanted)
            wanted, hot = wanted[order], (told & 1)[order] > 0
            group = Group(left, by_words)
            for buffer, b0, b1, h, first, last, d, begin in found(group):
                mine = ((h % np.uint64(n)) << np.uint64(29) | ((h >> np.uint64(32)) & np.uint64(2**29 - 1))).astype(np.int64)
                place = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
                hit = wanted[place] == mine
                cold = np.flatnonzero(hit & ~hot[place])
                for i in np.flatnonzero(hit & hot[place]).tolist():  # one row for each different window
                    for j in range(first[i], last[i] + 1):
                        window_ = buffer[b0[j] : b1[j + window - 1]] if by_words else buffer[j : j + window]
                        hot_rows.setdefault(window_, []).append((int(d[i]), int(begin[i] + j - first[i])))
                lo = b0[first[cold]] if by_words else first[cold]
                hi = b1[last[cold] + window - 1] if by_words else last[cold] + window
                size = hi - lo
                at = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
                raw = np.frombuffer(buffer, np.uint8)[at]
                parts.append(((h[cold] % np.uint64(n_buckets)).astype(np.int32), size.astype(np.int32), raw, d[cold].astype(np.int32), begin[cold].astype(np.int64)))
        ones = [len(x) for x in hot_rows.values()]
        if hot_rows:
            raw = np.frombuffer(b"".join(hot_rows), np.uint8)
            bucket = np.array([xxhash.xxh64_intdigest(x) % n_buckets for x in hot_rows], np.int32)
            owners = np.array([o for x in hot_rows.values() for o, _ in x], np.int32)
            begins = np.array([o for x in hot_rows.values() for _, o in x], np.int64)
            parts.append((bucket, np.array([len(x) for x in hot_rows], np.int32), raw, owners, begins))
        if not parts:
            return pa.table({f.name: pa.array([], f.type) for f in region_schema}, schema=region_schema)
        bucket, size, raw, owners, begins = (np.concatenate(x) for x in zip(*parts))
        times = np.ones(len(bucket), np.int32)
        times[len(bucket) - len(ones) :] = ones
        order = np.argsort(bucket, kind="stable")
        raw = raw[_ranges((np.cumsum(size) - size)[order], size[order])]
        spread = _ranges((np.cumsum(times) - times)[order], times[order])
        owners, begins, size, times, bucket = owners[spread], begins[spread], size[order], times[order], bucket[order]
        row = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        ends = np.append(row[1:], len(bucket)) if len(row) else row
        bytes_to = np.append(0, np.cumsum(size))
        owners_to = np.append(0, np.cumsum(times))
        pack = zstandard.ZstdCompressor(level=1).compress
        blobs = [pack(raw[bytes_to[x] : bytes_to[y]].tobytes()) for x, y in zip(row, ends)]
        lists = lambda v, cuts, kind: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(v, kind))
        own = np.append(owners_to[row], len(owners))
        least = group.ids[owners[owners_to[:-1]]]
        return pa.table(
            {
                "bucket": pa.array(bucket[row]),
                "g": pa.array(np.full(len(row), key[0].as_py(), np.int32)),
                "regions": pa.array(blobs, pa.binary()),
                "sizes": lists(size, np.append(row, len(size)), pa.int32()),
                "least": lists(least, np.append(row, len(size)), pa.int64()),
                "times": lists(times, np.append(row, len(size)), pa.int32()),
                "owners": lists(owners, own, pa.int32()),
                "begins": lists(begins, own, pa.int64()),
            },
            schema=region_schema,
        )

    def resolved(key, table):
        unpack = zstandard.ZstdDecompressor().decompress
        index: dict[bytes, int] = {}
        which = []
        sizes = table["sizes"].combine_chunks()
        for blob, lengths in zip(table["regions"].to_pylist(), table["sizes"].to_pylist()):
            raw, at = unpack(blob), 0
            for x in lengths:
                which.append(index.setdefault(raw[at : at + x], len(index)))
                at += x
        which = np.array(which, np.int64)
        least_of = table["least"].combine_chunks().flatten().to_numpy()
        times_of = table["times"].combine_chunks().flatten().to_numpy()
        least = np.full(len(index), LAST)
        np.minimum.at(least, which, least_of)
        times = np.bincount(which, times_of, len(index)).astype(np.int64)
        regions = list(index)
        mask = full = np.zeros(0, np.int64)
        if regions:
            count = np.array([(r.count(b" ") + 1 if by_words else len(r)) - window + 1 for r in regions], np.int64)
            full = (np.int64(1) << count) - 1
            bits = np.concatenate(resolve(regions, count, least, times)).astype(np.int64)
            first = np.cumsum(count) - count
            mask = np.add.reduceat(bits << (np.arange(len(bits)) - np.repeat(first, count)), first)
        mask = mask[which]
        if across:
            mask = np.where(least_of > least[which], full[which], mask)
        n_rows = np.diff(sizes.offsets.to_numpy())
        g = np.repeat(table["g"].to_numpy(), n_rows)
        keep = (mask > 0) | (times_of > 1 if across else False)
        taken = np.repeat(keep, times_of)
        cuts = np.append(0, np.cumsum(np.add.reduceat(keep, np.cumsum(n_rows) - n_rows))) if len(n_rows) else [0]
        occurrences = np.append(0, np.cumsum(np.where(keep, times_of, 0)))[np.append(np.cumsum(n_rows) - n_rows, len(keep))]
        lists = lambda v, cut_, kind: pa.ListArray.from_arrays(pa.array(cut_, pa.int32()), pa.array(v, kind))
        return pa.table(
            {
                "g": table["g"],
                "masks": lists(mask[keep], cuts, pa.int64()),
                "times": lists(times_of[keep], cuts, pa.int32()),
                "owners": lists(table["owners"].combine_chunks().flatten().to_numpy()[taken], occurrences, pa.int32()),
                "begins": lists(table["begins"].combine_chunks().flatten().to_numpy()[taken], occurrences, pa.int64()),
            },
            schema=answer_schema,
        )

    fields = [f.split()[0] for f in schema.split(", ")]

    def ended(key, left, right):
        group = Group(left, False)
        flat = {c: (right[c].combine_chunks().flatten().to_numpy() if len(right) else np.zeros(0, np.int64)) for c in ("masks", "times", "owners", "begins")}
        mask, owners, begins = np.repeat(flat["masks"], flat["times"]), flat["owners"], flat["begins"]
        if across:  # copies of a region in one group: those of later documents have it from the first
            head = np.repeat(owners[np.cumsum(flat["times"]) - flat["times"]] if len(owners) else owners, flat["times"])
            mask = np.where(group.ids[owners] > group.ids[head], 1, mask) if len(owners) else mask
        where, who = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for bit in range(window - k + 1):
            on = np.flatnonzero((mask >> bit) & 1)
            where.append(begins[on] + bit)
            who.append(owners[on])
        where, who = np.concatenate(where), np.concatenate(who)
        order = np.lexsort((where, who))
        where, cuts = where[order], np.searchsorted(who[order], np.arange(len(group.texts) + 1))
        rows = [finish(int(i), text, where[cuts[d] : cuts[d + 1]]) for d, (i, text) in enumerate(zip(group.ids, group.texts))]
        return pa.table({f: [r[i] for r in rows] for i, f in enumerate(fields)}, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target, region_schema, answer_schema = (to_arrow_schema(_parse_datatype_string(x)) for x in (schema, REGIONS, ANSWERS))
    lists = texts.groupBy("g").applyInArrow(listed, "bucket int, g int, hashes array<int>")
    told = lists.groupBy("bucket").applyInArrow(shared, "g int, bucket int, hashes array<int>")
    regions = texts.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(cut, REGIONS)
    answers = regions.groupBy("bucket").applyInArrow(resolved, ANSWERS)
    return texts.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(ended, schema)
