"""Passages of benchmark items in training documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.llm.anchors import kgram_hashes
from quarrymill.llm.scratch import written
from quarrymill.llm.words import small, word_hashes, word_spans

#: Bytes of benchmark text whose windows are broadcast at once; larger benchmarks take several scans.
PIECE_BYTES = 4 << 20
_CHUNK = 1 << 22
_FILTER_BITS = 22
#: A-Z become a-z; what is no letter, digit or part of a non-ASCII character becomes a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def benchmark_windows(items: list[tuple], size: int) -> tuple[dict, dict]:
    """{window as bytes: set of item ids} and {length in words: filter of window hashes}."""
    windows: dict[bytes, set] = {}
    by_length: dict[int, set] = {}
    for item, text in items:
        words = (text or "").encode().translate(FOLD).split()
        length = min(size, len(words))
        for i in range(len(words) - length + 1 if length else 0):
            window = b" ".join(words[i : i + length])
            windows.setdefault(window, set()).add(item)
            by_length.setdefault(length, set()).add(window)
    filters = {}
    for length, texts in by_length.items():
        buffer = np.frombuffer(b" ".join(sorted(texts)), np.uint8)
        hashes = kgram_hashes(word_hashes(buffer, *word_spans(buffer)), length)[::length]
        filters[length] = np.zeros(1 << _FILTER_BITS, bool)
        filters[length][(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return windows, filters


def _scanned(texts: list[bytes], windows: dict, filters: dict) -> list[tuple]:
    """For each text: number of words, hit word runs, items."""
    out: list = [None] * len(texts)
    at = 0
    while at < len(texts):
        parts, counts, size, first = [], [], 0, at
        while at < len(texts) and (not parts or size < _CHUNK):
            words = texts[at].translate(FOLD).split()
            counts.append(len(words))
            if words:
                parts.append(b" ".join(words))
                size += len(parts[-1])
            at += 1
        joined = b" ".join(parts)
        buffer = np.frombuffer(joined, np.uint8)
        starts, ends = word_spans(buffer)
        hashes = word_hashes(buffer, starts, ends)
        counts = np.array(counts)
        last = np.cumsum(counts)
        hits: dict[int, tuple] = {}
        for length, known in filters.items():
            found = np.flatnonzero(known[(kgram_hashes(hashes, length) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            owner = np.searchsorted(last, found, "right")
            inside = found + length <= last[owner] if len(found) else np.zeros(0, bool)
            for i, d in zip(found[inside].tolist(), owner[inside].tolist()):
                items = windows.get(joined[starts[i] : ends[i + length - 1]])
                if items:
                    mine = hits.setdefault(d, ([], set()))
                    mine[0].append((i, i + length))
                    mine[1].update(items)
        for d, n in enumerate(counts.tolist()):
            spans, items = hits.get(d, ((), ()))
            base, runs = last[d] - n, []
            for s, e in sorted(spans):
                if runs and s - base <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], int(e - base))
                else:
                    runs.append([int(s - base), int(e - base)])
            out[first + d] = (n, runs, items)
    return out


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: bool = False) -> DataFrame:
    """Words of documents that stand in a benchmark window: (doc_id, n_words, starts, ends, items).

    Words are runs of letters, digits and non-ASCII characters, with A-Z lower-cased.  A
    window is `size` consecutive words of an item; an item of fewer words is one window.
    The windows are broadcast when the benchmark's text is within PIECE_BYTES.  A larger
    benchmark is dealt into pieces of about that size by a hash of item and text, and what
    one piece found is written before the next one is broadcast, so that a task never holds
    two of them.  Hash hits are verified against the words.

    starts and ends are the maximal runs of hit words (word offsets); items are the item
    ids as strings, sorted.  A null text or item text has no words; an item with a null id
    hits words but is not listed; rows of the benchmark repeated whole count once; a null or
    repeated doc_id returns as it is; every row of docs is returned once; a very long text
    is scanned whole in one task.  Other columns, of any name, are ignored, or with `keep`
    returned in row.cols; row.no_text then tells a null text from an empty one.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces = max(1, -(-total // PIECE_BYTES))
    out = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<long>").alias("starts"),
        F.array().cast("array<long>").alias("ends"),
        F.array().cast("array<string>").alias("items"),
        *([F.struct(F.col(text_col).isNull().alias("no_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("cols")).alias("row")] if keep else []),
    )
    schema = out.schema
    for piece in range(pieces):
        part = items if pieces == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(pieces)) == piece)
        shared = spark.sparkContext.broadcast(benchmark_windows([tuple(r) for r in part.collect()], size))

        def scan(batches, shared=shared) -> Iterator[pa.RecordBatch]:
            windows, filters = shared.value
            for batch in small(batches):
                found = _scanned(batch["text"].to_pylist(), windows, filters)
                starts, ends, named = [], [], []
                for (_, runs, mine), s, e, before in zip(found, *(batch[c].to_pylist() for c in ("starts", "ends", "items"))):
                    merged: list = []
                    for a, b in sorted([*runs, *zip(s, e)]):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                    starts.append([a for a, _ in merged])
                    ends.append([b for _, b in merged])
                    named.append(sorted({*before, *(x for x in mine if x is not None)}))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], batch["text"], pa.array([n for n, _, _ in found], pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(named, pa.list_(pa.string())), *([batch["row"]] if keep else [])],
                    batch.schema.names,
                )

        out = out.mapInArrow(scan, schema)
        if piece + 1 < pieces:
            out = written(out, "hits")
    return out


_WORD = re.compile(rb"[^ ]+")


def without_hits(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    """The text without the characters from the first to the last word of each hit run."""
    words = [m.span() for m in _WORD.finditer(text.translate(FOLD))]
    parts, at = [], 0
    for s, e in zip(starts, ends):
        parts.append(text[at : words[s][0]])
        at = words[e - 1][1]
    parts.append(text[at:])
    return b"".join(parts)


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, max_share: float = 0.5) -> DataFrame:
    """docs (any columns, with doc_id and text) without benchmark passages.

    A document of which more than max_share of the words are hit goes; of the others the hit
    passages are cut out of the text (and n_chars, if there is such a column, is set anew).
    Untouched texts, nulls, empty texts and all other columns, of any name, stay as they
    are; each row, repeated or not, is judged for itself; an empty table or benchmark
    changes nothing; see benchmark_hits for very long texts.
    """
    hits = benchmark_hits(docs, benchmark, size, keep=True)
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    kept = hits.where(n_hit <= max_share * F.col("n_words"))

    def cut(batches) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [without_hits(t, s, e) if s else t for t, s, e in zip(*(batch[c].to_pylist() for c in ("text", "starts", "ends")))]
            touched = pa.array([bool(s) for s in batch["starts"].to_pylist()])
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(texts, pa.binary()).cast(pa.string()), touched], ["row", "left", "touched"])

    row = kept.schema["row"]
    schema = T.StructType([row, T.StructField("left", T.StringType()), T.StructField("touched", T.BooleanType())])
    out = kept.select("row", "text", "starts", "ends").mapInArrow(cut, schema)
    new = {"text": F.when(~F.col("row.no_text"), F.col("left"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("touched"), F.char_length("left").cast(row.dataType["cols"].dataType["n_chars"].dataType)).otherwise(F.col("row.cols.n_chars"))
    return out.select(*[new[c].alias(c) if c in new else F.col("row.cols").getField(c).alias(c) for c in docs.columns])
