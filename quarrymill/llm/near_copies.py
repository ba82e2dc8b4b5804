"""Near copies by the shingles they share: SimHash and MinHash candidates, each verified on its whole shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarrymill.llm.graph import components
from quarrymill.llm.scratch import removed, written
from quarrymill.llm.simhash import fingerprints, print_groups
from quarrymill.llm.words import small

#: Fingerprints link at so many differing bits, as those of op3; pairs that differ in more meet in the bands of MinHash values.
BITS = 4
#: A pair of similarity 0.8 meets in one of BANDS bands of ROWS hashes with a chance of 1 - (1 - 0.8^5)^30, above 0.99999.
BANDS, ROWS = 30, 5
#: PLANES bits of each of HASHES hashes make a sketch; a hash's bits differ between two sets with a chance of (1 - similarity) * (1 - 2^-PLANES).
HASHES, PLANES = 384, 3
_FACTORS = np.random.default_rng(17).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: So many times more members of a band lead comparisons in each round.
GROWTH = 8
#: A task remembers the sets of so many texts of up to so many shingles while it verifies pairs.
KEPT_SETS, KEPT_SIZE = 4096, 2048


def most_differing(similarity: float) -> int:
    """Hashes with differing bits that a pair of this similarity exceeds with a chance below 1 in 100,000 (4.5 deviations)."""
    p = (1 - similarity) * (1 - 0.5**PLANES)
    return int(np.ceil(HASHES * p + 4.5 * np.sqrt(HASHES * p * (1 - p))))


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted different hashes (XXH64) of the text's word shingles, A-Z lower-cased; fewer words give one of all."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    first = np.append(0, ends[:-words]).tolist() if len(tokens) > words else [0]
    last = (ends[words - 1 :] - 1).tolist() if len(tokens) > words else [len(joined)]
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b]) for a, b in zip(first, last)], np.uint64))


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """(key, doc, same, n_shingles, print, bands, sketch) for (key, doc, text): the digest of the shingle set, its size, its fingerprint, the values of its bands, its sketch."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch["text"].to_pylist()
            sets = [shingles(t, words) for t in texts]
            least = np.zeros((len(sets), HASHES), np.uint64)
            some = [i for i, s in enumerate(sets) if len(s)]
            if some:
                flat, at = np.concatenate([sets[i] for i in some]), np.cumsum([0, *(len(sets[i]) for i in some[:-1])])
                for k, factor in enumerate(_FACTORS):
                    least[some, k] = np.minimum.reduceat(flat * factor, at)
            same = [hashlib.md5(s.tobytes(), usedforsecurity=False).hexdigest() for s in sets]
            rows = [[xxhash.xxh64_intdigest(b.tobytes()) - 2**63 for b in x[: BANDS * ROWS].reshape(BANDS, ROWS)] for x in least]
            # the low bits of products are those of the factors' and the hashes' own low bits: take middle ones
            planes = [np.packbits(((least >> np.uint64(20 + 8 * p)) & np.uint64(1)).astype(bool), axis=1) for p in range(PLANES)]
            sketch = np.ascontiguousarray(np.hstack(planes)).view(np.int64)
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["key"], batch["doc"], pa.array(same), sizes, pa.array(fingerprints(texts, words).view(np.int64)), pa.array(rows, pa.list_(pa.int64())), pa.array(list(sketch), pa.list_(pa.int64()))], ["key", "doc", "same", "n_shingles", "print", "bands", "sketch"])

    return docs.mapInArrow(run, "key string, doc long, same string, n_shingles long, print long, bands array<long>, sketch array<long>")


def _differing(a: str, b: str) -> Column:
    words = HASHES // 64
    xor = lambda i: F.col(a)[i].bitwiseXOR(F.col(b)[i])
    return reduce(add, [F.bit_count(reduce(Column.bitwiseOR, [xor(p * words + i) for p in range(PLANES)])) for i in range(words)])


def _similar(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b, key_a, key_b) whose shingle sets share at least `similarity` of their union."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}

        def of(key: str, text: bytes) -> np.ndarray:
            found = known.get(key)
            if found is None:
                found = shingles(text, words)
                if len(found) <= KEPT_SIZE:
                    if len(known) >= KEPT_SETS:
                        known.clear()
                    known[key] = found
            return found

        for batch in small(batches):
            keep = []
            for a, x, b, y in zip(*(batch[c].to_pylist() for c in ("a", "x", "b", "y"))):
                x, y = of(a, x), of(b, y)
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    keep.append(False)
                    continue
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(keep)), batch["b"].filter(pa.array(keep))], ["a", "b"])

    needed = pairs.select(F.col("key_a").alias("key")).union(pairs.select("key_b")).distinct()
    held = written(texts.join(needed, "key", "left_semi").select("key", "text").dropDuplicates(["key"]), "candidates")
    left = held.select(F.col("key").alias("key_a"), F.col("text").alias("x"))
    right = held.select(F.col("key").alias("key_b"), F.col("text").alias("y"))
    links = written(pairs.join(left, "key_a").join(right, "key_b").select("a", "b", "x", "y").mapInArrow(run, "a string, b string"), "similar")
    removed(held)
    return links


def linked(sets: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, component) of the different shingle sets (same, key, n_shingles, bands, sketch) that verified pairs connect; sets without a link are not listed.

    Members of a band are candidates of one another if their sizes and sketches allow the
    similarity and no earlier band holds them both, so each pair is made once (bands are told
    apart by 32-bit codes: a pair is lost by equal codes with a chance of 7 in 10^9).  They are not compared all with all: in each round the next few members of a band, in an
    order by hash, are compared with those behind them that are not yet in one component
    with them, and every component found saves the pairs within it.  Rounds go on until each
    band is one component or has had every member in the lead, so no candidate is left out.
    """
    group = W.partitionBy("band", "value")
    banded = sets.select("same", F.posexplode("bands").alias("band", "value"))
    banded = banded.withColumn("rank", F.row_number().over(group.orderBy(F.xxhash64("same"), "same"))).withColumn("n", F.count("*").over(group)).where("n > 1")
    codes = F.transform("bands", lambda v: F.hash(v)).alias("codes")
    banded = banded.join(sets.select("same", "key", "n_shingles", "sketch", codes), "same")
    part = banded = written(banded, "bands")
    part = part.withColumn("part", F.col("same"))
    most, low, high, part_table = most_differing(similarity), 0, 1, None
    edges = found = None
    carried = ("key", "part", "rank", "n_shingles", "sketch", "codes")
    while True:
        leads = part.where((F.col("rank") > low) & (F.col("rank") <= high))
        leads = leads.select("band", "value", F.col("same").alias("a"), *[F.col(c).alias(f"{c}_a") for c in carried])
        others = part.select("band", "value", F.col("same").alias("b"), *[F.col(c).alias(f"{c}_b") for c in carried])
        same_band = [leads[c] == others[c] for c in ("band", "value")]
        alike = F.least("n_shingles_a", "n_shingles_b") >= F.greatest("n_shingles_a", "n_shingles_b") * F.lit(similarity)
        earlier = F.slice(F.zip_with("codes_a", "codes_b", lambda x, y: x == y), F.lit(1), leads["band"])
        near = leads.join(others, [*same_band, F.col("rank_b") > F.col("rank_a"), F.col("part_a") != F.col("part_b"), alike, _differing("sketch_a", "sketch_b") <= most, ~F.array_contains(earlier, True)])
        near = written(near.select("a", "b", "key_a", "key_b"), "pairs")
        new = _similar(near, texts, words, similarity)
        if edges is None or not new.isEmpty():
            before = found
            found = written(components(new if edges is None else edges.union(new)).distinct(), "components")
            if before is not None:
                removed(before)
            edges = found.select(F.col("component").alias("a"), F.col("node").alias("b")).where("a < b")
        for done in (near, new, *([part_table] if part_table is not None else [])):
            removed(done)
        low, high = high, high * GROWTH
        part = banded.where(F.col("n") > low).join(found, F.col("same") == F.col("node"), "left").select("band", "value", "same", "key", "n_shingles", "sketch", "codes", "rank", "n", F.coalesce("component", "same").alias("part"))
        part = part_table = written(part.withColumns({"least": F.min("part").over(group), "last": F.max("part").over(group)}).where("least != last").drop("least", "last"), "open")
        if part.isEmpty():
            for done in (part, banded):
                removed(done)
            return found


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with exactly one row of each group of near copies: the one with the least id (null ids last).

    Two rows are near copies if their sets of `words`-word shingles have a Jaccard similarity
    of at least `similarity`; groups are what such pairs connect.  Texts with equal sets
    (those without words too) are merged first; the others are candidates where fingerprints
    link (the groups of op3, of `words`-word shingles) or a band of MinHash values agrees, and candidates are verified on their whole sets (see linked).

    Each row counts for itself, whether its id is null, repeated or neither; of rows that
    are alike in all columns one stays.  A null or empty text has the empty set; a very long
    text is shingled whole; columns of any name stay as they are; an empty table stays empty.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.md5(F.to_json(F.struct(*rest, F.md5(F.col(text_col).cast("string")).alias("__text"))))
    texts = docs.select(key.alias("key"), F.col(id_col).cast("long").alias("doc"), text.cast("binary").alias("text"))
    marked = written(_signed(texts, words), "signed")
    prints = written(marked.select("print", F.col("print").alias("least")).distinct(), "prints")
    # repeats count in fingerprints, so equal sets may have several; any of them may name the candidates
    sets = marked.groupBy("same").agg(F.min("key").alias("key"), F.first("n_shingles").alias("n_shingles"), F.min("print").alias("print"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    bands = F.concat(F.array(F.xxhash64(F.lit("simhash"), "group")), "bands").alias("bands")  # the first band is the group of linked fingerprints
    sets = written(sets.join(print_groups(prints, BITS), "print").select("same", "key", "n_shingles", bands, "sketch"), "sets")
    found = linked(sets, texts, words, similarity)
    named = marked.select("key", "doc", "same").join(found, F.col("same") == F.col("node"), "left")
    first = F.min(F.struct(F.col("doc").isNull().alias("no_id"), "doc", "key")).alias("first")
    kept = written(named.groupBy(F.coalesce("component", "same").alias("group")).agg(first).select(F.col("first.key").alias("kept_key")), "kept")
    # rows alike in all columns have one key; of those one stays
    alike = written(marked.groupBy("key").count().where("count > 1").select("key"), "alike")
    for done in (marked, prints, sets, found):
        removed(done)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("row_key")).join(kept, F.col("row_key") == F.col("kept_key"), "left_semi")
    repeated = keyed.join(alike, F.col("row_key") == F.col("key"), "left_semi").dropDuplicates(["row_key"])
    return keyed.join(alike, F.col("row_key") == F.col("key"), "left_anti").union(repeated).select("row.*")
