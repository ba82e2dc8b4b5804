"""Jaccard join of texts by their word shingles: a size-aware heavy-light join.

Light (small) sets are found by enumerated pairs of their rarest shingles, heavy (large) ones
by scanning inverted lists of single shingles; which sizes are light is chosen by cost.  Both
are exact: a pair that reaches the similarity always meets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.anchors import mix64
from quarrymill.llm.graph import components
from quarrymill.llm.scratch import removed, written
from quarrymill.llm.words import small, word_hashes, word_spans

#: Subsets of light sets have so many shingles.
SUBSET = 2
#: Shingles are counted in so many slots, by their low bits; the counts only order shingles and price lists.
SLOTS = 1 << 20
#: Bits of a set's parity sketch.
BITS = 512
#: Size classes: STEPS for each doubling.
STEPS = 8
#: Lists of up to SHORT members compare all at once; in longer ones GROWTH times more members lead in each turn.
SHORT, GROWTH = 8, 64
#: A member of a list that others share is dealt so many times more than one that stands alone.
OPEN = 4
#: Marks by which texts that are in no pair are left where they are read.
MARKS = 1 << 24
_CHUNK, _LONG = 1 << 18, 64
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _codes(tokens: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word; words beyond 64 bytes by XXH64."""
    out = np.zeros(len(tokens), np.uint64)
    for at in range(0, len(tokens), _CHUNK):
        part = tokens[at : at + _CHUNK]
        buffer = np.frombuffer(b" ".join(part), np.uint8)
        starts, ends = word_spans(buffer)
        out[at : at + len(part)] = word_hashes(buffer, starts, ends)
        for i in np.flatnonzero(ends - starts > _LONG):
            out[at + i] = xxhash.xxh64_intdigest(part[i])
    return out


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted different 64-bit hashes of each text's word shingles, A-Z lower-cased; fewer words are one shingle of all."""
    split = [t.lower().split() for t in texts]
    codes = _codes([w for tokens in split for w in tokens])
    ends = np.cumsum([len(tokens) for tokens in split])
    whole = codes[: max(len(codes) - words + 1, 0)]
    for k in range(1, words):
        whole = mix64(whole * _MUL + codes[k : k + len(whole)])
    out = []
    for tokens, end in zip(split, ends.tolist()):
        first = end - len(tokens)
        if len(tokens) >= words:
            out.append(np.unique(whole[first : end - words + 1]))
        elif tokens:
            short = np.array([len(tokens)], np.uint64)
            for code in codes[first:end]:
                short = mix64(short * _MUL + code)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _batches(batches: Iterator[pa.RecordBatch], most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Slices of up to `most` bytes of text, a longer text alone."""
    for batch in small(batches):
        size = pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False)
        cut = 0
        while cut < batch.num_rows:
            rows = max(1, int(np.searchsorted(np.cumsum(size[cut:]), most, "right")))
            yield batch.slice(cut, rows)
            cut += rows


def slot_counts(texts: DataFrame, words: int) -> np.ndarray:
    """In how many texts shingles of each slot stand: SLOTS numbers, whatever the size of the corpus."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in _batches(batches):
            sets = shingle_sets(batch["text"].to_pylist(), words)
            counts += np.bincount((np.concatenate(sets) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts[held], pa.int64())], ["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    rows = texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return out


def shared_least(n: int, percent: int) -> int:
    """How many elements a set of n elements shares at least with any set that reaches the similarity."""
    return -(-percent * n // 100)


def _signed(texts: DataFrame, words: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(doc_id, key, same, n, prefix, bits, subsets, scanned) of each text.

    same is the digest of its set of n shingles; prefix are its rarest shingles, by slot counts, then
    hash: a pair that reaches the similarity shares SUBSET of them, and one even without the last;
    bits are the parities of its elements' hashes; subsets and scanned are what it costs
    as a light set (rows of subsets) and as a heavy one (rows of lists; where others share one, it is dealt OPEN times more and met by the leads of its turns).
    """
    usual = int(np.median(counts))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            same, sizes, prefixes, bits, subsets, scanned = [], [], [], [], [], []
            for s in shingle_sets(batch["text"].to_pylist(), words):
                n = len(s)
                times = counts[(s & np.uint64(SLOTS - 1)).astype(np.int64)]
                head = n - shared_least(n, percent) + SUBSET
                order = np.lexsort((s, times))[:head]
                flips = np.bincount(((s >> np.uint64(40)) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
                same.append(hashlib.md5(s.tobytes(), usedforsecurity=False).digest())
                sizes.append(n)
                prefixes.append(s[order].view(np.int64))
                bits.append(np.packbits(flips.astype(bool)).view(np.int64))
                subsets.append(len(order) * (len(order) - 1) // 2)
                more = times[order[: head - SUBSET + 1]] - usual - 3 * np.sqrt(usual)  # beyond what other shingles bring to a slot
                scanned.append(int(np.where(more > 1, 1 + OPEN + np.log(np.maximum(more, 1)) / np.log(GROWTH), 1).sum()))
            arrays = [batch["doc_id"], batch["key"], pa.array(same, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), pa.array(subsets, pa.int64()), pa.array(scanned, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "same", "n", "prefix", "bits", "subsets", "scanned"])

    return texts.mapInArrow(run, "doc_id long, key string, same binary, n long, prefix array<long>, bits array<long>, subsets long, scanned long")


def light_below(sets: DataFrame) -> int:
    """The size from which sets are heavy: where the rows enumerated for smaller sets and scanned for the others are fewest."""
    step = F.floor(F.log2("n") * STEPS).cast("int").alias("step")
    costs = sorted(tuple(r) for r in sets.groupBy(step).agg(F.sum("subsets"), F.sum("scanned")).collect())  # one row for each size class
    best, at, total = None, 0, sum(c[2] for c in costs)
    for step, subsets, scanned in [*costs, (costs[-1][0] + 1 if costs else 0, 0, 0)]:
        if best is None or total <= best:  # of equal costs the larger boundary
            best, at = total, step
        total += subsets - scanned
    return int(np.ceil(2 ** (at / STEPS)))


def _postings(sets: DataFrame, heavy: int, percent: int) -> DataFrame:
    """(kind, list, id, n, part, place): light sets under the hashes of their subsets, heavy sets and those near them under shingles."""
    cols = ["id", "n", "part"]
    pairs = F.expr("flatten(transform(sequence(0, size(prefix) - 2), i -> transform(slice(prefix, i + 2, size(prefix)), y -> named_struct('list', xxhash64(prefix[i], y), 'place', i))))")
    light = sets.where((F.col("n") < heavy) & (F.size("prefix") > 1)).select(F.lit(0).alias("kind"), *cols, F.explode(pairs).alias("x"))
    single = F.expr(f"transform(slice(prefix, 1, size(prefix) - {SUBSET - 1}), (x, i) -> named_struct('list', x, 'place', i))")
    lists = sets.where(F.col("n") >= shared_least(heavy, percent)).select(F.lit(1).alias("kind"), *cols, F.explode(single).alias("x"))
    return light.unionByName(lists).select("kind", "x.list", *cols, "x.place")


def _differing(a: str, b: str) -> Column:
    return reduce(add, [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITS // 64)])


def _open(postings: DataFrame) -> DataFrame:
    """Lists whose members lie in several components: (kind, list, members, first)."""
    lists = postings.groupBy("kind", "list").agg(F.count("*").alias("members"), F.min("lead").alias("first"), F.min("part").alias("least"), F.max("part").alias("last"))
    return lists.where("least != last").select("kind", "list", "members", "first")


def _near(open_: DataFrame, turn: int, heavy: int, percent: int) -> DataFrame:
    """(a, b): pairs of a list that one of this turn leads, in different components, which sizes, places and parities do not exclude."""
    carried = ("id", "n", "part", "place", "lead", "bits")
    leads = open_.where(F.col("turn") == turn).select("kind", "list", *[F.col(c).alias(f"{c}_a") for c in carried])
    others = open_.select("kind", "list", *[F.col(c).alias(f"{c}_b") for c in carried])
    both = F.col("n_a") + F.col("n_b")
    needed = F.ceil(both * percent / (100 + percent))
    # A list of single shingles finds a pair by its first common shingle, after which enough must be left in both.
    left = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    sized = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    heavy_one = (F.col("kind") == 0) | ((F.greatest("n_a", "n_b") >= heavy) & (left >= needed))
    near = leads.join(others, ["kind", "list"]).where((F.col("lead_b") > F.col("lead_a")) & (F.col("part_a") != F.col("part_b")) & sized & heavy_one & (_differing("bits_a", "bits_b") <= both - 2 * needed))
    return near.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def _maybe_among(keys: DataFrame) -> Column:
    """Whether a row's key may be among keys: always if it is, and by chance as often as marks are set.  MARKS bits reach the tasks, however many keys there are."""
    mark = F.pmod(F.xxhash64("key"), F.lit(MARKS))
    rows = keys.select(mark.alias("mark")).groupBy(F.floor(F.col("mark") / 64).cast("long").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(mark % 64 as int)))").alias("held")).toArrow()
    marks = np.zeros(MARKS // 64, np.int64)
    marks[rows["at"].to_numpy()] = rows["held"].to_numpy()

    @F.pandas_udf("boolean")
    def among(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((marks[at >> 6] >> (at & 63)) & 1 == 1)

    return among(mark)


def _verified(pairs: DataFrame, keys: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose whole sets reach the similarity, by exact counts."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 64):
            found = shingle_sets([t for c in ("x", "y") for t in batch[c].to_pylist()], words)
            keep = []
            for x, y in zip(found[: batch.num_rows], found[batch.num_rows :]):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(keep)), batch["b"].filter(pa.array(keep))], ["a", "b"])

    needed = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    keys = written(keys.join(needed, "id", "left_semi"), "wanted")
    held = texts.select("key", "text").where(_maybe_among(keys)).join(keys, "key").dropDuplicates(["key"])  # an id has one key, by which they lie together
    held = written(held.select("id", "text"), "candidates")
    removed(keys)
    left, right = (held.select(F.col("id").alias(i), F.col("text").alias(t)) for i, t in (("a", "x"), ("b", "y")))
    links = written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")
    removed(held)
    return links


def linked(sets: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame | None:
    """(node, component) of the sets (id, key, n, prefix, bits, subsets, scanned) that links connect; None: there are no links.

    sets is a table made by written(); it is removed once its prefixes are dealt to their lists.

    Members of a list are not compared all with all: in turns, a few of them (the same in all
    lists, by hash) are compared with those that are not yet in one component with them.
    Lists within one component close; turns go on until every list has closed or had each
    member in the lead, so no link is left out.  Turns need no order within a list, so none
    is gathered in one task.
    """
    heavy = light_below(sets)
    postings = _postings(sets.withColumn("part", F.col("id")), heavy, percent).withColumn("lead", F.xxhash64("id"))
    share = (F.col("lead") / 2.0**64 + 0.5) * F.col("members")
    turn = F.when((F.col("members") <= SHORT) | (F.col("lead") == F.col("first")), 0).otherwise(F.greatest(F.lit(1), F.ceil(F.log(float(GROWTH), share)))).cast("int")
    # most postings end here: they are dealt with no more than tells them apart
    open_ = postings.select("kind", "list", "id", "place").join(_open(postings), ["kind", "list"]).withColumns({"part": F.col("id"), "lead": F.xxhash64("id")})
    open_ = open_.withColumn("turn", turn).drop("members", "first").join(sets.select("id", "n", "bits"), "id")
    open_, keys, now, found = written(open_, "open"), written(sets.select("id", "key"), "keys"), 0, None
    removed(sets)
    while not open_.isEmpty():
        near = written(_near(open_, now, heavy, percent), "near")
        if not near.isEmpty():
            new = _verified(near, keys, texts, words, percent)
            if not new.isEmpty():
                before = found
                edges = new if found is None else new.union(found.select("node", "component").where("node != component"))
                found = written(components(edges).distinct(), "components")
                if before is not None:
                    removed(before)
            removed(new)
        now += 1
        rest = open_.where(F.col("turn") >= now)
        if found is not None:
            rest = rest.drop("part").join(found, F.col("id") == F.col("node"), "left").withColumn("part", F.coalesce("component", "id")).drop("node", "component")
        left = written(rest.join(_open(rest).select("kind", "list"), ["kind", "list"], "left_semi"), "open")
        for done in (open_, near):
            removed(done)
        open_ = left
    for done in (open_, keys):
        removed(done)
    return found


def jaccard_groups(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each text: the size of its set of word shingles, and the least id that links reach.

    Two texts link if 100 * intersection >= percent * union of their sets of different
    `words`-word shingles (A-Z lower-cased, words between blanks; a text of fewer words has one
    shingle of all of them; shingles are told apart by 64-bit hashes).  Texts with equal sets are merged first, however many.

    A null text, or one without words, has the empty set and links with nothing, so its
    component is its own id.  Null ids count as rows of their own and name no component
    (all null: null); rows with repeated ids, or repeated whole, return once each; very long
    texts are taken whole; other columns, of any name, are ignored; an empty table gives an
    empty one.  percent is a whole number above 50, so that light sets share SUBSET shingles.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50, and at most 100")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.md5(text).alias("key"), text.cast("binary").alias("text"))
    marked = written(_signed(texts, words, percent, slot_counts(texts, words)), "signed")
    one = [F.first(c).alias(c) for c in ("n", "prefix", "bits", "subsets", "scanned")]
    sets = marked.where("n > 0").groupBy("same").agg(F.min("key").alias("key"), F.min("doc_id").alias("least"), *one)
    sets = written(sets.withColumn("id", F.monotonically_increasing_id()), "sets")
    # Prefixes and parities take most of the room: what is needed to the end goes without them.
    sizes, names = written(marked.select("doc_id", "same", "n"), "sizes"), written(sets.select("same", "least", "id"), "names")
    removed(marked)
    # The smallest size at which a set with one element more or less reaches the similarity: smaller sets link with equal ones only.
    fewest = next(n for n in range(1, 101) if 100 * n >= percent * (n + 1)) if percent < 100 else None
    found = linked(sets.where(F.col("n") >= fewest), texts, words, percent) if fewest else None
    if not fewest:
        removed(sets)
    if found is not None:
        named = names.join(found, F.col("id") == F.col("node"), "left").select("same", "least", F.coalesce("component", "id").alias("group"))
        named = named.join(named.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("same", "component_id")
    else:
        named = names.select("same", F.col("least").alias("component_id"))
    empty = sizes.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return sizes.where("n > 0").join(named, "same").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(empty)
