"""SimHash fingerprints and their links, by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.graph import components
from quarrymill.llm.scratch import written
from quarrymill.llm.words import small

#: Probe groups up to SMALL list all their pairs; up to LARGE they are walked in one task; beyond, they are linked by midpoints.
SMALL, LARGE = 12, 4096
#: What comparing two fingerprints costs, in rows dealt.
PAIR_COST = 0.02
_CHUNK = 1 << 16


def fingerprints(texts: list[bytes], words: int) -> np.ndarray:
    """64-bit SimHash of each text's word shingles (see simhash_groups)."""
    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    sizes: list[int] = []
    owners: list[int] = []
    digest = xxhash.xxh64_intdigest

    def settle() -> None:
        if not owners:
            return
        h = np.array(hashes, np.uint64)
        starts = np.cumsum(sizes) - sizes
        totals = np.zeros((len(owners), 64), np.int64)
        for at in range(0, len(h), _CHUNK):
            bits = np.unpackbits(h[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first = int(np.searchsorted(starts, at, "right")) - 1
            last = int(np.searchsorted(starts, at + len(bits) - 1, "right"))
            cuts = np.maximum(starts[first:last] - at, 0)
            totals[first:last] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
        ones = 2 * totals > np.array(sizes)[:, None]
        out[owners] = np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()
        hashes.clear(), sizes.clear(), owners.clear()

    for i, text in enumerate(texts):
        tokens = text.lower().split()
        if not tokens:
            continue
        joined = b" ".join(tokens)
        if len(tokens) <= words:
            found = [digest(joined, 42)]
        else:
            ends = np.cumsum([len(t) + 1 for t in tokens])
            first = np.append(0, ends[:-words]).tolist()
            found = [digest(joined[a:b], 42) for a, b in zip(first, (ends[words - 1 :] - 1).tolist())]
        hashes += found
        sizes.append(len(found))
        owners.append(i)
        if len(hashes) > 1 << 18:
            settle()
    settle()
    return out


def _fingerprinted(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            prints = fingerprints(batch["text"].to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(prints.view(np.int64))], ["doc", "print"])

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    return rows.mapInArrow(run, "doc long, print long")


def _bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """The number of prints and, for each two bits, how many prints have both."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64)), 0
        for batch in batches:
            bits = np.unpackbits(batch["print"].to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        i, j = np.divmod(np.arange(4096), 64)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(both.ravel().astype(np.int64)), pa.array(np.full(4096, n))], ["i", "j", "both", "n"])

    rows = prints.select("print").mapInArrow(run, "i long, j long, both long, n long").groupBy("i", "j").agg(F.sum("both"), F.sum("n")).collect()
    both = np.zeros((64, 64))
    for i, j, x, _ in rows:
        both[i, j] = x
    return int(rows[0][3]) if rows else 0, both


def bit_groups(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """64 bits in m parts of nearly equal width; bits that correlate go to the same part."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    strength = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(strength, 0)
    left, parts = set(range(64)), []
    for k in range(m):
        width = (64 * (k + 1)) // m - (64 * k) // m
        rest = sorted(left)
        part = [max(rest, key=lambda b: (strength[b, rest].sum(), -b))]
        left.remove(part[0])
        while len(part) < width:
            best = max(sorted(left), key=lambda b: (strength[b, part].sum(), -b))
            part.append(best)
            left.remove(best)
        parts.append(sorted(part))
    return parts


def _within(p: np.ndarray, most: int) -> np.ndarray:
    """Chance that two prints differ in at most t = 0..most of the bits with these shares of ones."""
    chance = np.zeros(most + 2)
    chance[0] = 1
    for q in 2 * p * (1 - p):
        chance[1:] = chance[1:] * (1 - q) + chance[:-1] * q
        chance[0] *= 1 - q
    return np.cumsum(chance[: most + 1])


def allot(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1: part unused) that sum to `total` at least cost, by dynamic programming.

    costs[p][t + 1] is the cost of threshold t for part p.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in enumerate(row, -1):
                if used + t not in new or cost + c < new[used + t][0]:
                    new[used + t] = (cost + c, [*chosen, t])
        best = new
    return best[total]


def _ball(width: int, t: int) -> int:
    size = term = 1
    for k in range(1, t + 1):
        term = term * (width - k + 1) // k
        size += term
    return size


def plan_parts(prints: DataFrame, bits: int) -> list[tuple[list[int], int]]:
    """Parts and thresholds for linking at up to `bits` differing bits.

    By the generalised pigeonhole principle, thresholds that sum to bits - m + 1 over m
    parts lose no pair.  m is chosen with chances of independent bits; the thresholds then
    by the number of equal values in each part, counted over all prints.
    """
    n, both = _bit_statistics(prints)
    p = np.diag(both) / max(n, 1)

    def costs(parts, chances):
        out = []
        for part, chance in zip(parts, chances):
            row = [0.0]
            for t in range(min(bits, 3) + 1):
                row.append(n * (1 + (_ball(len(part), t) - 1) / 2) + PAIR_COST * n * n / 2 * chance[t])
            out.append(row)
        return out

    options = []
    for m in range(2, bits + 2):
        parts = bit_groups(both, n, m)
        options.append((allot(costs(parts, [_within(p[x], bits) for x in parts]), bits - m + 1)[0], m, parts))
    _, m, parts = min(options, key=lambda o: o[:2])
    keys = F.array(*[F.struct(F.lit(i).alias("part"), _value(part).alias("value")) for i, part in enumerate(parts)])
    counted = prints.select(F.explode(keys).alias("k")).groupBy("k").count()
    equal = {r[0]: r[1] for r in counted.groupBy("k.part").agg(F.sum(F.col("count").cast("double") * F.col("count"))).collect()}
    chances = []
    for i, part in enumerate(parts):
        chance = _within(p[part], bits)
        chances.append(np.minimum(chance / max(chance[0], 1e-300) * (equal.get(i, 0) - n) / max(n * n, 1), 1))
    return list(zip(parts, allot(costs(parts, chances), bits - m + 1)[1]))


def _mask(part: list[int]) -> int:
    mask = sum(1 << b for b in part)
    return mask - 2**64 if mask >= 2**63 else mask


def _value(part: list[int]):
    return F.col("print").bitwiseAND(F.lit(_mask(part)))


def _flips(part: list[int], t: int) -> list[tuple[np.uint64, np.uint64]]:
    """(bits to flip, the lowest of them) for up to t bits of the part."""
    out: list[tuple[np.uint64, np.uint64]] = []
    level = [(0, -1)]
    for _ in range(t):
        level = [(mask | 1 << b, i) for mask, at in level for i, b in enumerate(part) if i > at]
        out += [(np.uint64(mask), np.uint64(mask & -mask)) for mask, _ in level]
    return out


def _probed(prints: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(part, value, print, least): each print under its own value in each part and, up to the part's threshold, under those it would meet there.

    Of two prints that differ in a set of a part's bits, the one with a 0 at the lowest probes.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, least = batch["print"].to_numpy().view(np.uint64), batch["least"].to_numpy()
            for i, (part, t) in enumerate(plan):
                if t < 0:
                    continue
                value = x & np.uint64(sum(1 << b for b in part))
                rows = [(value, x, least)]
                for flip, lowest in _flips(part, t):
                    at = (x & lowest) == 0
                    rows.append((value[at] ^ flip, x[at], least[at]))
                value, prints_, leasts = (np.concatenate(c) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), i, np.int32)), pa.array(value.view(np.int64)), pa.array(prints_.view(np.int64)), pa.array(leasts)], ["part", "value", "print", "least"])

    return prints.mapInArrow(run, "part int, value long, print long, least long")


def _walked(x: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that span the linked sets of x: breadth first, each step against all not yet reached."""
    links, left = [], np.arange(len(x))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(x[left] ^ x[at]) <= bits
            found = left[near].tolist()
            links += [(at, j) for j in found]
            queue += found
            left = left[~near]
    return links


def _verified(bits: int):
    """Rows sorted by (part, value) -> links (a, b) between prints (their `least`); b is null for prints of very large groups."""

    def settle(part, value, x, least):
        new = np.append(True, (value[1:] != value[:-1]) | (part[1:] != part[:-1]))
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(x)))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        small = np.repeat(np.where(size <= SMALL, at + size, 0), size)  # end of a small group
        for lag in range(1, SMALL):
            i = np.flatnonzero(np.arange(lag, len(x) + lag) < small)
            i = i[np.bitwise_count(x[i] ^ x[i + lag]) <= bits]
            a.append(least[i])
            b.append(least[i + lag])
        huge = [np.zeros(0, np.int64)]
        for s, n in zip(at[size > SMALL].tolist(), size[size > SMALL].tolist()):
            if n > LARGE:
                huge.append(x[s : s + n].view(np.int64))
                continue
            links = _walked(x[s : s + n], bits)
            a.append(least[s + np.array([p for p, _ in links], np.int64)])
            b.append(least[s + np.array([q for _, q in links], np.int64)])
        a, b, huge = np.concatenate(a), np.concatenate(b), np.concatenate(huge)
        keep = a != b
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((a[keep], huge))), pa.array(np.concatenate((b[keep], huge)), mask=np.append(np.zeros(keep.sum(), bool), np.ones(len(huge), bool)))], ["a", "b"]
        )

    def very_large(x):
        x = np.concatenate(x).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(x, mask=np.ones(len(x), bool))], ["a", "b"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list = []
        streamed = None  # the group that has outgrown LARGE and goes to the midpoints batch by batch
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch["part"].to_numpy(), batch["value"].to_numpy(), batch["print"].to_numpy().view(np.uint64), batch["least"].to_numpy()]
            if streamed is not None:
                more = (now[0] == streamed[0]) & (now[1] == streamed[1])
                if more.any():
                    yield very_large([now[2][more]])
                    now = [c[~more] for c in now]
                if not len(now[0]):
                    continue
                streamed = None
            if held:
                if (held[-1][1][0], held[-1][0][0]) == (now[1][-1], now[0][-1]):  # one large group goes on
                    held.append(now)
                    if sum(len(h[0]) for h in held) > LARGE:
                        streamed = (now[0][-1], now[1][-1])
                        yield very_large([h[2] for h in held])
                        held = []
                    continue
                now = [np.concatenate([h[c] for h in held] + [now[c]]) for c in range(4)]
                held = []
            cut = int(np.flatnonzero((now[1] != now[1][-1]) | (now[0] != now[0][-1]))[-1]) + 1 if ((now[1] != now[1][-1]) | (now[0] != now[0][-1])).any() else 0
            if cut:
                yield settle(*[c[:cut] for c in now])
            held = [[c[cut:] for c in now]]
        if held:
            yield settle(*[np.concatenate([h[c] for h in held]) for c in range(4)])

    return run


def _midpoint_links(members: DataFrame, prints: DataFrame, bits: int) -> DataFrame:
    """Links among the prints of very large groups, without pairs.

    Two prints differ in at most `bits` bits exactly if some value differs from both in at
    most half of them.  Each print names all such values; those that name the same value
    are linked to the least print among them.
    """
    half = (bits + 1) // 2  # of an odd number the halves overlap by one, so links are checked again below
    flips = np.array([0, *(f for f, _ in _flips(list(range(64)), half))], np.uint64)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                x = batch["print"].to_numpy().view(np.uint64)[at : at + 64]
                least = batch["least"].to_numpy()[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array((x[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(x.view(np.int64), len(flips))), pa.array(np.repeat(least, len(flips)))], ["middle", "print", "least"])

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.select(F.col("a").alias("print")).distinct().join(prints, "print").repartition(n, "print").mapInArrow(run, "middle long, print long, least long")
    hub = rows.groupBy("middle").agg(F.min(F.struct("least", "print")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("hub.print"))) <= bits
    return rows.join(hub, "middle").where("least != hub.least").where(near).select(F.col("hub.least").alias("a"), F.col("least").alias("b")).distinct()


def print_groups(prints: DataFrame, bits: int) -> DataFrame:
    """(print, group) of different fingerprints (print, least): groups are what links at `bits` (an even number) or fewer differing bits connect."""
    if bits % 2:
        raise ValueError("bits must be even")
    plan = plan_parts(prints, bits)
    spark = prints.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    probed = _probed(prints, plan).repartition(n, "part", "value").sortWithinPartitions("part", "value")
    links = written(probed.mapInArrow(_verified(bits), "a long, b long"), "links")
    members = links.where("b is null")
    edges = links.where("b is not null")
    if members.limit(1).count():
        edges = edges.union(_midpoint_links(members, prints, bits))
    found = components(edges)
    return prints.join(found, F.col("print") == F.col("node"), "left").select("print", F.coalesce("component", "print").alias("group"))


def simhash_groups(docs: DataFrame, words: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups: (doc_id, print, component_id) for every row of docs.

    A text is lower-cased (A-Z), split into words (anything but space and 0x09-0x0D) and
    hashed by `words`-word shingles with repeats (XXH64, seed 42); a fingerprint bit is 1
    if set in over half of the hashes.  Fewer words give one hash of all; no words (or a
    null text) give fingerprint 0.  Fingerprints link at `bits` (an even number) or fewer
    differing bits; component_id is the smallest id reachable.

    Equal fingerprints are merged first.  The 64 bits are dealt into parts of correlated
    bits with unequal thresholds (plan_parts), each fingerprint probes the values it could
    meet, and every meeting is verified.  Fingerprints alone link: rows with the same id, or
    with null ids, are documents of their own, each returned with its id, and component_id
    is null where no member has an id.  A very long text is hashed slice by slice; other
    columns, of any name, are ignored.
    """
    if bits % 2:
        raise ValueError("bits must be even")
    marked = written(_fingerprinted(docs, words, id_col, text_col), "prints")
    prints = written(marked.select("print", F.col("print").alias("least")).distinct(), "distinct")
    named = print_groups(prints, bits)
    least = marked.groupBy("print").agg(F.min("doc").alias("doc")).join(named, "print").groupBy("group").agg(F.min("doc").alias("component_id"))
    named = named.join(least, "group").select("print", "component_id")
    return marked.join(named, "print").select(F.col("doc").alias("doc_id"), "print", "component_id")
