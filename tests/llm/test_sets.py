"""The manifest, the Jaccard join and the clusters on small tables of hard rows, held against plain versions."""

import os
import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import centroids, jaccard_join, merkle
from quarrymill.llm.centroids import Tree, clustered
from quarrymill.llm.jaccard_join import jaccard_groups, shingle_sets
from quarrymill.llm.merkle import merkle_manifest, missing

draw = random.Random(11)
WORDS = ["".join(draw.choices("abcdeé", k=draw.randint(1, 7))) for _ in range(200)]


def prose(n):
    return " ".join(draw.choices(WORDS, k=n))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- manifest ----------------------------------------------------------------

H = lambda *parts: sha256("".join(parts).encode()).hexdigest()


def plain_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = {}
    for doc_id, source, lang, n_chars, text in rows:
        other = text
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None:
            other = text.replace("\n", "")
        leaf, changed = (H(*map(enc, (doc_id, source, lang, n_chars, t))) for t in (text, other))
        trees.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, doc_id, changed))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: plain_levels([x[2] for x in sorted(trees[s])]) for s in names}
    top = plain_levels([levels[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for place, (_, _, leaf, doc_id, changed) in enumerate(sorted(trees[s])):
            folded, siblings = changed, []
            for tree, p in ((levels[s], place), (top, at)):
                for row in tree[:-1]:
                    run = row[p // 3 * 3 : p // 3 * 3 + 3]
                    left, right = run[: p % 3], run[p % 3 + 1 :]
                    siblings += left + right
                    folded, p = H(*left, folded, *right), p // 3
            out.append((doc_id, leaf, levels[s][-1][0], top[-1][0], H(*siblings), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def manifest_of(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, place int, node string").repartition(3)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return got(merkle_manifest(docs, tampered=tampered))


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_of_hard_rows(spark, monkeypatch, levels):
    """Sources of 1 to 100 rows, over blocks of 3, 9 and 2187 leaves; nulls, empty and long texts, repeated ids and rows."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = [(i, f"s{i % 4}", "en", i, f"line {i}\nend") for i in range(100)] + [(i, "big", None, None, "a\n" * (i % 3)) for i in range(200, 300)]
    rows += [(None, "s0", "en", 1, "x\ny"), (None, None, None, None, None), (7, None, "é", 2, ""), (7, "s3", "en", 3, "same\n"), (7, "s3", "en", 3, "same\n"), (400, "", "en", 1, "\n" * 200_000), (401, "ß", "de", 1, "größe\n")]
    assert manifest_of(spark, rows) == plain_manifest(rows)


def test_manifest_of_few_rows(spark):
    assert manifest_of(spark, [(1, "a", "en", 3, "abc")]) == plain_manifest([(1, "a", "en", 3, "abc")])
    assert manifest_of(spark, []) == []


def test_a_multiproof_asks_for_nothing_it_can_derive():
    assert missing([0, 1, 2], 3) == [] and missing(list(range(10)), 10) == []
    assert missing([0], 10) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1)]
    assert missing([0, 1, 4], 10) == [(0, 2), (0, 3), (0, 5), (1, 2), (2, 1)]


# -- Jaccard join ------------------------------------------------------------


def plain_groups(rows, words=4, percent=85):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                up[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    return sorted(((d, len(s), least.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def near_rows():
    rows, doc_id = [(None, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (None, "one"), (5, "a b c"), (6, "a b c d"), (None, "only null"), (7, "w" * 100 + " x y z q"), (7, "w" * 101 + " x y z q")], 100
    for length in (9, 11, 14, 30, 90, 400, 3000):
        base = prose(length).split()
        for edits in (0, 0, 1, 1, 2, 3, length // 40, length // 20, length // 10):
            words = list(base)
            for _ in range(edits):
                words[draw.randrange(len(words))] = draw.choice(WORDS)
            cut = draw.randint(0, 2)
            rows.append((doc_id * 7 % 1009, " ".join(words[cut:])))
            doc_id += 1
    license_line = prose(60)
    rows += [(2000 + i, f"{prose(25)} {license_line} {prose(25)}") for i in range(30)]
    rows += [(3000 + i, " ".join([license_line, *draw.sample(WORDS, 3)])) for i in range(40)]
    return rows + rows[-3:]


@pytest.mark.parametrize("heavy", [None, 2, 40, 10_000])
def test_jaccard_groups_equal_brute_force(spark, monkeypatch, heavy):
    """With the boundary by cost, all sets heavy, a mix, and all sets light."""
    if heavy:
        monkeypatch.setattr(jaccard_join, "light_below", lambda sets: heavy)
    draw.seed(5)
    rows = [r for r in near_rows() if heavy != 10_000 or len((r[1] or "").split()) < 500]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, id int, key string, n int").repartition(3)
    assert got(jaccard_groups(docs)) == plain_groups(rows)


def test_a_large_group_of_near_copies_is_one_component(spark):
    """All differ from one another; lists are compared in turns."""
    draw.seed(6)
    base = prose(200).split()
    rows = []
    for i in range(150):
        words = list(base)
        words[draw.randrange(200)] = f"own{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(jaccard_groups(docs)) == plain_groups(rows)


def test_other_thresholds_and_no_rows(spark):
    draw.seed(7)
    rows = near_rows()[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert got(jaccard_groups(docs, words=2, percent=60)) == plain_groups(rows, 2, 60)
    assert got(jaccard_groups(docs, percent=100)) == plain_groups(rows, 4, 100)
    assert got(jaccard_groups(docs.limit(0))) == []
    with pytest.raises(ValueError):
        jaccard_groups(docs, percent=50)


def test_long_words_that_differ_far_in_are_different():
    a, b = (f"{'x' * 64}{t} b c d e f g".encode() for t in ("ab", "ba"))
    first, second = shingle_sets([a, b], 4)
    assert len(first) == len(second) == 4 and len(np.intersect1d(first, second)) == 3


# -- clusters ----------------------------------------------------------------


def plain_clusters(rows, k, rounds):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v):
            q = [int(min(max(np.floor(256 * np.float64(np.float32(x))), -(2.0**27)), 2.0**27)) for x in v]
            kept.append((vec_id, q))
    points = [q for _, q in sorted(kept, key=lambda r: (H(f"2:{'' if r[0] is None else r[0]}"), r[1]))[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda: [min((square(q, c), i) for i, c in enumerate(points)) for _, q in kept]
    for _ in range(rounds):
        found = near()
        for i in range(len(points)):
            own = [q for (_, q), (_, c) in zip(kept, found) if c == i]
            if own:
                points[i] = [sum(x) // len(own) for x in zip(*own)]
    found = near()
    per = {i: sum(d for d, c in found if c == i) for i in range(len(points))}
    fits = lambda x: x if x < 2**63 else None
    return sorted(((v, c, d, fits(per[c]), fits(sum(per.values())), points[c]) for (v, _), (d, c) in zip(kept, found)), key=repr)


def clusters_of(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, cluster int, q string").repartition(3)
    return got(clustered(df, **more))


def hard_vectors():
    noise = np.random.default_rng(4)
    rows = [(i, (noise.normal(0, 1, 64) + 3 * (i % 5)).astype(np.float32).tolist()) for i in range(120)]
    rows += [(i, rows[3][1]) for i in range(200, 260)] + [(260, [0.0] * 64), (261, [-0.001] * 64), (None, rows[5][1]), (None, rows[6][1]), (4, rows[7][1]), (4, rows[7][1])]
    return rows + [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [1.0] * 63 + [None]), (305, [1.0] * 63 + [float("nan")]), (306, [1.0] * 63 + [float("-inf")])]


@pytest.mark.parametrize("k", [1, 7, 40])
def test_clusters_equal_brute_force(spark, k):
    assert clusters_of(spark, hard_vectors(), k=k, rounds=3) == plain_clusters(hard_vectors(), k, 3)


def test_clusters_of_few_huge_and_no_vectors(spark):
    rows = [(1, [3.0e38] * 64), (2, [-3.0e38] * 64), (3, [0.5] * 64)]
    assert clusters_of(spark, rows, k=2, rounds=2) == plain_clusters(rows, 2, 2)
    assert clusters_of(spark, rows[2:], k=40) == plain_clusters(rows[2:], 40, 5)
    assert clusters_of(spark, hard_vectors()[-7:]) == []
    assert clusters_of(spark, []) == []


def test_the_tree_finds_the_nearest_point_and_the_smaller_number_on_ties():
    noise = np.random.default_rng(8)
    points = noise.integers(-6, 6, (90, 3))
    points[50:60] = points[:10]
    vectors = noise.integers(-9, 9, (3000, 3))
    away = ((vectors[:, None, :] - points[None]) ** 2).sum(axis=2)
    number, best = Tree.of(points).nearest(vectors)
    assert (best == away.min(axis=1)).all() and (number == away.argmin(axis=1)).all()


def test_the_tree_leaves_points_out():
    """Far groups of points: most leaves are never opened."""
    met = []
    noise = np.random.default_rng(9)
    points = np.concatenate([noise.integers(0, 50, (16, 4)) + 10_000 * g for g in range(4)])
    tree = Tree.of(points)
    plain = centroids.squared
    try:
        centroids.squared = lambda a, b: met.append(len(a)) or plain(a, b)
        tree.nearest(points[:16] + 1)
    finally:
        centroids.squared = plain
    assert sum(met) < 16 * len(points) / 2


def test_jaccard_groups_keep_little_on_disk(spark, monkeypatch):
    """Prefixes go once they are dealt out, and texts in no pair stay where they are read."""
    from quarrymill import storage

    tables, left = [], []

    def write(df, name):
        if name == "candidates":
            left.append({n for n, t in tables if os.path.exists(t)})
        table = storage.written(df, name)
        tables.append((name, table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]))
        return table

    monkeypatch.setattr(jaccard_join, "written", write)
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1])), (3, " ".join(words[::-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["component_id"] for r in jaccard_groups(docs).collect()) == [1, 1, 3]
    assert left and not {"signed", "sets"} & left[0]
    keys = spark.createDataFrame([(f"k{i}",) for i in range(0, 1000, 10)], "key string")
    passed = {r["key"] for r in spark.range(1000).select(F.format_string("k%d", "id").alias("key")).where(jaccard_join._maybe_among(keys)).collect()}
    assert {f"k{i}" for i in range(0, 1000, 10)} <= passed and len(passed) < 110
