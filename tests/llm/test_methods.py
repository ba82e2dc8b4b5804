"""The methods behind the operators: what decides beside the fixed rules, and how well."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrymill.llm import quality
from quarrymill.llm.language_id import languages
from quarrymill.llm.mixing import mix_sources, mixed_corpus
from quarrymill.llm.pii import learned_contexts, base_matches, personal_data
from quarrymill.llm.scratch import written
from quarrymill.llm.secret_scan import generated_strings, secret_spans, trained_models
from quarrymill.llm.substring_dedup import FMIndex, WaveletTree, matching_statistics
from tests.llm import brute
from tests.llm.test_operators import ITEMS, ROWS, TEXTS, docs, prose  # noqa: F401

DATA = "/root/testdata/sf0.01"


def test_wavelet_rank():
    draw = np.random.default_rng(2)
    for n_symbols in (1, 2, 5, 33):
        symbols = draw.integers(0, n_symbols, 300)
        tree = WaveletTree(symbols, n_symbols)
        at = draw.integers(0, 301, 50)
        for s in range(n_symbols):
            assert tree.rank(np.full(50, s), at).tolist() == [int((symbols[:a] == s).sum()) for a in at]


def test_backward_search_and_matching_statistics():
    draw = np.random.default_rng(3)
    parts = [draw.integers(1, 4, draw.integers(1, 40)) for _ in range(12)]
    text = np.concatenate([np.append(p, 0) for p in parts])
    index = FMIndex(text, 4)
    for pattern in ([1], [2, 3], [1, 1, 2], [3, 2, 1, 1]):
        low, high = np.array([0]), np.array([index.n])
        for s in reversed(pattern):
            low, high = index.extended(np.array([s]), low, high)
        found = sum(p[i : i + len(pattern)].tolist() == pattern for p in parts for i in range(len(p)))
        assert int(high[0] - low[0]) == found
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    begins = ends - np.array([len(p) for p in parts])
    got = matching_statistics(index, np.ones(len(text), np.int64), text, begins, ends)
    whole = [tuple(p.tolist()) for p in parts]
    for b, p in zip(begins, whole):
        for i in range(len(p)):
            best = max(k for k in range(len(p) - i + 1) if k == 0 or sum(q[j : j + k] == p[i : i + k] for q in whole for j in range(len(q) - k + 1)) >= 2)
            assert got[b + i] == best


def test_token_figures():
    """Each figure against a plain count over the vocabularies' own encoders."""
    held = []
    for path in quality.VOCABULARIES:
        with open(path, "rb") as file:
            held.append((path, file.read()))
    tokens = quality.Tokens(held)
    texts = [(t or "").encode() for t in TEXTS] + ["a\u00a0b \u2581c \u200b x\u3000y".encode(), "漢字 かな 한국어 नमस्ते".encode()]
    got = quality._measured(texts, tokens)
    for d, raw in enumerate(texts):
        words = [w.decode() for w in raw.split()]
        for m, model in enumerate(tokens.models):
            ids = [i for w in words for i in model.alone(w)]
            count = Counter(ids)
            entropy = math.log2(len(ids)) - sum(c * math.log2(c) for c in count.values()) / len(ids) if ids else 0.0
            assert got["n_tokens"][d, m] == len(ids) and got["n_byte_tokens"][d, m] == sum(model.single[i] for i in ids)
            assert abs(got["entropy"][d, m] - entropy) < 1e-9
    assert quality.SCRIPTS[got["script"][-1]] in ("cjk", "hangul", "indic") and quality.SCRIPTS[got["script"][3]] == "latin"


def test_windows_with_equal_hashes_are_compared(monkeypatch):
    draw = random.Random(1)
    codes = np.array([draw.randrange(3) for _ in range(200)])
    doc = np.repeat([0, 1, 2, 3], [90, 4, 56, 50])
    want = quality._repeated(codes, doc)
    monkeypatch.setattr(quality, "kgram_hashes", lambda c, k: np.zeros(len(c) - k + 1, np.uint64))
    assert (quality._repeated(codes, doc) == want).all() and 0 < want.sum() < 200


def test_bands_decide(spark):
    """On the given tables bands fitted on good rows reject most junk that the base rules let through, and few good rows."""
    documents, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    bands = quality.fitted_bands(documents, labels, least=20)
    assert any(g.startswith("lang:") for g in bands) and "script:latin" in bands
    rows = quality.judged(documents, bands).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.985 and kept[0] < 0.35
    # a verdict by hand: fertility, byte share and entropy of every vocabulary within the band of the language
    for r in quality.judged(documents, bands).join(documents.select("doc_id", "lang"), "doc_id").limit(300).collect():
        good = True
        for m, b in enumerate(bands.get(f"lang:{r.lang}") or bands.get(f"script:{r.script}") or quality.WIDE):
            n = max(r.n_tokens[m], 1)
            good &= b.low <= r.word_chars / n <= b.high and r.n_byte_tokens[m] / n <= b.byte_share
            good &= n < quality.MIN_TOKENS or r.entropy[m] / min(math.log2(n), 8.0) >= b.entropy_share
        assert r.kept == (good and not r.base_failed)


def test_bands_without_labels(spark):
    documents = spark.createDataFrame([(1, prose(30), "xx"), (None, None, None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fitted_bands(documents, none) == {}
    assert sorted(str(r.kept) for r in quality.judged(documents, {}).collect()) == ["False", "True"]


def test_secret_models(spark):
    """Threshold from held-out samples; keys of every alphabet are found, identifiers and words are not."""
    draw = random.Random(9)
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    models = trained_models(documents)
    assert models.found > 0.98 and models.false_share <= 0.0011
    keys = generated_strings(300, seed=77)
    names = ["getElementByIdentifierName", "MAX_NUMBER_OF_RETRIES_ALLOWED", "some-long-kebab-case-name", "path/to/the/source/directory", "_" * 40, "x" * 60, "internationalisationframework"]
    rows = [(i, f"{prose(3)} {k} {prose(3)}") for i, k in enumerate(keys)] + [(1000 + i, f"the {n} here") for i, n in enumerate(names)] + [(None, None), (2000, ""), (2001, keys[6]), (2001, keys[6])]
    found = [(r.doc_id, [s for s in r.spans if s.kind in ("random", "hex", "access")]) for r in secret_spans(spark.createDataFrame(rows, "doc_id long, text string"), models).collect()]
    assert len(found) == len(rows)
    hit = {d for d, s in found if s and d is not None}
    assert sum(i in hit for i in range(300)) >= 290
    assert not [d for d in hit if 1000 <= d < 2000]
    # what the corpus's size is does not move the verdicts
    doubled = trained_models(documents.union(documents).union(documents))
    assert abs(doubled.threshold - models.threshold) < 0.1 and np.abs(doubled.ratio - models.ratio)[1:, 1:].max() < 0.01


def test_unseen_identifiers_are_found(spark):
    """Planted contexts before and after; recall and precision on identifiers of a form that no pattern knows."""
    draw = random.Random(6)
    said = [("my phone number is {} thanks", 0), ("call me at {} today", 0), ("{} is my number", 0), ("reach her under {} or", 0)]
    rows, planted = [], {}
    for i in range(400):
        form = said[i % 4][0]
        value = f"+1 555 {draw.randrange(100, 999)} {draw.randrange(1000, 9999)}" if i < 200 else "".join(draw.choices("ABCDEFGH0123456789", k=4)) + "-" + str(draw.randrange(10**5, 10**6))
        head = prose(draw.randint(3, 60)) + " "
        rows.append((i, head + form.format(value) + " " + prose(5)))
        if i >= 200:
            start = len(head) + form.index("{}")
            planted[i] = (start, start + len(value))
    for i in range(400, 500):  # part numbers after ordinary words, and numbers in lists
        rows.append((i, f"{prose(10)} the part number X{draw.randrange(10**6)}-9 is in stock of the {draw.randrange(10**9, 10**10)} {prose(5)}"))
    # frequent words that meet many seeds are no context
    rows += [(600 + i, "of the " * 30 + f"of the +1 555 010 {1000 + i} {prose(3)}") for i in range(30)] + [(700, f"of the ABC-12345 {prose(3)}")]
    rows += [(None, rows[250][1]), (250, rows[250][1]), (None, None), (801, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = [(r.doc_id, {(s.start, s.end) for s in r.spans if s.kind == 4}) for r in personal_data(table).collect()]
    assert len(found) == len(rows)
    by_id = dict((d, s) for d, s in found if d is not None)
    recall = sum(span in by_id[d] for d, span in planted.items()) / len(planted)
    assert recall >= 0.9
    assert {i: (by_id[i], dict((r[0], r[1]) for r in rows if r[0] == i)) for i in [*range(400, 500), *range(600, 630), 700] if by_id[i]} == {}
    assert [s for d, s in found if d is None].count(set()) == 1  # a null id's text is scanned like others


def test_one_longer_context_does_not_count_as_another(spark):
    """Contexts are whole words, however long, with whatever stands before them."""
    long_a, long_b = "x" * 200 + "a", "y" * 100 + "x" * 100 + "a"
    rows = [(i, f"{prose(3)} {long_a} number +1 555 010 {1000 + i} {prose(4)}") for i in range(10)]
    rows += [(50, f"w {long_a} number ABC-4321 {prose(3)}"), (51, f"w {long_b} number ABC-4321 {prose(3)}")]
    found = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == 4] for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found[50]) == 1 and found[51] == []


def test_many_matches_in_one_text(spark):
    """Places are summed block by block; a text with thousands of matches gives them all."""
    text = " ".join(f"é{i}@b.c 10.0.{i % 300}.1" for i in range(3000))
    matches = personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    assert [(s.start, s.kind, s.end) for s in matches if s.kind < 4] == brute.op9(text)
    none = base_matches(spark.createDataFrame([(1, prose(50))], "doc_id long, text string"))
    assert learned_contexts(written(none, "none"), none.withColumn("text", F.lit("x"))) is None


def test_languages_on_held_out_rows(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = languages(documents).join(documents.select(F.col("doc_id").alias("id"), "lang", "text"), F.col("doc_id") == F.col("id")).where("held_out and lang is not null and lang_pred != 'und'").collect()
    assert len(rows) > 100 and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97


def test_another_seed_draws_another_mix(spark, docs):  # noqa: F811
    plain = docs.select("doc_id", "text", "source")
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    a, b = (Counter(map(key, mix_sources(plain, block=16, shard_slots=32, seed=s).collect())) for s in (7, 8))
    assert a != b and sum(x[3] * n for x, n in a.items()) == sum(x[3] * n for x, n in b.items())
    # taken is what the drawn slots hold
    mix = mixed_corpus(plain, block=16, shard_slots=32).collect()
    held = Counter((str(r.doc_id), str(r.source)) for r in mix for _ in range(r.n_words))
    want = Counter()
    for (d, s, _, taken), n in a.items():
        want[d, s] += taken * n
    assert held == +want
    # every shard but the last is full, before slots beyond a target fall away
    shards = Counter((r.shard, r.place) for r in mix)
    assert max(Counter(s for s, _ in shards).values()) > 16


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_hard_rows(spark, docs, tmp_path, name, stage):  # noqa: F811
    """Nulls, empty and long texts, repeated rows and clashing columns; and an empty table."""
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    hard = docs.union(docs.withColumn("doc_id", F.lit(None).cast("long")).limit(4)).union(docs.limit(1).withColumn("text", F.repeat(F.lit("word and more "), 100_000)))
    out = stage(spark, hard, str(tmp_path)).collect()
    empty = stage(spark, hard.limit(0), str(tmp_path))
    assert empty.collect() == []
    if name != "mixing":
        assert empty.columns == hard.columns and 0 < len(out) <= len(ROWS) + 5


def _pipeline(rows, items, good):
    """Brute force: ids and texts after the stages before mixing; `good` are the rows that the bands keep."""
    kept = [r for r in rows if good[r[0]] and not brute.op6(r[1])[-1]]
    owners = {}
    key = lambda x: brute.lower(x.strip(brute.BLANKS))
    for d, t in kept:
        for x in t.split("\n"):
            owners.setdefault(key(x), set()).add(d)
    drop = lambda d, x: len(key(x)) >= 20 and len(owners[key(x)]) >= 3 and max(owners[key(x)]) != d
    kept = [(d, "\n".join(x for x in t.split("\n") if not drop(d, x))) for d, t in kept]
    from tests.llm.test_findings import _groups

    kept = [min(kept[i] for i in g) for g in _groups(kept)]
    out = []
    from quarrymill.llm.decontaminate import without_hits

    size = 10
    words = lambda t: brute.re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(t or ""))
    windows = {tuple(w[i : i + size]) for _, t in items for w in [words(t)] for i in range(max(len(w) - size + 1, 1)) if w}
    for d, t in kept:
        w = words(t)
        hit = bytearray(len(w))
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit[i : i + n] = b"\1" * n
        if sum(hit) > 0.5 * len(w):
            continue
        starts = [i for i in range(len(w)) if hit[i] and not (i and hit[i - 1])]
        ends = [i + 1 for i in range(len(w)) if hit[i] and not (i + 1 < len(w) and hit[i + 1])]
        out.append((d, without_hits(t.encode(), starts, ends).decode()))
    return sorted(out)


def test_pipeline_against_brute_force(spark, tmp_path):
    """All stages on the small tables: the kept rows and texts, and the words that the mix takes."""
    small = "/root/testdata/sf0.001"
    documents, labels, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    bands = quality.fitted_bands(documents, labels)
    good = {r.doc_id: r.kept or r.base_failed for r in quality.judged(documents, bands).collect()}
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    sources = {r.doc_id: r.source for r in documents.collect()}
    want = _pipeline(rows, [tuple(r) for r in items.select("item_id", "text").collect()], good)
    table = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = written(stage(spark, table, small), name)
    assert sorted((r.doc_id, r.text) for r in table.collect()) == want
    mix = corpus_pipeline.run(spark, small).collect()
    total = sum(brute.op6(t)[0] for _, t in want)
    assert abs(sum(r.n_words for r in mix) - 1.5 * total) <= len(set(sources.values()))
    texts = dict(want)
    for r in mix:
        words = brute.re.findall(brute.WORD, texts[r.doc_id])
        assert brute.re.findall(brute.WORD, r.text) == words[r.first_word : r.first_word + r.n_words] and r.source == sources[r.doc_id]
    taken = Counter()
    for r in mix:
        taken[r.doc_id] += r.n_words
    assert all(n <= 2 * brute.op6(texts[d])[0] for d, n in taken.items())
