"""What a review found missing: each test fails on the code before."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline

from quarrymill.llm.mixing import mix_sources, mixed_corpus
from quarrymill.llm.line_dedup import line_dedup
from quarrymill.llm.pii import personal_data, word_pairs
from quarrymill.llm.simhash import simhash_groups
from tests.llm import brute
from tests.llm.test_operators import ROWS


def test_the_mix_itself(spark):
    rows = [(d, t, None if i % 5 == 0 else f"s{i % 3}") for i, (d, t) in enumerate(ROWS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    mix = mixed_corpus(docs, block=16, shard_slots=32).collect()
    counted = mix_sources(docs, block=16, shard_slots=32).collect()
    words = lambda t: brute.re.findall(brute.WORD, t or "")
    # every piece is the words of its document that it says, and slots are whole blocks of one source
    texts = defaultdict(list)
    for d, t, s in rows:
        texts[d, s].append(words(t))
    slots = defaultdict(list)
    for r in mix:
        assert any(words(r.text) == w[r.first_word : r.first_word + r.n_words] for w in texts[r.doc_id, r.source])
        slots[r.shard, r.place].append(r)
    for pieces in slots.values():
        pieces.sort(key=lambda r: r.start)
        assert len({(r.source, r.block_no) for r in pieces}) == 1 and sum(r.n_words for r in pieces) <= 16
        assert all(a.start + a.first_word + a.n_words == b.start + b.first_word for a, b in zip(pieces, pieces[1:]))
    # a source's words meet its target, and its slots are spread over the shards like a multinomial draw
    taken = Counter()
    for r in mix:
        taken[r.source] += r.n_words
    assert taken == {r.source: round(r.target) for r in counted}
    assert sum(r.taken for r in counted) == sum(taken.values())
    n, shards = len(slots), Counter(s for s, _ in slots)
    assert len(shards) > 8 and all(0 <= p < 40 for _, p in slots)  # the correction adds a few slots to a shard
    own = Counter(p[0].source for p in slots.values())
    here = Counter((s, p[0].source) for (s, _), p in slots.items())
    for s, size in shards.items():
        for source, m in own.items():
            mean = size * m / n
            assert abs(here[s, source] - mean) <= 5 * (mean * (1 - m / n)) ** 0.5 + 1
    again = mixed_corpus(docs.repartition(2), block=16, shard_slots=32).collect()
    assert sorted(map(str, again)) == sorted(map(str, mix))


def _shingles(text, words=5):
    w = brute.re.findall(brute.WORD, brute.lower(text or ""))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or {tuple(w)}


def _groups(rows, similarity=0.8):
    """Brute force: row numbers of each group of near copies."""
    sets, group = [_shingles(t) for _, t in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) >= similarity * len(x | y) and group[i] != group[j]:
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    out = defaultdict(list)
    for i, g in enumerate(group):
        out[g].append(i)
    return list(out.values())


def test_near_copies_with_edited_words(spark):
    draw = random.Random(8)
    rows = []
    for base in range(60):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randint(40, 150))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(draw.randint(0, 3)):
            words = list(words)
            for _ in range(draw.randint(1, 3)):
                words[draw.randrange(len(words))] = "edited"
            rows.append((len(rows), " ".join(words)))
    # rows without ids: A copies a row with an id, C another, B none; and rows repeated whole
    rows += [(None, rows[0][1]), (None, rows[9][1]), (None, "of its own " * 3 + "kind"), (None, "twice " * 12), (None, "twice " * 12), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    order = lambda r: (r[0] is None, r[0] or 0)
    groups = _groups(rows)
    assert len(groups) < len(rows) - 40
    want = [min((rows[i] for i in g), key=order) for g in groups]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_null_ids_stay_apart(spark):
    draw = random.Random(4)
    texts = [" ".join(f"v{draw.randrange(9000)}" for _ in range(50)) for _ in range(5)]
    rows = [(5, texts[0]), (9, texts[1]), (None, texts[0]), (None, texts[2]), (None, texts[1]), (None, texts[3]), (None, texts[3]), (2**63 - 1, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = Counter((r.doc_id, r.component_id, r.print) for r in simhash_groups(docs).collect())
    print_of = lambda t: brute.fingerprint(t) - (brute.fingerprint(t) >> 63 << 64)
    want = [(5, 5, 0), (9, 9, 1), (None, 5, 0), (None, None, 2), (None, 9, 1), (None, None, 3), (None, None, 3), (2**63 - 1, 2**63 - 1, 4)]
    assert found == Counter((d, c, print_of(texts[i])) for d, c, i in want)


def test_lines_of_null_ids_are_counted(spark):
    line = "a line that many documents share"
    rows = [(1, f"{line}\none"), (None, f"{line}\ntwo"), (None, f"{line}\nthree"), (None, f"{line}\nthree"), (None, "other"), (2**63 - 1, f"only here: {line}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = line_dedup(docs).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(d) for d, _ in rows)
    kept = [r.kept.split("\n")[-1] for r in out]
    assert sorted(kept) == sorted(t.split("\n")[-1] for _, t in rows)
    assert sum(r.kept.startswith(line) for r in out) == 1 and sum(r.n_dropped for r in out) == 3
    assert all(r.n_dropped for r in out if r.doc_id == 1)  # null ids come last


def _contexts(found):
    return {r.doc_id: sorted((s.start, s.end) for s in r.spans if s.kind == 4) for r in found.collect()}


def _planted(n_mails):
    draw = random.Random(21)
    words = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(400)]
    prose = lambda n: " ".join(draw.choices(words, k=n))
    rows = [(i, f"{prose(6)} reach me under +1 555 {100 + i} {2000 + i} {prose(4)}") for i in range(20)]
    rows += [(100 + i, f"{prose(6)} reach me under QX-{1000 + i} {prose(4)}") for i in range(10)]
    return rows + [(1000 + i, f"{prose(3)} user{i}@mail{i % 7}.org {prose(3)}") for i in range(n_mails)]


def test_what_a_context_finds_does_not_depend_on_the_corpus_size(spark):
    for n in (0, 5_000, 30_000):
        found = _contexts(personal_data(spark.createDataFrame(_planted(n), "doc_id long, text string").repartition(4)))
        assert [len(found[100 + i]) for i in range(10)] == [1] * 10, n


def test_what_a_context_finds_does_not_depend_on_the_order_of_rows(spark):
    phones = [f"+1 555 010 {2000 + i}" for i in range(8)]
    directory = (0, " . ".join(f"reach me under {p}" for p in phones))
    rows = [(i + 1, f"w{i} reach me under {p} v{i}") for i, p in enumerate(phones)] + [(50, "a reach me under QX-1000 b")]
    found = [_contexts(personal_data(spark.createDataFrame(r, "doc_id long, text string").coalesce(1))) for r in ([directory, *rows], [*rows, directory])]
    assert found[0] == found[1] and len(found[0][50]) == 1
    # copies of one text are one text
    alone = [(i, directory[1]) for i in range(20)] + [(50, rows[-1][1])]
    assert _contexts(personal_data(spark.createDataFrame(alone, "doc_id long, text string")))[50] == []
    again = _contexts(personal_data(spark.createDataFrame(_planted(200), "doc_id long, text string").repartition(1)))
    assert again == _contexts(personal_data(spark.createDataFrame(_planted(200)[::-1], "doc_id long, text string").repartition(7)))


def test_pairs_are_counted_whole(spark):
    """Also where the marks of few bits let other pairs pass."""
    texts = ["of the of the 12 of", "Of  THE\nend", None, "", "the of"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    wanted = spark.createDataFrame([("of the",), ("^ ^",), ("the $",), ("the 00",), ("nowhere here",)], "pair string")
    for bits in (64, 1 << 18):
        assert {r.pair: r.times for r in word_pairs(docs, wanted, bits=bits).collect()} == {"of the": 3, "^ ^": 5, "the 00": 1}


def test_fingerprints_name_near_copies(spark, monkeypatch):
    """Near copies are candidates by linked fingerprints alone, where no band of MinHash values may find them."""
    from quarrymill.llm import near_copies

    draw = random.Random(3)
    words = [f"w{draw.randrange(5000)}" for _ in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:200], "edited", *words[201:]])), (3, " ".join(f"x{i}" for i in range(400)))]
    assert bin(brute.fingerprint(rows[0][1]) ^ brute.fingerprint(rows[1][1])).count("1") <= 4
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    only_first = lambda sets, *a: found(sets.withColumn("bands", F.slice("bands", 1, 1)), *a)
    found = near_copies.linked
    monkeypatch.setattr(near_copies, "linked", only_first)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_stages_leave_few_tables(spark):
    """What a stage needs no more is removed: only what its lazy result reads may stay."""
    import glob

    from quarrymill.storage import shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    docs = spark.createDataFrame([(i, f"a line that is shared by many\nline of {i % 7} own words here {i % 3}") for i in range(40)], "doc_id long, text string")
    before = set(glob.glob(f"{folder}/*"))
    line_dedup(docs).collect()
    corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    left = {p.rsplit("/", 1)[1].split("-")[0] for p in set(glob.glob(f"{folder}/*")) - before}
    assert not left & {"keys", "common", "signed", "sets", "bands", "pairs", "candidates", "similar", "open"}
