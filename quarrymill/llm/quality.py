"""Quality rules: counts of words, symbols and repeats, and how well public tokenisers fit the text."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrymill.llm.anchors import kgram_hashes, mix64
from quarrymill.llm.words import small

#: A sentencepiece model with byte fallback, and byte ranks made for many languages.
VOCABULARIES = ("/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: how texts are cut before byte ranks apply.
RANKS_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CHUNK = 1 << 21
#: Words whose tokens a task remembers; it starts afresh beyond.
_REMEMBERED = 100_000
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

SCRIPTS = ("none", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "cjk", "hangul", "other")
#: Script by the first byte of a character (fixed by UTF-8 and the order of the blocks).
_FIRST_BYTE = {"latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCB)], "greek": [0xCD, 0xCE, 0xCF], "cyrillic": range(0xD0, 0xD5), "hebrew": [0xD6, 0xD7], "arabic": range(0xD8, 0xDC), "indic": [0xE0], "cjk": range(0xE3, 0xEA), "hangul": range(0xEA, 0xEE), "other": [0xCB, 0xCC, 0xD5, 0xDC, 0xDD, 0xDE, 0xDF, 0xE1, 0xE2, 0xEE, 0xEF, 0xF0, 0xF1, 0xF2, 0xF3, 0xF4]}
_SCRIPT_OF = np.zeros(256, np.int64)
for _name, _bytes in _FIRST_BYTE.items():
    _SCRIPT_OF[list(_bytes)] = SCRIPTS.index(_name)

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, n_tokens array<long>, n_byte_tokens array<long>, entropy array<double>"


@dataclass(frozen=True)
class Band:
    """What is kept under one vocabulary: characters per token between low and high, at most byte_share of the tokens
    single bytes, and a token entropy of at least entropy_share of what the number of tokens allows."""

    low: float
    high: float
    byte_share: float
    entropy_share: float


#: Where nothing was learned: bounds that only text foreign to both vocabularies crosses.
WIDE = (Band(0.25, 9.0, 1.0, 0.2), Band(0.25, 9.0, 1.0, 0.2))
#: Texts of fewer tokens are too short to judge by entropy.
MIN_TOKENS = 64


class _Sentencepiece:
    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = self.model.get_piece_size()
        self.single = np.array([self.model.is_byte(i) for i in range(n)])
        self.first = np.array([self.model.id_to_piece(i).startswith("▁") for i in range(n)])

    def joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words and where each word's begin; every word's first token starts with the space mark."""
        ids = np.array(self.model.encode(" ".join(words)), np.int64)
        return ids, np.flatnonzero(self.first[ids])

    def alone(self, word: str) -> list[int]:
        return self.model.encode(word)


class _Ranks:
    def __init__(self, data: bytes):
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}
        self.model = tiktoken.Encoding("ranks", pat_str=RANKS_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.single = np.zeros(max(ranks.values()) + 1, bool)
        self.single[[rank for token, rank in ranks.items() if len(token) == 1 and token[0] >= 128]] = True
        self.newline = ranks[b"\n"]

    def joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.model.encode_ordinary("\n".join(words)), np.int64)
        cut = ids == self.newline
        starts = np.append(0, np.flatnonzero(cut) + 1)
        return ids[~cut], starts - np.arange(len(starts))

    def alone(self, word: str) -> list[int]:
        return self.model.encode_ordinary(word)


class Tokens:
    """Token ids of words, each word by itself, under several vocabularies given as (path, content)."""

    def __init__(self, vocabularies: list[tuple[str, bytes]]):
        self.models = [_Ranks(data) if path.endswith(".tiktoken") else _Sentencepiece(data) for path, data in vocabularies]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = [np.zeros(0, np.int64) for _ in self.models]
        self.counts = [np.zeros(0, np.int64) for _ in self.models]

    def learn(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words in ids and counts."""
        if len(self.known) > _REMEMBERED:
            self._forget()
        new = [w for w in words if w not in self.known]
        # blanks and marks inside a word would look like borders of words: such words are taken one by one
        texts = [w.decode("utf-8", "replace") for w in new]
        plain = [t.isprintable() and "▁" not in t for t in texts]
        new = [w for w, p in zip(new, plain) if p] + [w for w, p in zip(new, plain) if not p]
        odd = [t for t, p in zip(texts, plain) if not p]
        texts = [t for t, p in zip(texts, plain) if p]
        for m, model in enumerate(self.models):
            ids, counts = [self.ids[m]], [self.counts[m]]
            for at in range(0, len(texts), 4096):
                part = texts[at : at + 4096]
                got, starts = model.joined(part)
                if len(starts) != len(part):
                    each = [model.alone(t) for t in part]
                    got, size = np.array([i for e in each for i in e], np.int64), np.array([len(e) for e in each])
                else:
                    size = np.diff(np.append(starts, len(got)))
                ids.append(got)
                counts.append(size)
            each = [model.alone(t) for t in odd]
            ids.append(np.array([i for e in each for i in e], np.int64))
            counts.append(np.array([len(e) for e in each], np.int64))
            self.ids[m], self.counts[m] = np.concatenate(ids), np.concatenate(counts)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        return np.array([self.known[w] for w in words], np.int64)


def _repeated(codes: np.ndarray, doc: np.ndarray, size: int = 5) -> np.ndarray:
    """Which words lie in a window of `size` words that stands twice or more in its text; equal hashes are compared word by word."""
    edge = np.zeros(len(doc) + 1, np.int64)
    at = np.flatnonzero(doc[size - 1 :] == doc[: len(doc) - size + 1]) if len(doc) >= size else np.zeros(0, np.int64)
    if len(at):
        key = kgram_hashes(codes, size)[at] ^ mix64(doc[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        tie = np.flatnonzero(key[order][1:] == key[order][:-1])
        left, right = at[order[tie]], at[order[tie + 1]]
        same = doc[left] == doc[right]
        for j in range(size):
            same &= codes[left + j] == codes[right + j]
        if not same.all():  # hashes of different windows met: settle those ties by the words themselves
            met = np.unique(np.concatenate((order[tie], order[tie + 1])))
            words = np.stack([doc[at[met]], *[codes[at[met] + j] for j in range(size)]], 1)
            _, number, times = np.unique(words, axis=0, return_inverse=True, return_counts=True)
            twice = at[met[times[number.ravel()] > 1]]
        else:
            twice = np.unique(np.concatenate((left, right)))
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _measured(texts: list[bytes], tokens: Tokens) -> dict[str, np.ndarray]:
    split = [t.split() for t in texts]
    n_words = np.array([len(w) for w in split])
    last = np.cumsum(n_words)
    n_models = len(tokens.models)
    out = {k: np.zeros(len(texts), np.int64) for k in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "script")}
    out |= {"n_words": n_words, "n_tokens": np.zeros((len(texts), n_models), np.int64), "n_byte_tokens": np.zeros((len(texts), n_models), np.int64), "entropy": np.zeros((len(texts), n_models))}
    for d, text in enumerate(texts):
        if b"\n" in text:
            seen: set = set()
            for line in text.split(b"\n"):
                if line in seen:
                    out["n_dup_lines"][d] += 1
                elif line.strip(b" \t\n\x0b\x0c\r"):
                    seen.add(line)
    words = [w for s in split for w in s]
    if not words:
        return out
    some = np.flatnonzero(n_words)
    codes, names = pd.factorize(np.array(words, dtype=object))
    codes = codes.astype(np.int64)
    # every figure below is a sum over the words of a text, so a figure for each different word is enough
    lengths = np.array([len(w) for w in names])
    flat = np.frombuffer(b"".join(names), np.uint8)
    begins = np.cumsum(lengths) - lengths
    per_word = lambda v: np.add.reduceat(v.astype(np.int64), begins)
    total = lambda v: np.add.reduceat(v[codes], (last - n_words)[some])
    out["word_chars"][some] = total(per_word((flat & 0xC0) != 0x80))
    out["n_symbols"][some] = total(per_word(_SYMBOLS[flat]))
    letters = np.stack([total(per_word(_SCRIPT_OF[flat] == s)) for s in range(1, len(SCRIPTS))], 1) if not flat.max() < 128 else total(per_word(_SCRIPT_OF[flat] == 1))[:, None]
    out["script"][some] = np.where(letters.max(1) > 0, letters.argmax(1) + 1, 0)

    doc = np.repeat(np.arange(len(texts)), n_words)
    covered = np.append(0, np.cumsum(_repeated(codes, doc)))
    out["n_repeat_words"] = covered[last] - covered[last - n_words]

    number = tokens.learn(list(names))
    for m, model in enumerate(tokens.models):
        ends = np.cumsum(tokens.counts[m])
        counts = tokens.counts[m][number]
        starts = ends[number] - counts
        out["n_tokens"][some, m] = total(counts)
        held = np.append(0, np.cumsum(model.single[tokens.ids[m]]))
        out["n_byte_tokens"][some, m] = total(held[ends[number]] - held[starts])
        size = counts[codes]
        every = tokens.ids[m][np.arange(size.sum()) + np.repeat(starts[codes] - (np.cumsum(size) - size), size)]
        key = np.sort(np.repeat(doc, size) << 32 | every)
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        times = np.diff(np.append(new, len(key)))
        # entropy = log2(n) - sum(c log2 c) / n
        weight = np.bincount(key[new] >> 32, times * np.log2(times), len(texts))
        n = np.maximum(out["n_tokens"][:, m], 1)
        out["entropy"][:, m] = np.log2(n) - weight / n
    return out


def measures(docs: DataFrame, vocabularies: tuple[str, ...] = VOCABULARIES, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, more: dict[str, Column] | None = None) -> DataFrame:
    """The figures of SCHEMA for each row of docs (with `keep`, also the other columns as a struct `row`, and the text).

    Words are runs of characters other than space and 0x09-0x0D in whole texts; a null or
    empty text has none, and all its figures are 0.  word_chars counts their characters,
    n_symbols those of #*$%&|<>, n_dup_lines the lines with a word that equal an earlier
    line, n_repeat_words the words in 5-word windows found more than once.  Tokens are those
    of each word by itself, and n_tokens, n_byte_tokens and entropy (in bits) have one entry
    for each vocabulary; script is the most frequent one among the letters (the first of
    SCRIPTS on ties).

    The vocabulary files are read once by the driver and broadcast.  A task holds few texts
    at once, but each whole: a very long text is measured by itself.  Rows repeated, or with
    a null or repeated id, are measured each; columns of any name may stand beside.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")] if keep else []),
        *[c.alias(n) for n, c in (more or {}).items()],
    )
    names = [f.name for f in StructType.fromDDL(SCHEMA)]
    rest = [*(["row", "text"] if keep else []), *(more or {})]
    held = []
    for path in vocabularies:
        with open(path, "rb") as file:
            held.append((path, file.read()))
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(shared.value)
        for batch in small(batches):
            texts, at = [(t or "").encode() for t in batch["text"].to_pylist()], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < _CHUNK:
                    size += len(texts[end])
                    end += 1
                got = _measured(texts[at:end], tokens)
                got["script"] = [SCRIPTS[s] for s in got["script"]]
                part = batch.slice(at, end - at)
                columns = [pa.array(list(got[c]) if got[c].ndim > 1 else got[c]) if c != "script" else pa.array(got[c], pa.string()) for c in names[1:]]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *columns, *(part[c] for c in rest)], [*names, *rest])
                at = end

    schema = StructType.fromDDL(SCHEMA)
    for c in rest:
        schema = schema.add(rows.schema[c])
    return rows.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _figures(m: int) -> dict[str, Column]:
    """Fertility, share of byte tokens, and entropy as a share of log2(tokens), at most 8 bits, under vocabulary m."""
    tokens = F.greatest(F.col("n_tokens")[m], F.lit(1))
    return {"fertility": F.col("word_chars") / tokens, "byte_share": F.col("n_byte_tokens")[m] / tokens, "entropy_share": F.when(tokens >= MIN_TOKENS, F.col("entropy")[m] / F.least(F.log2(tokens), F.lit(8.0)))}


def with_lang(docs: DataFrame, vocabularies: tuple[str, ...] = VOCABULARIES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: bool = False) -> DataFrame:
    """measures of docs with the language that each row names (null where docs name none)."""
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    return measures(docs, vocabularies, id_col, text_col, keep, {"lang": lang})


def fitted_bands(docs: DataFrame, labels: DataFrame, vocabularies: tuple[str, ...] = VOCABULARIES, least: int = 50, tail: float = 0.002, slack: float = 0.25, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", measured: DataFrame | None = None) -> dict[str, tuple[Band, ...]]:
    """Rejection bands by language (`lang:xx`) and script (`script:xx`), from all rows that labels(doc_id, quality) call good.

    Only quantiles reach the driver; `measured` are rows of with_lang over docs, where they are
    at hand.  A figure's bound is its `tail` quantile
    among the good rows that pass the base rules, moved outwards by `slack` times its
    distance from the median.  Languages and scripts with fewer than `least` rows get none:
    their texts are judged by their script, or by WIDE.
    """
    good = labels.where("quality = 1").select(F.col(id_col).cast("long").alias("label_id")).where("label_id is not null").distinct()
    if measured is None:
        measured = with_lang(docs.join(good, docs[id_col].cast("long") == good["label_id"], "left_semi"), vocabularies, id_col, text_col, lang_col)
    rows = measured.join(good, measured["doc_id"] == good["label_id"], "left_semi").where(~base_failed())
    rows = rows.withColumn("group", F.explode(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("script:"), "script")))).where("group is not null")
    wanted = F.array(F.lit(tail), F.lit(0.5), F.lit(1 - tail))
    figures = {(m, name): c for m in range(len(vocabularies)) for name, c in _figures(m).items()}
    got = rows.groupBy("group").agg(F.count("*").alias("n"), *[F.percentile_approx(c, wanted, 10_000).alias(f"{name}_{m}") for (m, name), c in figures.items()]).where(F.col("n") >= least)
    bands = {}
    for r in got.collect():
        each = []
        for m in range(len(vocabularies)):
            low, mid, high = r[f"fertility_{m}"]
            shares, entropy = r[f"byte_share_{m}"], r[f"entropy_share_{m}"] or (0.0, 0.0, 0.0)
            each.append(Band(low - slack * (mid - low), high + slack * (high - mid), shares[2] + slack * (shares[2] - shares[1]) + 0.01, entropy[0] - slack * (entropy[1] - entropy[0])))
        bands[r["group"]] = tuple(each)
    return bands


def fits(bands: dict[str, tuple[Band, ...]], lang: Column, wide: tuple[Band, ...] = WIDE) -> Column:
    """Whether a row of measures lies within the bands of its language, else its script, else `wide`, under every vocabulary."""

    def inside(each: tuple[Band, ...]) -> Column:
        out = F.lit(True)
        for m, b in enumerate(each):
            f = _figures(m)
            out = out & f["fertility"].between(b.low, b.high) & (f["byte_share"] <= b.byte_share) & F.coalesce(f["entropy_share"] >= b.entropy_share, F.lit(True))
        return out

    out = inside(wide)
    for kind, column in (("script", F.col("script")), ("lang", lang)):
        for group, each in sorted(bands.items()):
            if group.startswith(f"{kind}:"):
                out = F.when(column == group.split(":", 1)[1], inside(each)).otherwise(out)
    return out


def judged(docs: DataFrame, bands: dict[str, tuple[Band, ...]] | None = None, vocabularies: tuple[str, ...] = VOCABULARIES, keep: bool = False, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", measured: DataFrame | None = None) -> DataFrame:
    """measures, base_failed (under 10 words, or over 20 % of them in repeated windows) and kept (not base_failed, and within the bands).

    Bands come from fitted_bands; without any, WIDE judges all.  A null text or one without
    words fails the base rules.  Each row is judged for itself and returned once.  `measured` are rows of
    with_lang over docs, where they are at hand.
    """
    out = with_lang(docs, vocabularies, id_col, text_col, lang_col, keep) if measured is None else measured
    out = out.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & fits(bands or {}, F.col("lang"), WIDE[:1] * len(vocabularies))).drop("lang")
