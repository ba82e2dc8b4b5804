"""Secrets in texts: fixed patterns, and character Markov models of random strings and identifiers."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.words import small

KINDS = ("assign", "access", "hex", "random")
#: Every hex or access match, and every candidate of the models, lies in such a run.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_ASSIGN = re.compile(r"""(?a)((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_CUES = (b"passw", b"secret", b"token", b"apikey", b"api_key")
#: Characters of identifiers; class 0 is any other one.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_N = len(ALPHABET) + 1
_CLASS = np.zeros(256, np.int64)
_CLASS[list(ALPHABET.encode())] = np.arange(1, _N)
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32
#: What each side's counts are scaled to, so that smoothing weighs the same in any corpus.
_SCALE = 1_000_000.0
#: Mean ratios of held-out identifiers are counted in steps of so much.
_STEP = 0.001


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping for each kind."""
    out = []
    folded = raw.lower()
    if any(cue in folded for cue in _CUES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    for run in _RUN.finditer(text):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text, *run.span())]
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text, *run.span()) if len(m[0]) >= 20]
    return sorted(out)


def _candidates(text: str, min_length: int = 20) -> Iterator[tuple[int, str, int]]:
    """Runs of identifier characters, without marks at their ends, but for plain numbers."""
    run_of = _RUN if min_length == 20 else re.compile(rf"[A-Za-z0-9+/_=-]{{{min_length},}}")
    for run in run_of.finditer(text):
        token = run[0].strip("=-_+/")
        s = run.start() + run[0].find(token)
        if len(token) >= min_length and not token.isdigit():
            yield s, token, s + len(token)


def _pairs(raw: np.ndarray) -> np.ndarray:
    kind = _CLASS[raw]
    return np.bincount(kind[:-1] * _N + kind[1:], minlength=_N * _N) if len(raw) > 1 else np.zeros(_N * _N, np.int64)


def generated_strings(n: int, seed: int = 11) -> list[str]:
    """Labelled random strings: keys as they are made, over hex, base 32, base 36, base 62 and base 64 alphabets."""
    draw = random.Random(seed)
    alphabets = (ALPHABET[52:62] + "abcdef", ALPHABET[:26] + "234567", ALPHABET[26:62], ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[:62] + "-_", ALPHABET[:52])
    return ["".join(draw.choices(alphabets[i % len(alphabets)], k=draw.randint(20, 48))) for i in range(n)]


def placeholders(most: int = 48) -> list[str]:
    """Labelled ordinary strings that no text needs to hold: one character repeated, and runs of the alphabet."""
    rows = [c * most for c in ALPHABET]
    for part in (ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]):
        rows += [(part * 4)[:most]] * 3
    return rows


def compounds(text: str) -> list[str]:
    """Labelled ordinary identifiers: three successive words of a text, joined as identifiers are."""
    words = re.findall(r"[A-Za-z]{2,}", text)
    out = []
    for i in range(0, len(words) - 2, 3):
        a, b, c = words[i : i + 3]
        kind = (i // 3) % 5
        if kind == 0:
            out.append(a.lower() + b.capitalize() + c.capitalize())
        elif kind == 1:
            out.append("_".join((a, b, c)).lower())
        elif kind == 2:
            out.append("-".join((a, b, c)).lower())
        elif kind == 3:
            out.append("_".join((a, b, c)).upper())
        else:
            out.append("/".join((a, b, c)).lower())
    return out


@dataclass(frozen=True)
class Models:
    """ratio[a, b]: log-likelihood ratio (random string against identifier) of class b after class a; threshold: the mean ratio a secret has at least.

    found and false_share are what the threshold gave on held-out labelled samples: the
    share of random strings found, and of ordinary identifiers taken for secrets.
    """

    ratio: np.ndarray
    threshold: float
    found: float
    false_share: float

    def score(self, token: str) -> float:
        kind = _CLASS[np.frombuffer(token.encode(), np.uint8)]
        return float(self.ratio[kind[:-1], kind[1:]].mean())


def _held_out(raw: bytes) -> bool:
    return xxhash.xxh64_intdigest(raw, 5) % 5 == 0


def trained_models(docs: DataFrame, text_col: str = "text", generated: int = 4000, held: int = 5000, max_false: float = 0.001) -> Models:
    """The two models, counted over all documents, and a threshold from held-out labelled samples.

    Random strings: what the hex and access patterns match, and `generated` made-up keys, as
    a corpus may hold few.  Ordinary: all text outside the patterns and outside the runs
    that are to be judged, as it stands and with its words joined as paths and in snake, kebab and
    camel case, and placeholders.  A fifth of the texts, told by a hash, is not counted: all
    identifiers joined from their words (see compounds) and `held` made-up keys of
    another draw set the threshold at the least mean ratio (in steps of _STEP) that takes at most max_false of
    the identifiers for secrets, or, where that leaves a gap to the keys, in its middle.
    Pair counts grow with all documents; only two tables of them and the counts of the
    identifiers' steps reach the driver.
    """

    def count(batches) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, _N * _N), np.int64)
        for batch in small(batches):
            for raw in batch["text"].to_pylist():
                if _held_out(raw):
                    continue
                text = raw.decode("utf-8", "replace")
                plain = np.frombuffer(raw, np.uint8)
                spans = base_spans(text, raw)
                spans += [(s, 0, e) for s, _, e in _candidates(text)]
                if spans:
                    plain = plain.copy() if text.isascii() else np.frombuffer(text.encode("latin-1", "replace"), np.uint8).copy()
                    for s, kind, e in spans:
                        if kind:
                            counts[1] += _pairs(plain[s:e])
                        plain[s:e] = 0
                counts[0] += _pairs(plain)
                for mark in b"_-/":
                    counts[0] += _pairs(np.where(plain == 32, np.uint8(mark), plain))
                counts[0] += _pairs(np.where(plain == 32, np.uint8(95), _UPPER[plain]))
                # camel case: spaces go, the letter after each is a capital
                after = np.append(False, plain[:-1] == 32)
                counts[0] += _pairs(np.where(after, _UPPER[plain], plain)[plain != 32])
        label, pair = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(pair), pa.array(counts[label, pair])], ["label", "pair", "n"])

    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    counts = np.zeros((2, _N * _N))
    for label, pair, n in texts.mapInArrow(count, "label long, pair long, n long").groupBy("label", "pair").agg(F.sum("n")).collect():
        counts[label, pair] = n
    made = sum((_pairs(np.frombuffer(text.encode(), np.uint8)) for text in generated_strings(generated)), np.zeros(_N * _N))
    counts[1] = counts[1] / max(counts[1].sum(), 1) + made / max(made.sum(), 1)  # of equal weight in any corpus
    share = counts[0].sum() * 0.01 / sum(map(len, placeholders())) if counts[0].sum() else 1.0
    for text in placeholders():
        counts[0] += share * _pairs(np.frombuffer(text.encode(), np.uint8))
    counts *= _SCALE / np.maximum(counts.sum(1, keepdims=True), 1)
    counts = counts.reshape(2, _N, _N)
    single = counts.sum(1, keepdims=True) + 0.5  # rare pairs fall back to how frequent the second character is
    single /= single.sum(2, keepdims=True)
    chance = np.log((counts + 50 * single) / (counts.sum(2, keepdims=True) + 50))
    ratio = chance[1] - chance[0]

    steps, n_names = _held_scores(texts, ratio)
    models = Models(ratio, 0.0, 0.0, 0.0)
    keys = np.sort([models.score(x) for x in generated_strings(max(held, 1), seed=12)])
    total = int(n_names.sum())
    rank = min(int(np.ceil(total * (1 - max_false))), total - 1)
    top = (float(steps[np.searchsorted(np.cumsum(n_names), rank, "right")]) * _STEP if total else 0.0) + 1e-9
    threshold = max(top, (top + float(keys[int(len(keys) * 0.01)])) / 2)
    return Models(ratio, threshold, float((keys >= threshold).mean()), float(n_names[steps * _STEP >= threshold].sum() / total) if total else 0.0)


def _held_scores(texts: DataFrame, ratio: np.ndarray, min_length: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(steps, n): how many identifiers of min_length or more, joined from the words of all held-out texts, have a mean ratio up to each step and above the one before.

    Only counts of steps reach the driver, as many as the ratios span, whatever the corpus holds.
    """

    def scored(batches) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for batch in small(batches):
            for raw in batch["text"].to_pylist():
                names = [x for x in compounds(raw.decode("utf-8", "replace")) if len(x) >= min_length] if _held_out(raw) else []
                if names:
                    kind = _CLASS[np.frombuffer("\n".join(names).encode(), np.uint8)]
                    sums = np.append(0.0, np.cumsum(ratio[kind[:-1], kind[1:]]))
                    size = np.array([len(x) for x in names])
                    end = np.cumsum(size + 1) - 2  # where the last character of each stands
                    means = (sums[end] - sums[end - size + 1]) / (size - 1)
                    for step, n in zip(*np.unique(np.ceil(means / _STEP).astype(np.int64), return_counts=True)):
                        counts[int(step)] = counts.get(int(step), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["step", "n"])

    rows = sorted(tuple(r) for r in texts.mapInArrow(scored, "step long, n long").groupBy("step").agg(F.sum("n")).collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def secret_spans(docs: DataFrame, models: Models | None = None, min_length: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in whole texts: (doc_id, spans), spans an array of (start, end, kind) in code points, by start, then kind.

    Kinds: assign (a password, secret, token or key given a value of 6 characters or more),
    access (AKIA keys of 20 or more), hex (24 or more hex digits), and random: a run of
    identifier characters of min_length or more that is no plain number, outside all other
    spans, whose mean log-likelihood ratio under the two Markov models (trained_models)
    reaches their threshold.  The models decide alike on runs of letters and on mixed ones.

    A null text is empty; a null or repeated id returns as it is; each row, repeated or not,
    is returned once; a very long text is scanned whole, a task holding few texts at once;
    other columns, of any name, are ignored.
    """
    models = trained_models(docs, text_col) if models is None else models
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def scan(batches) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = []
            for text in batch["text"].to_pylist():
                spans = base_spans(text, text.encode())
                more = []
                for s, token, e in _candidates(text, min_length):
                    if any(a < e and s < b for a, _, b in spans):
                        continue
                    if models.score(token) >= models.threshold:
                        more.append((s, 3, e))
                found.append([{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in sorted(spans + more)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, kind)], ["doc_id", "spans"])

    return rows.mapInArrow(scan, "doc_id long, spans array<struct<start: long, end: long, kind: string>>")
