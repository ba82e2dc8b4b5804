"""Language identification: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.words import small

UNKNOWN = "und"
BUCKETS, WIDTH = 1 << 12, 16
_SIZES = (2, 3, 4)
_CHUNK = 1 << 21
#: A-Z become a-z, other ASCII characters but letters become spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def _subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of <word>, and how many each word has."""
    flat = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = ends[owner] - np.arange(len(flat))
    buckets, owners = [], []
    for n in _SIZES:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = (h ^ flat[at + j]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        buckets.append((h % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[at])
    buckets, owners = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.bincount(owners, minlength=len(words))


def features(text: bytes) -> np.ndarray:
    """Share of each bucket among the subwords of a text."""
    words = text.translate(_FOLD).split()
    if not words:
        return np.zeros(BUCKETS, np.float32)
    codes, names = pd.factorize(np.array(words, dtype=object))
    buckets, sizes = _subwords(list(names))
    counts = np.bincount(buckets, np.repeat(np.bincount(codes), sizes), BUCKETS)
    return (counts / counts.sum()).astype(np.float32)


@dataclass
class Model:
    """labels, embeddings times softmax weights (one row a bucket), bias, temperature and the score below which to reject."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def fitted(x: np.ndarray, y: np.ndarray, labels: list[str], epochs: int = 40, rate: float = 30.0, seed: int = 5) -> Model:
    """Stochastic gradient descent in small batches; a fifth of the rows calibrate temperature and rejection."""
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(x))
    n_held = len(x) // 5
    held, train = order[:n_held], order[n_held:]
    embed = draw.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weight = draw.normal(0, 0.1, (WIDTH, len(labels))).astype(np.float32)
    bias = np.zeros(len(labels), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(train), 32):
            rows = draw.permutation(train)[:32] if at == 0 and len(train) < 32 else train[at : at + 32]
            hidden = x[rows] @ embed
            error = _softmax(hidden @ weight + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            back = error @ weight.T
            weight -= 0.1 * step * hidden.T @ error
            bias -= 0.01 * step * error.sum(0)
            embed -= step * x[rows].T @ back
        draw.shuffle(train)
    table = embed @ weight
    temperature, reject = 1.0, 0.0
    if n_held:
        logits = x[held] @ table + bias
        loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(n_held), y[held]], 1e-9)).mean()
        temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
        chance = _softmax(logits / temperature)
        right, score = chance.argmax(1) == y[held], chance.max(1)
        best = np.argsort(-score)
        precise = np.cumsum(right[best]) / np.arange(1, n_held + 1) >= 0.99
        reject = float(score[best][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0
    return Model(labels, table, bias, float(temperature), reject)


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, per_language: int = 500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from about `per_language` labelled rows of each language, chosen by a hash of the id; no held-out row is used.

    Each chosen row is turned into bucket shares where it lies; only those reach the driver,
    so its memory is bounded by languages * per_language * BUCKETS.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null and id is not null").where(~held_out(F.col("id")))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 1.0)
    share = F.element_at(F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, per_language / n))]), F.col("lang"))
    chosen = rows.where((F.pmod(F.xxhash64(F.lit("languages"), "id"), F.lit(1_000_000)) / 1_000_000) < share)

    def turned(batches) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            x = [features(t.encode()) for t in batch["text"].to_pylist()]
            where = [np.flatnonzero(v) for v in x]
            yield pa.RecordBatch.from_arrays(
                [batch["id"].cast(pa.string()), batch["lang"], pa.array([w.tolist() for w in where], pa.list_(pa.int32())), pa.array([v[w].tolist() for v, w in zip(x, where)], pa.list_(pa.float32()))],
                ["id", "lang", "at", "share"],
            )

    got = chosen.select("id", "text", "lang").mapInArrow(turned, "id string, lang string, at array<int>, share array<float>").toArrow()
    order = np.argsort(np.array(got["id"].to_pylist(), dtype=object), kind="stable")
    labels = sorted(counts)
    x, y = np.zeros((len(order), BUCKETS), np.float32), np.zeros(len(order), np.int64)
    at, shares, langs = got["at"].to_pylist(), got["share"].to_pylist(), got["lang"].to_pylist()
    for row, i in enumerate(order.tolist()):
        x[row, at[i]] = shares[i]
        y[row] = labels.index(langs[i])
    return fitted(x, y, labels)


def _scores(texts: list[bytes], model: Model) -> np.ndarray:
    """Calibrated chances of each label; rows of texts without subwords are zero."""
    split = [t.translate(_FOLD).split() for t in texts]
    n = np.array([len(s) for s in split])
    out = np.zeros((len(texts), len(model.labels)))
    if not n.sum() or not model.labels:
        return out
    codes, names = pd.factorize(np.array([w for s in split for w in s], dtype=object))
    buckets, sizes = _subwords(list(names))
    sums = np.add.reduceat(model.table[buckets], np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)
    some = np.flatnonzero(n)
    first = (np.cumsum(n) - n)[some]
    logits = np.stack([np.add.reduceat(s[codes], first) for s in sums.T], 1) / np.add.reduceat(sizes[codes], first)[:, None]
    out[some] = _softmax((logits + model.bias) / model.temperature)
    return out


def languages(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row, from its whole text alone.

    lang_pred is the likeliest label, or `und` (score 0) where the text is null or has no
    letter, or nothing was learned.  score is the calibrated chance of the label (of equal
    chances the first label by code points counts); rejected says that it is below the score
    from which on 99 % of the calibration rows had their right label.  A null id is not held
    out; each row, repeated or not, is returned once; a very long text is scored whole, by
    itself; other columns, of any name, are ignored.
    """
    model = trained(docs, id_col=id_col, text_col=text_col) if model is None else model
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def predict(batches) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch["text"].to_pylist()
            names, scores, at = [], [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < _CHUNK:
                    size += len(texts[end])
                    end += 1
                chance = _scores([t.encode() for t in texts[at:end]], model)
                for text, row in zip(texts[at:end], chance):
                    known = len(row) and row.sum() > 0 and any(map(str.isalpha, text))
                    names.append(model.labels[int(row.argmax())] if known else UNKNOWN)
                    scores.append(min(1.0, float(row.max())) if known else 0.0)
                at = end
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(names, pa.string()), pa.array(scores), pa.array([s < model.reject_below for s in scores])],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
