"""Removal of lines that many documents share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrymill.llm.scratch import removed, written
from quarrymill.llm.words import small

LAST = 2**63 - 1
#: At most this many keys count as very common, and none that stands in fewer documents than HOT: they are broadcast.
MOST_HOT, HOT = 20_000, 1024
_SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of the line, stripped and with A-Z lower-cased; None if it is too short to count."""
    key = line.strip(_SPACE).lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return hashlib.md5(key, usedforsecurity=False).digest()


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Drop lines whose key stands in at least min_docs documents, except in the largest id that has it.

    Lines end at newlines; a key is the line without spaces and 0x09-0x0D at both ends, with
    A-Z lower-cased, and counts from min_chars characters.  Keys are hashed (128 bits); each
    task writes a key once a document.  Pairs of key and document are made distinct before
    they are counted, so a common line is never gathered; documents meet the keys that at
    most MOST_HOT very common lines have by a broadcast, the other keys by a join.

    Returns (doc_id, n_lines, n_dropped, kept): kept is the other lines, joined by newlines.
    A null or empty text is one empty line.  Each row with a null id is a document of its
    own, after all ids, in an order by hash, and returns with a null id; rows with the same
    id are one document when documents are counted, and each row is returned.  Other
    columns, of any name, are ignored, or with `keep` returned in row.cols; row.no_text
    then tells a null text from an empty one.  A very long text is cut whole in one task.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
        *([F.struct(F.col(text_col).isNull().alias("no_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("cols")).alias("row")] if keep else []),
    )

    # own is 0 for rows with an id, and tells apart those without: their numbers are written once, so they stay
    columns = [F.coalesce("doc", F.lit(LAST)).alias("doc"), "own", "text", *(["row"] if keep else [])]
    named = rows.where("doc is not null").withColumn("own", F.lit(0).cast("long")).select(columns)
    nameless = rows.where("doc is null")
    if nameless.isEmpty():
        rows = named
    else:
        rows = named.union(written(nameless.withColumn("own", F.xxhash64("text", F.monotonically_increasing_id())).select(columns), "nameless"))

    def keys(batches) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            owners, owns, found = [], [], []
            for doc, own, text in zip(*(batch[c].to_pylist() for c in ("doc", "own", "text"))):
                mine = {line_key(x, min_chars) for x in text.split(b"\n")}
                mine.discard(None)
                found += mine
                owners += [doc] * len(mine)
                owns += [own] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(owns, pa.int64()), pa.array(found, pa.binary())], ["doc", "own", "key"])

    def reassembled(batches) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            n_lines, n_dropped, kept = [], [], []
            for text, dropped in zip(batch["text"].to_pylist(), batch["dropped"].to_pylist()):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if dropped:
                    drop = set(dropped)
                    lines = [x for x in lines if line_key(x, min_chars) not in drop]
                    text = b"\n".join(lines)
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [pc.if_else(pc.equal(batch["own"], 0), batch["doc"], pa.scalar(None, pa.int64())), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), *([batch["row"]] if keep else [])],
                ["doc_id", "n_lines", "n_dropped", "kept", *(["row"] if keep else [])],
            )

    held = written(rows.select("doc", "own", "text").mapInArrow(keys, "doc long, own long, key binary"), "keys")
    owner = F.struct("doc", "own")
    common = held.distinct().groupBy("key").agg(F.count("*").alias("n"), F.max(owner).alias("last")).where(F.col("n") >= min_docs)
    common = written(common, "common")
    least = max(HOT, (common.agg(F.sum("n")).first()[0] or 0) // MOST_HOT)
    hot = F.broadcast(common.where(F.col("n") >= least))  # at most MOST_HOT keys: each has that share of all pairs
    cold = held.join(hot, "key", "left_anti").join(common.where(F.col("n") < least), "key")
    drops = held.join(hot, "key").union(cold).where(owner != F.col("last")).groupBy("doc", "own").agg(F.collect_set("key").alias("dropped"))
    drops = written(drops, "drops").hint("merge")  # its lists of keys are packed in files, not in memory
    for done in (held, common):
        removed(done)
    schema = StructType.fromDDL("doc_id long, n_lines long, n_dropped long, kept string")
    return rows.join(drops, ["doc", "own"], "left").mapInArrow(reassembled, schema.add(rows.schema["row"]) if keep else schema)
