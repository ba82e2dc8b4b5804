"""From raw documents to a mixed corpus: each stage applies one operator to all that its predecessor kept.

The stages take (spark, docs, sf_dir), where docs has the columns of `documents`, and return
those columns again; the last returns the mixed corpus itself.  In every stage columns of any
other name may stand beside; rows repeated whole, null ids and null or empty texts are taken
as the stage's operator says; an empty table stays empty; very long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.decontaminate import decontaminated
from quarrymill.llm.line_dedup import line_dedup
from quarrymill.llm.mixing import mixed_corpus
from quarrymill.llm.near_copies import one_of_each
from quarrymill.llm.quality import fitted_bands, judged, with_lang
from quarrymill.llm.scratch import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside the tokeniser bands, fitted on the labelled rows, go; those without words fail."""
    measured = written(with_lang(docs, keep=True), "measures")
    bands = fitted_bands(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), measured=measured)
    kept = judged(docs, bands, keep=True, measured=measured).where("kept")
    return kept.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay only in the last of them; a null text stays null."""
    out = line_dedup(docs, min_chars=20, min_docs=3, keep=True)
    text = F.when(F.col("row.no_text") & (F.col("n_dropped") == 0), F.lit(None)).otherwise(F.col("kept"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") == 0, F.col("row.cols.n_chars")).otherwise(F.char_length("kept").cast(docs.schema["n_chars"].dataType))
    return out.select(*[new[c].alias(c) if c in new else F.col("row.cols").getField(c).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8; candidates by SimHash as in op3, and by MinHash) the row with the smallest id stays."""
    return one_of_each(docs, words=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are mostly benchmark text go; passages are cut out of the others."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10, max_share=0.5)


#: Share of all words, and how often a source's words may be taken.
MIX = {"share": 1.5, "most": 2.0}


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mix of 150 % of all words by source weights: a row for each piece of a document, with its text and its place in its shard."""
    return mixed_corpus(docs, **MIX)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

#: Near-duplicate groups and tokeniser bands cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage makes of `documents`; each stage's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
