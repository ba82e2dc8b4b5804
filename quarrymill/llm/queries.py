"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.centroids import clustered
from quarrymill.llm.decontaminate import benchmark_hits
from quarrymill.llm.jaccard_join import jaccard_groups
from quarrymill.llm.language_id import languages
from quarrymill.llm.line_dedup import line_dedup
from quarrymill.llm.merkle import merkle_manifest
from quarrymill.llm.mixing import mix_sources
from quarrymill.llm.oracles import OP11_SQL, OP12_SQL, OP13_SQL
from quarrymill.llm.pii import KINDS, personal_data
from quarrymill.llm.quality import fitted_bands, judged, with_lang
from quarrymill.llm.scratch import written
from quarrymill.llm.secret_scan import secret_spans
from quarrymill.llm.simhash import simhash_groups
from quarrymill.llm.substring_dedup import substring_dedup
from quarrymill.llm.suffix_dedup import suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _removed():
    return F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"), length=50).select(
        "doc_id",
        "n_bytes",
        _removed().alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), window=35).select(
        "doc_id",
        "n_words",
        _removed().alias("n_removed"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


def op3_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"), words=4, bits=4).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), share=1.5, most=2.0).select("doc_id", "size", "source_size", "target", "taken")


def _spans(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_spans(base).cast("binary"), 256).alias("base_sha256"), _spans(F.col("spans")).alias("spans"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    measured = written(with_lang(docs), "measures")
    return judged(docs, fitted_bands(docs, _table(spark, sf_dir, "labels"), measured=measured), measured=measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(_table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, KINDS))
    spans = F.transform("spans", lambda x: F.struct(F.element_at(names, x["kind"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "context")
    return found.select("doc_id", spans.alias("spans")).select(
        "doc_id", *map(count, KINDS[:4]), F.sha2(_spans(base).cast("binary"), 256).alias("base_sha256"), _spans(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans")
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents"), min_chars=20, min_docs=3).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=10)
    return hits.select(
        "doc_id",
        "n_words",
        _removed().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return merkle_manifest(_table(spark, sf_dir, "documents"), tampered=tampered).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(_table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustered(_table(spark, sf_dir, "embeddings"), k=40, rounds=5, size=64)
    digest = F.sha2(F.array_join("centroid", ",").cast("binary"), 256).alias("centroid_sha256")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"

OP7_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (SELECT *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_LOWER}') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT a.doc_id, a.i, a.line, c.k IS NOT NULL AND a.doc_id <> c.last AS dropped
  FROM keyed a LEFT JOIN common c ON a.k = c.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP8_SQL = f"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD}) AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD}) AS w FROM documents),
spots AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, s.n, i, item_id FROM spots s JOIN windows v ON s.n = v.n AND s.win = v.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def queries() -> dict:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_simhash_neardup": op3_simhash_neardup,
        "op4_mix_sources": op4_mix_sources,
        "op5_secret_scan": op5_secret_scan,
        "op6_quality_rules": op6_quality_rules,
        "op7_line_dedup": op7_line_dedup,
        "op8_decontaminate": op8_decontaminate,
        "op9_personal_data": op9_personal_data,
        "op10_language_id": op10_language_id,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_jaccard_join": op12_jaccard_join,
        "op13_centroid_clusters": op13_centroid_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_line_dedup": OP7_SQL,
        "op8_decontaminate": OP8_SQL,
        "op11_merkle_manifest": OP11_SQL,
        "op12_jaccard_join": OP12_SQL,
        "op13_centroid_clusters": OP13_SQL,
    }
