"""Reading corpora of sources and writing findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.text import normalize_lf


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, path, text): one row a file, or the rows of a parquet table with these columns; ids of files are hashes of their paths."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path).select("source_id", "path", "text")
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.select(F.xxhash64("path").alias("source_id"), "path", "text")


def source_receipts(sources: DataFrame) -> DataFrame:
    """(source_id, sha256, n_copies, first_id): hash of the LF-normalised text, how many sources share it, and the first of them."""
    rows = sources.select("source_id", F.sha2(normalize_lf(F.col("text")), 256).alias("sha256"))
    groups = rows.groupBy("sha256").agg(F.count("*").alias("n_copies"), F.min("source_id").alias("first_id"))
    return rows.join(groups, "sha256").select("source_id", "sha256", "n_copies", "first_id")


def write_findings(findings: DataFrame, path: str) -> None:
    """One JSON object a finding, in a folder for each vulnerability type."""
    findings.write.partitionBy("vulnerability_type").mode("overwrite").json(path)
