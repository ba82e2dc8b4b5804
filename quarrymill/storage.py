"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Tables of more rows are never broadcast: Spark takes their size from packed files, which say a tenth of what the driver would hold.
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset on a local master (tests), a temp folder that is then set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def once(make: Callable) -> Callable:
    """make(e) written at its first call and kept with e, for tables that several rules of a corpus read."""

    @wraps(make)
    def table(e) -> DataFrame:
        kept = vars(e).setdefault("tables", {})
        if make not in kept:
            kept[make] = written(make(e), make.__name__)
        return kept[make]

    return table


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors.

    Joins of a table of more than BROADCAST_ROWS rows, counted as it is written, are merge joins.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows = Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    return table.hint("merge") if rows.get.get("n", 0) > BROADCAST_ROWS else table
