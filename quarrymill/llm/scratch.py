"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quarrymill.storage import shared_folder, written

__all__ = ["removed", "shared_folder", "written"]


def removed(df: DataFrame) -> None:
    """Delete the files of a table made by written(), once nothing reads it any more."""
    spark = df.sparkSession
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)
