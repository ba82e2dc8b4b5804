"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.scratch import removed, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b): component is the smallest node reachable.

    Every round turns each node's links into a star around the least neighbour, first for
    larger neighbours, then for smaller ones.  Only the least of each neighbourhood is
    aggregated, so no neighbourhood is gathered in one place.  Rounds are written to the
    shared folder; the edges never reach the driver.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = written(edges.select(low.alias("a"), high.alias("b")).where("a < b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a and m < b").select(F.col("m").alias("a"), "b").distinct()
        up = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(up, "b")
        small = small.select(F.col("m").alias("a"), "b").union(small.where("m < a").select(F.col("m").alias("a"), F.col("a").alias("b")))
        new = written(small.distinct(), "edges")
        new_state = _state(new)
        removed(now)
        now, done, state = new, new_state == state, new_state
        if done:
            break
    return now.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("node"), "component").union(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
