"""Run-time order: which way a root first enters each function, and what can still run after a point.

A run enters the functions that a line calls in the order of the line's calls, and never one
that is on the way already.  Ways are arrays of (line, rank of the call) and compare like the
run's order; a run lists all ways without a repeated function in that order, so the least way
to a function is where it is first entered, and every later visit enters nothing new.  That
keeps one row for each root and function, however many ways lead there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarrymill.storage import written


def first_ways(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(source_id, tag, at, chain, names, way): the least way from the start of each tag to each function, past none of `blocked`.

    edges: (source_id, caller, line, rank, callee, callee_fn); starts: (source_id, tag, at,
    fn, blocked).  Each round lengthens the ways that were bettered in the last one by a call, so
    rounds are as many as the longest way has calls.
    """
    hop = edges.select("source_id", F.col("caller").alias("at"), "line", "rank", "callee", "callee_fn")
    none = F.array().cast("array<int>")
    new = written(starts.select("source_id", "tag", "at", F.array("at").alias("chain"), F.array("fn").alias("names"), none.alias("way"), "blocked"), "ways")
    key, seen = ["source_id", "tag", "at"], new
    while True:
        step = new.join(hop, ["source_id", "at"]).where(~F.array_contains("chain", F.col("callee")) & ~F.array_contains("blocked", F.col("callee")))
        step = step.select("source_id", "tag", F.col("callee").alias("at"), F.struct(F.concat("way", F.array("line", "rank")).alias("way"), F.concat("chain", F.array("callee")).alias("chain"), F.concat("names", F.array("callee_fn")).alias("names"), "blocked").alias("x"))
        step = step.groupBy(key).agg(F.min("x").alias("x"))
        best = seen.groupBy(key).agg(F.min("way").alias("known"))
        step = step.join(best, key, "left").where(F.col("known").isNull() | (F.col("x.way") < F.col("known")))
        new = written(step.select(*key, "x.chain", "x.names", "x.way", "x.blocked"), "ways")
        if new.isEmpty():
            break
        seen = seen.unionByName(new).hint("merge")
    least = F.row_number().over(W.partitionBy(key).orderBy("way"))
    return written(seen.withColumn("r", least).where("r = 1").drop("r", "blocked"), "first_ways")


def later(edges: DataFrame, reach: DataFrame, points: DataFrame) -> DataFrame:
    """(source_id, point, at, bound, before): where the run can go on after each point (source_id, point, chain, way, line).

    A row says that lines of function `at` beyond `bound` run after the point, in the order of
    concat(before, line).  What is left is, from the innermost function of the chain outwards,
    the rest of each function after its call, with all that its later calls reach past
    the functions still running.  In the innermost one the point's own line counts as left; compare
    orders with concat(0, line) to leave it out.
    """
    deep = F.size("chain") - 1
    frames = points.select("source_id", "point", "chain", "way", "line", F.posexplode("chain").alias("i", "caller"))
    inner = F.col("i") == deep
    frames = frames.select(
        "source_id", "point", "caller", (deep - F.col("i")).alias("depth"), F.slice("chain", F.lit(1), F.col("i") + 1).alias("blocked"),
        F.when(inner, F.col("line")).otherwise(F.get("way", 2 * F.col("i"))).alias("after_line"), F.when(inner, F.lit(-1)).otherwise(F.get("way", 2 * F.col("i") + 1)).alias("after_rank"),
    )
    own = frames.select("source_id", "point", F.col("caller").alias("at"), (F.col("after_line") - F.when(F.col("depth") == 0, 1).otherwise(0)).alias("bound"), F.array("depth").alias("before"))
    calls = frames.join(edges.select("source_id", "caller", "line", "rank", "callee", "callee_fn"), ["source_id", "caller"])
    calls = calls.where((F.col("line") > F.col("after_line")) | ((F.col("line") == F.col("after_line")) & (F.col("rank") > F.col("after_rank")))).where(~F.array_contains("blocked", F.col("callee")))
    # A function that is still running is met again only from calls that can lead back to it; only those need ways of their own.
    back = reach.select("source_id", F.col("root").alias("callee"), F.col("fn").alias("met"))
    calls = calls.withColumn("tag", F.concat_ws("/", F.concat_ws(",", F.col("blocked").cast("array<string>")), F.col("callee").cast("string")))
    tied = calls.select("source_id", "tag", "callee", F.explode("blocked").alias("met")).distinct().join(back, ["source_id", "callee", "met"], "left_semi").select("source_id", "tag").distinct()
    calls = calls.join(tied.withColumn("tied", F.lit(True)), ["source_id", "tag"], "left").withColumn("tied", F.coalesce("tied", F.lit(False)))
    calls = calls.withColumn("tag", F.when(F.col("tied"), F.col("tag")).otherwise(F.col("callee").cast("string")))
    calls = written(calls.withColumn("blocked", F.when(F.col("tied"), F.col("blocked")).otherwise(F.array().cast("array<int>"))), "later_calls")
    starts = calls.select("source_id", "tag", F.col("callee").alias("at"), F.col("callee_fn").alias("fn"), "blocked").distinct()
    ways = first_ways(edges, starts).select("source_id", "tag", "at", F.col("way").alias("inside"))
    below = calls.join(ways, ["source_id", "tag"]).select("source_id", "point", "at", F.lit(-1).alias("bound"), F.concat(F.array("depth", "line", "rank"), F.col("inside")).alias("before"))
    return own.unionByName(below)
