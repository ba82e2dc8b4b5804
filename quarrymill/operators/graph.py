"""Calls between functions, and what is reached through them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarrymill.functions.patterns import BARE_CALL
from quarrymill.functions.text import all_matches
from quarrymill.operators.facts import CONTROL_WORDS, Facts
from quarrymill.storage import written


def closure(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(source_id, a, b, depth): b reached from a, each with its least depth; a reaches itself at depth 0.

    Semi-naive: each round joins the newest pairs with the edges (source_id, a, b) and keeps
    what was not seen.  Rounds are written to the shared folder, so lineage stays short.
    """
    edges = edges.select("source_id", F.col("a").alias("x"), F.col("b").alias("y")).distinct().hint("merge")
    if starts is None:
        starts = edges.select("source_id", F.col("x").alias("a")).union(edges.select("source_id", F.col("y").alias("a"))).distinct()
    new = starts.select("source_id", "a", F.col("a").alias("b"), F.lit(0).alias("depth"))
    seen, depth = written(new, "closure"), 0
    new = seen
    while True:
        depth += 1
        step = new.select("source_id", "a", F.col("b").alias("x")).join(edges, ["source_id", "x"]).select("source_id", "a", F.col("y").alias("b"), F.lit(depth).alias("depth")).distinct()
        new = written(step.join(seen, ["source_id", "a", "b"], "left_anti"), "closure")
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new).hint("merge")


class Graph:
    """Call edges and reachability of the functions of Facts; a function is (source_id, open_i)."""

    def __init__(self, facts: Facts):
        self.facts = facts

    @cached_property
    def ancestors(self) -> DataFrame:
        """(source_id, contract, ancestor, depth): a contract itself and all its bases in the same source."""
        c = self.facts.contracts
        bases = c.select("source_id", F.col("contract").alias("a"), F.explode("bases").alias("b")).join(c.select("source_id", F.col("contract").alias("b")), ["source_id", "b"], "left_semi")
        reached = closure(bases.select("source_id", "a", "b"), c.select("source_id", F.col("contract").alias("a")))
        return reached.select("source_id", F.col("a").alias("contract"), F.col("b").alias("ancestor"), "depth")

    @cached_property
    def edges(self) -> DataFrame:
        """(source_id, caller, caller_fn, line, callee, callee_fn, rank): bare calls in scope, the nearest contract first; super goes to direct bases.

        rank is the place of the call among those of its line: bare calls as they stand, then those of super.
        """
        lines = self.facts.line_functions
        code = F.regexp_replace("code", r"\b(?:emit|new|function|modifier)\s+[A-Za-z_]\w*\s*\(", " ")
        bare = lines.select("source_id", "contract", F.col("open_i").alias("caller"), F.col("fn").alias("caller_fn"), F.col("line_no").alias("line"), F.posexplode(F.array_distinct(all_matches(code, BARE_CALL, 1))).alias("place", "name"))
        bare = bare.where(~F.lower("name").isin(CONTROL_WORDS))
        up = lines.select("source_id", "contract", F.col("open_i").alias("caller"), F.col("fn").alias("caller_fn"), F.col("line_no").alias("line"), F.posexplode(F.array_distinct(all_matches(F.col("code"), r"\bsuper\s*\.\s*([A-Za-z_]\w*)\s*\(", 1))).alias("place", "name"))
        f = self.facts.functions.select("source_id", F.col("contract").alias("ancestor"), F.lower("fn").alias("key"), F.col("fn").alias("callee_fn"), F.col("open_i").alias("callee"))
        scope = self.ancestors
        files = bare.where("contract = ''").select("source_id", "contract", F.lit("").alias("ancestor"), F.lit(0).alias("depth")).distinct()
        found = bare.join(scope.unionByName(files), ["source_id", "contract"]).withColumn("key", F.lower("name")).join(f, ["source_id", "ancestor", "key"])
        near = F.rank().over(W.partitionBy("source_id", "caller", "line", "key").orderBy("depth"))
        found = found.withColumn("r", near).where("r = 1 and callee <> caller")
        sup = up.join(scope.where("depth = 1"), ["source_id", "contract"]).withColumn("key", F.lower("name")).join(f, ["source_id", "ancestor", "key"])
        cols = ["source_id", "caller", "caller_fn", "line", "callee", "callee_fn"]
        both = found.select(*cols, F.lit(0).alias("up"), "place").union(sup.select(*cols, F.lit(1).alias("up"), "place"))
        both = both.groupBy(cols).agg(F.min(F.struct("up", "place")).alias("at"))
        rank = F.row_number().over(W.partitionBy("source_id", "caller", "line").orderBy("at", "callee"))
        return written(both.select(*cols, rank.alias("rank")), "edges")

    @cached_property
    def reach(self) -> DataFrame:
        """(source_id, root, fn, depth): all functions reached from each function, itself included."""
        pairs = self.edges.select("source_id", F.col("caller").alias("a"), F.col("callee").alias("b"))
        all_ = self.facts.functions.select("source_id", F.col("open_i").alias("a"))
        return closure(pairs, all_).select("source_id", F.col("a").alias("root"), F.col("b").alias("fn"), "depth")

    @cached_property
    def roots(self) -> DataFrame:
        """Functions that can be called from outside (no visibility counts as callable), without constructors."""
        return self.facts.functions.where("visibility in ('public', 'external', '') and not is_constructor")

    @cached_property
    def reachable_roots(self) -> DataFrame:
        """(source_id, root, root_fn, fn_id, fn, depth) for callable roots."""
        f = self.facts.functions
        r = self.roots.select("source_id", F.col("open_i").alias("root"), F.col("fn").alias("root_fn"))
        return written(self.reach.withColumnRenamed("fn", "fn_id").join(r, ["source_id", "root"]).join(f.select("source_id", F.col("open_i").alias("fn_id"), "fn"), ["source_id", "fn_id"]), "reachable_roots")

    @cached_property
    def unreachable(self) -> DataFrame:
        entry = self.facts.functions.where("visibility in ('public', 'external', '') or is_constructor or is_fallback or is_receive")
        seen = self.reach.join(entry.select("source_id", F.col("open_i").alias("root")), ["source_id", "root"]).select("source_id", F.col("fn").alias("open_i")).distinct()
        return self.facts.functions.join(seen, ["source_id", "open_i"], "left_anti")

    @cached_property
    def paths(self) -> DataFrame:
        """(source_id, fn, path): a shortest chain of names from an entry to each function, the first by name on ties."""
        f = self.facts.functions
        entry = self.roots.select("source_id", F.col("open_i").alias("at"), F.array("fn").alias("path"))
        level, out = written(entry, "paths"), None
        out = level
        edges = self.edges.select("source_id", F.col("caller").alias("at"), F.col("callee").alias("to"), "callee_fn").distinct()
        while True:
            step = level.join(edges, ["source_id", "at"]).select("source_id", F.col("to").alias("at"), F.concat("path", F.array("callee_fn")).alias("path"))
            step = step.join(out, ["source_id", "at"], "left_anti").groupBy("source_id", "at").agg(F.min("path").alias("path"))
            level = written(step, "paths")
            if level.isEmpty():
                break
            out = out.unionByName(level).hint("merge")
        return out.join(f.select("source_id", F.col("open_i").alias("at"), "fn"), ["source_id", "at"]).select("source_id", "at", "fn", "path")

    def neighbourhood(self, selected: DataFrame) -> DataFrame:
        """(source_id, open_i, hops): the selected functions and helpers up to two calls away."""
        near = self.reach.join(selected.select("source_id", F.col("open_i").alias("root")), ["source_id", "root"]).where("depth <= 2")
        return near.groupBy("source_id", F.col("fn").alias("open_i")).agg(F.min("depth").alias("hops"))

    @cached_property
    def public_callers(self) -> DataFrame:
        """(source_id, fn_id, fn, callers): for each function that is not callable itself, the roots that reach it."""
        r = self.reachable_roots.where("depth > 0")
        return r.groupBy("source_id", "fn_id", "fn").agg(F.sort_array(F.collect_set("root_fn")).alias("callers"))
