"""Writes, external calls and guards of functions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarrymill.functions import patterns as P
from quarrymill.functions.text import all_matches, bracketed, top_parts
from quarrymill.operators.facts import Facts
from quarrymill.operators.graph import Graph
from quarrymill.operators.order import first_ways, later
from quarrymill.operators.symbols import ELEMENTARY, calls_of, library_functions, symbols_of
from quarrymill.storage import written

KEY = ["source_id", "open_i"]


def _any_of(words: list[str]) -> str:
    return "|".join(words)


def write_score(names: Column, code: Column) -> Column:
    """How much a line that writes these state variables matters after a call.

    Each name adds 100 if it holds an asset word, takes 100 if it holds a bookkeeping word,
    and adds 15 if the line indexes, pushes or pops; a field of a user or account record on
    the left side adds 125.
    """
    plain = lambda n: F.regexp_replace(F.lower(n), "[^a-z0-9]", "")
    compact = F.lower(F.regexp_replace(code, r"\s+", ""))
    indexed = F.when(compact.contains("[") | compact.contains(".push(") | compact.contains(".pop("), 15).otherwise(0)
    one = lambda n: F.when(plain(n).rlike(_any_of(P.ASSET_STATE_HINTS)), 100).otherwise(0) - F.when(plain(n).rlike(_any_of(P.BOOKKEEPING_STATE_HINTS)), 100).otherwise(0) + indexed
    left = F.split(code, P.WRITE_OPERATOR, 2)[0]
    return F.aggregate(names, F.lit(0), lambda total, n: total + one(n)) + F.when(left.rlike(P.ALIAS_FIELD), 125).otherwise(0)


class Effects:
    """What functions do.  Only evidence chains (RE11) list each chain of calls, of at most max_calls calls (see call_tree)."""

    def __init__(self, facts: Facts, graph: Graph | None = None, max_calls: int = 5):
        self.facts, self.graph, self.max_calls = facts, graph or Graph(facts), max_calls

    @cached_property
    def line_flags(self) -> DataFrame:
        """Lines of functions with what they write and call.

        A line writes state if it assigns (and neither emits, returns nor checks) and names a
        state variable of the source, assigns a member of a storage alias, names an
        administrative word, or assigns through an index.
        """
        f = self.facts
        lines = f.line_functions
        # names of a source stand beside its lines, which are dealt once
        state = f.state_variables.groupBy("source_id").agg(F.collect_set("name").alias("state"))
        alias = f.storage_aliases.groupBy("source_id").agg(F.collect_set(F.struct(F.col("fn_start").alias("start_line"), F.col("name").alias("base"))).alias("alias"))
        code = F.col("code")
        named = F.array_intersect(all_matches(code, r"[A-Za-z_]\w*"), F.col("state"))
        rows = lines.withColumn("base", F.regexp_extract("code", P.MEMBER_ASSIGN, 1)).join(state, "source_id", "left").join(alias, "source_id", "left")
        rows = rows.withColumn("state_names", named).withColumn("state_names", F.when(F.size("state_names") > 0, F.sort_array("state_names")))
        rows = rows.withColumn("aliased", F.array_contains("alias", F.struct("start_line", "base"))).drop("state", "alias")
        assigns = code.rlike(P.STATE_ASSIGN) | (F.col("base") != "")
        named = F.col("state_names").isNotNull() | F.coalesce("aliased", F.lit(False)) | code.rlike(P.ADMIN_WORDS) | code.rlike(P.INDEX_ASSIGN)
        method = F.lower(F.regexp_extract("code", P.QUALIFIED_CALL, 2))
        external = code.rlike(P.LOW_LEVEL) | (method.isin(P.CALL_METHODS) & ~method.isin(P.READ_METHODS) & ~method.rlike(P.READ_PREFIXES))
        rows = rows.withColumn("writes", ~code.rlike(P.NO_WRITE) & assigns & named)
        rows = rows.withColumn("critical", F.col("writes") & code.rlike(P.SENSITIVE_WORDS)).withColumn("method", method).withColumn("external", external).withColumn("asset", code.rlike(P.ASSET_SINK))
        return written(rows.drop("base", "aliased"), "line_flags")

    @cached_property
    def state_writes(self) -> DataFrame:
        """(source_id, open_i, contract, fn, line, critical, names, score): lines that write state; score by write_score."""
        names = F.coalesce("state_names", F.array().cast("array<string>"))
        return self.line_flags.where("writes").select("source_id", "open_i", "contract", "fn", F.col("line_no").alias("line"), "critical", names.alias("names"), write_score(names, F.col("code")).alias("score"))

    @cached_property
    def external_calls(self) -> DataFrame:
        return self.line_flags.where("external").select("source_id", "open_i", "contract", "fn", F.col("line_no").alias("line"), "method")

    @cached_property
    def direct_effects(self) -> DataFrame:
        """Effects of statements: external calls and writes of the variables of the contract or its bases.

        A call of a member is external if it is low-level, moves assets, may call back or has a
        receiver that is likely a contract: a cast or the result of a call, a stored variable or an
        interface by its declared type (the innermost declaration of the name), or by its name.
        Not external are members that only read, functions of libraries of the source,
        whether named or attached to the receiver's type, and values that are no contracts.

        economic: the call dispatches an order; dynamic_amount: its last argument is no constant
        (and not just the sent value); library_call: a library of others changes a stored receiver; inherited:
        a write by a function of a base that the source does not show, or by super.
        """
        calls = calls_of(self)
        low = F.lower("method")
        libs = library_functions(self)
        named = calls.where("not chained").select("use", "source_id", F.lower("root").alias("library"), low.alias("method")).join(libs, ["source_id", "library", "method"])
        attached = symbols_of(self).attached.select("source_id", "contract", F.lower("library").alias("library"), F.col("type").alias("for"))
        by_type = calls.where("not chained and not called and scope is not null").select("use", "source_id", "contract", "type", low.alias("method")).join(attached, ["source_id", "contract"]).join(libs, ["source_id", "library", "method"])
        short = lambda t: F.regexp_replace(F.regexp_replace(t, r"\s+payable$", ""), r"^(uint|int)$", "$1256")
        by_type = by_type.where((F.col("for") == "*") | (short(F.col("for")) == short(F.col("type"))))
        ours = named.select("use").union(by_type.select("use")).distinct()
        plain = F.col("scope").isNotNull() & F.col("type").rlike(ELEMENTARY) & ~F.col("called") & ~F.col("chained")
        rows = calls.join(ours, "use", "left_anti").where(~low.rlike(P.EFFECT_READS) & ~low.eqNullSafe("staticcall") & ~F.lower("root").isin("abi", "super", "type")).where(~plain)
        yes, no = F.lit(True), F.lit(False)
        library = low.isin(P.STATE_LIBRARY_METHODS) & ~F.col("called") & F.when(F.col("indexed"), F.col("stored")).otherwise(F.col("stored") & ((F.col("scope") != "state") | F.col("type").startswith("mapping")))
        low_level = low.isin("call", "send", "delegatecall")
        economic = low.isin(P.ECONOMIC_METHODS)
        asset = low.isin(P.ASSET_METHODS) | economic
        wrapper = low.isin(P.SAFE_TOKEN_METHODS)
        amount = F.try_element_at(top_parts(bracketed(F.col("rest"))["inner"]), F.lit(-1))
        dynamic = (F.col("options") == "") & amount.isNotNull() & ~amount.rlike(P.CONSTANT_AMOUNT) & ~(amount.rlike(P.MESSAGE_VALUE) & ~amount.rlike(P.AMOUNT_WORDS))
        likely = ~low.isin(P.VALUE_LIBRARY_METHODS) & (F.col("called") | F.col("stored") | F.col("root").rlike(P.EXTERNAL_ROOTS) | F.coalesce(F.col("type").rlike(P.INTERFACE_TYPE), no))
        hook = (low.rlike(P.CALLBACK_NAMES) | (F.col("called") & F.lower("call").rlike(r"hook|callback|receiver|recipient|handler|plugin"))) & ~economic
        callback = hook | low_level | (asset & ~wrapper & ~economic) | (wrapper & dynamic) | (likely & ~low.isin("approve", "safeapprove") & ~wrapper & ~economic)
        flags = ["low_level", "asset_call", "callback_capable", "inherited", "economic", "dynamic_amount", "library_call"]
        rows = rows.withColumns({"library_call": library, "low_level": low_level, "economic": economic, "asset_call": asset | (low.eqNullSafe("call") & F.col("options").contains("value")), "dynamic_amount": F.coalesce(dynamic, no), "callback_capable": callback, "inherited": no, "likely": likely})
        cols = [*KEY, "fn", "line", "end_line"]
        stored = rows.where("library_call").select(*cols, F.lit("state_write").alias("kind"), "method", "receiver", *[(yes if f == "library_call" else no).alias(f) for f in flags])
        external = rows.where("not library_call").where(F.col("low_level") | F.col("asset_call") | F.col("callback_capable") | F.col("likely") | F.col("text").rlike(P.EXTERNAL_EFFECT))
        external = external.select(*cols, F.lit("external_call").alias("kind"), "method", "receiver", *flags)
        st = self.facts.statements.where("not is_modifier").withColumnRenamed("start_line", "line")
        bare = st.select(*cols, "text", F.explode(all_matches(F.col("text"), P.BARE_EXTERNAL, 1)).alias("method"))
        last = F.try_element_at(top_parts(bracketed(F.expr("substring(text, locate('(', text, locate(method, text)))"))["inner"]), F.lit(-1))
        moves = last.isNotNull() & ~last.rlike(P.CONSTANT_AMOUNT)
        bare = bare.select(*cols, F.lit("external_call").alias("kind"), "method", F.lit("").alias("receiver"), no.alias("low_level"), yes.alias("asset_call"), moves.alias("callback_capable"), no.alias("inherited"), no.alias("economic"), moves.alias("dynamic_amount"), no.alias("library_call"))
        target = r"(?:^|[;{}(]\s*|\)\s*)(?:delete\s+)?([A-Za-z_]\w*)(?:\s*\[[^\]]*\])*(?:\s*\.\s*\w+)*\s*(?:=(?![=>])|\+=|-=|\*=|/=|\+\+|--|\.push|\.pop|;)"
        writes = st.select(*cols, "contract", F.regexp_extract("text", target, 1).alias("name"))
        scope = symbols_of(self).state.select("source_id", "contract", "name").distinct()
        write = lambda df, method, receiver, inherited: df.select(*cols, F.lit("state_write").alias("kind"), method.alias("method"), receiver.alias("receiver"), *[(inherited if f == "inherited" else no).alias(f) for f in flags])
        writes = write(writes.join(scope, ["source_id", "contract", "name"]), F.lit(""), F.col("name"), no)
        up = write(st.select(*cols, F.explode(all_matches(F.col("text"), r"\bsuper\s*\.\s*([A-Za-z_]\w*)\s*\(", 1)).alias("method")), F.col("method"), F.lit("super"), yes)
        # a bare call of a name that no function of the source has: a base that is not shown changes state
        code = F.regexp_replace("text", r"\b(?:emit|new|revert|function|modifier|returns?\s*\()\s*[A-Za-z_]\w*\s*\(", " ")
        unseen = st.select(*cols, F.explode(F.array_distinct(all_matches(code, P.BARE_CALL, 1))).alias("method")).where(F.col("method").rlike(P.INHERITED_WRITES))
        known = self.facts.functions.select("source_id", F.lower("fn").alias("key")).distinct()
        unseen = unseen.withColumn("key", F.lower("method")).join(known, ["source_id", "key"], "left_anti")
        unseen = write(unseen, F.col("method"), F.lit(""), yes)
        return written(external.unionByName(stored).unionByName(bare).unionByName(writes).unionByName(up).unionByName(unseen), "effects")

    @cached_property
    def write_closure(self) -> DataFrame:
        """(source_id, root, lines): lines that write state, in the function or in what it reaches."""
        w = self.state_writes.select("source_id", F.col("open_i").alias("fn"), "line")
        return self.graph.reach.join(w, ["source_id", "fn"]).groupBy("source_id", "root").agg(F.sort_array(F.collect_set("line")).alias("lines"))

    @cached_property
    def guards(self) -> DataFrame:
        """One row a function: line-level guards, authorization status with evidence lines, mutex."""
        f = self.facts
        names = F.array_join(F.col("modifiers"), " ")
        rows = f.functions.join(f.bodies.select(*KEY, "body"), KEY, "left").withColumn("body", F.coalesce("body", F.lit("")))
        auth = names.rlike(P.AUTH_WORDS) | F.col("body").rlike(P.SENDER_CHECK)
        mutex = names.rlike(P.MUTEX_WORDS) | F.col("body").rlike(P.MUTEX_BODY)
        used = rows.select(*KEY, F.col("start_line").alias("fn_start"), F.explode("modifiers").alias("modifier"))
        texts = f.statements.where("is_modifier").groupBy("source_id", F.col("fn").alias("modifier")).agg(F.min("fn_start").alias("defined"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("stmt_no", "text"))), lambda x: x["text"]), "\n").alias("m_body"))
        used = used.join(texts, ["source_id", "modifier"], "left")
        identity = F.when(F.col("defined").isNotNull(), F.col("m_body").rlike(P.IDENTITY_CHECK) | F.col("m_body").rlike(P.IDENTITY_CALL)).otherwise(F.col("modifier").rlike(P.AUTH_WORDS))
        lock = r"(?is)\b(?:require|assert|if)\s*\([^;{}]*(?:_?status|_?entered|_?locked|mutex).*\b(?:_?status|_?entered|_?locked|mutex)\b\s*=.*(?<!\w)_(?!\w).*\b(?:_?status|_?entered|_?locked|mutex)\b\s*="
        locked = F.when(F.col("defined").isNotNull(), F.col("m_body").rlike(lock)).otherwise(F.col("modifier").rlike(P.MUTEX_WORDS))
        by_modifier = used.groupBy(*KEY).agg(
            F.max(identity).alias("identity"), F.min(F.when(identity, F.coalesce("defined", "fn_start"))).alias("identity_line"),
            F.max(F.lower("modifier").startswith("only")).alias("only"), F.max(locked).alias("lock"), F.min(F.when(locked, F.coalesce("defined", "fn_start"))).alias("lock_line"),
        )
        at = lambda p: F.sort_array(F.collect_set(F.when(F.col("code").rlike(p), F.col("line_no"))))
        lines = f.line_functions.groupBy(*KEY).agg(at(P.ORIGIN).alias("origin_lines"), at(P.IDENTITY_CHECK + "|" + P.IDENTITY_CALL).alias("identity_lines"))
        rows = rows.join(by_modifier, KEY, "left").join(lines, KEY, "left")
        yes = lambda c: F.coalesce(c, F.lit(False))
        status = F.when(yes(F.col("identity")), "effective_identity").when(F.size("origin_lines") > 0, "tx_origin_identity").when(F.size("identity_lines") > 0, "effective_identity").when(yes(F.col("only")), "unclassified_only_modifier").otherwise("none")
        none = F.array().cast("array<int>")
        evidence = F.when(yes(F.col("identity")), F.array("identity_line")).when(F.size("origin_lines") > 0, F.col("origin_lines")).when(F.size("identity_lines") > 0, F.col("identity_lines")).when(yes(F.col("only")), F.array("start_line")).otherwise(none)
        rows = rows.select(
            *KEY, "contract", "fn", "start_line", "visibility", "mutability", "is_constructor", "modifiers", "body", auth.alias("auth_guard"), mutex.alias("mutex_guard"),
            status.alias("auth_status"), evidence.alias("auth_lines"), yes(F.col("lock")).alias("mutex"), F.when(yes(F.col("lock")), F.array("lock_line")).otherwise(none).alias("mutex_lines"),
        )
        return written(rows, "guards")

    @cached_property
    def admin_restricted(self) -> DataFrame:
        """(source_id, open_i, contract, fn, restricted): not public, a modifier for administrators, or a check of the sender's role in the body.

        A check of tx.origin does not restrict, nor does a modifier of another name.
        """
        modifier = F.exists("modifiers", lambda m: F.lower(m).isin(P.ADMIN_MODIFIERS))
        checked = F.lit(False)
        for pattern in P.ADMIN_CHECKS:
            checked = checked | F.col("body").rlike(pattern)
        return written(self.guards.select(*KEY, "contract", "fn", (~F.col("visibility").isin("public", "external", "") | modifier | checked).alias("restricted")), "restricted")

    @cached_property
    def call_tree(self) -> DataFrame:
        """(source_id, root, at, chain, names, way): every chain of calls from a callable root, cut where it would enter a function twice; way holds the lines of its calls.

        A chain has at most max_calls calls, as chains can double with each further one;
        cut_chains has those that go on.
        """
        roots = self.graph.roots.select("source_id", F.col("open_i").alias("root"), F.col("open_i").alias("at"), F.array("open_i").alias("chain"), F.array("fn").alias("names"), F.array().cast("array<int>").alias("way"))
        edges = self.graph.edges.select("source_id", F.col("caller").alias("at"), "line", "callee", "callee_fn")
        level = written(roots, "calls")
        tree = level
        for _ in range(self.max_calls):
            level = level.join(edges, ["source_id", "at"]).where(~F.array_contains("chain", F.col("callee")))
            level = written(level.select("source_id", "root", F.col("callee").alias("at"), F.concat("chain", F.array("callee")).alias("chain"), F.concat("names", F.array("callee_fn")).alias("names"), F.concat("way", F.array("line")).alias("way")), "calls")
            if level.isEmpty():
                break
            tree = tree.unionByName(level).hint("merge")
        return tree

    @cached_property
    def cut_chains(self) -> DataFrame:
        """The chains of call_tree that were left at max_calls calls although their last function calls on."""
        edges = self.graph.edges.select("source_id", F.col("caller").alias("at"), "callee")
        ends = self.call_tree.where(F.size("way") == self.max_calls).join(edges, ["source_id", "at"]).where(~F.array_contains("chain", F.col("callee")))
        return ends.drop("callee").distinct()

    @cached_property
    def ways(self) -> DataFrame:
        """(source_id, root, at, chain, names, way): where each callable root first enters each function that it reaches, at any depth."""
        starts = self.graph.roots.select("source_id", F.col("open_i").cast("string").alias("tag"), F.col("open_i").alias("at"), "fn", F.array().cast("array<int>").alias("blocked"))
        return first_ways(self.graph.edges, starts).withColumn("root", F.col("chain")[0]).drop("tag")

    @cached_property
    def runtime_events(self) -> DataFrame:
        """(source_id, root, step, kind, line, fn_id, chain, way, order): effects of each callable root in the order in which they first run.

        An effect that runs more than once, as its function is called again, stands where it
        runs first.  On a line, what the line does itself comes before what it calls.
        """
        events = self.external_calls.select("source_id", F.col("open_i").alias("at"), "line", F.lit("call").alias("kind")).union(self.state_writes.select("source_id", F.col("open_i").alias("at"), "line", F.lit("write").alias("kind")))
        rows = self.ways.join(events, ["source_id", "at"]).select("source_id", "root", F.col("at").alias("fn_id"), "line", "kind", "chain", "way", F.concat("way", F.array("line")).alias("order"))
        step = F.row_number().over(W.partitionBy("source_id", "root").orderBy("order", "kind"))
        return written(rows.withColumn("step", step), "events")

    @cached_property
    def reentrancy_summary(self) -> DataFrame:
        """One row a callable root with events: first call, first write after it, whether a mutex stands, order complete.

        The write may be one that also ran before the call: what runs after the call is followed by itself (see order.later).
        """
        e = self.runtime_events
        rows = e.groupBy("source_id", "root").agg(
            F.min(F.when(F.col("kind") == "call", F.struct("order", "line", "chain", "way"))).alias("call"),
            F.sort_array(F.collect_set(F.when((F.col("kind") == "write") & (F.col("fn_id") != F.col("root")), F.col("line")))).alias("cross_lines"),
        )
        rows = written(rows, "first_calls")
        points = rows.where("call is not null").select("source_id", F.col("root").alias("point"), "call.chain", "call.way", "call.line")
        writes = self.state_writes.select("source_id", F.col("open_i").alias("at"), "line")
        after = later(self.graph.edges, self.graph.reach, points).join(writes, ["source_id", "at"]).where("line > bound")
        after = after.groupBy("source_id", F.col("point").alias("root")).agg(F.min_by("line", F.concat("before", F.array("line"))).alias("write_line"))
        rows = rows.join(after, ["source_id", "root"], "left").select("source_id", "root", F.col("call.line").alias("call_line"), "write_line", "cross_lines")
        g = self.guards.select("source_id", F.col("open_i").alias("root"), "fn", "mutex")
        rows = rows.join(g, ["source_id", "root"])
        rows = rows.withColumn("reentrant_order", F.col("call_line").isNotNull() & F.col("write_line").isNotNull()).withColumn("cei_complete", F.col("call_line").isNotNull() & F.col("write_line").isNull())
        return written(rows, "summary")
