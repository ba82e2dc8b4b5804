"""Rules: each takes Effects and returns candidates (source_id, rule_id, risk_type, fn, line, ...).

All lines are joined, windowed or aggregated per source and function; a rule never walks a
single source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarrymill.functions import patterns as P
from quarrymill.functions.text import all_matches, bracketed, top_parts
from quarrymill.operators.effects import KEY, Effects
from quarrymill.operators.facts import words_of
from quarrymill.operators.symbols import ELEMENTARY, calls_of
from quarrymill.storage import once

CANDIDATE = "source_id, rule_id, rule_order, risk_type, contract, fn, entrypoint, sink, line, sink_line, evidence_lines, state_write_lines, operation_lines, confidence, evidence_kind, reason, open_i"
_NONE = "array<int>"
#: Rules in the order in which their candidates win over later equal ones.
ORDER = ["AC1", "AC2", "AC5", "AC6", "AC8", "RE1", "RE2", "RE5", "UC1", "UC3", "UC6", "AR1", "AR5", "FR6", "GR8", "TM5", "TM6", "TM12", "PS1", "AC7", "RE4", "RE6", "RE7", "AR4", "AR6", "FR4", "FR5", "TM4", "TM7", "TM8", "TM11"]


def _candidates(df: DataFrame, rule: str, risk: str, confidence: float | Column, kind: str | Column, reason: Column, **cols) -> DataFrame:
    col = lambda n, default: cols[n] if n in cols else default
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    evidence = F.array_sort(F.array_distinct(F.filter(col("evidence_lines", F.array("line")), lambda x: x.isNotNull()))).cast(_NONE)
    return df.select(
        F.col("source_id"), F.lit(rule).alias("rule_id"), F.lit(ORDER.index(rule)).alias("rule_order"), F.lit(risk).alias("risk_type"), F.col("contract"), F.col("fn"),
        col("entrypoint", F.col("fn")).alias("entrypoint"), col("sink", F.col("fn")).alias("sink"), F.col("line").cast("int").alias("line"), col("sink_line", F.lit(None)).cast("int").alias("sink_line"),
        evidence.alias("evidence_lines"), col("state_write_lines", F.array()).cast(_NONE).alias("state_write_lines"), col("operation_lines", F.array()).cast(_NONE).alias("operation_lines"),
        lit(confidence).cast("double").alias("confidence"), lit(kind).alias("evidence_kind"), reason.alias("reason"), F.col("open_i"),
    )


def _callable(e: Effects) -> DataFrame:
    return e.guards.where("visibility in ('public', 'external') and not is_constructor")


def _lines_of(df: DataFrame, name: str, condition: Column, most: int = 6) -> DataFrame:
    """(source_id, open_i, name): up to `most` first lines of each function that meet the condition."""
    return df.where(condition).groupBy(*KEY).agg(F.slice(F.sort_array(F.collect_set("line_no")), 1, most).alias(name))


@once
def rule_ac1(e: Effects) -> DataFrame:
    """A modifier that authorises by tx.origin guards a public function that writes critical state or moves assets."""
    m = e.facts.statements.where("is_modifier").where(F.col("text").rlike(P.ORIGIN))
    m = m.where(F.col("text").rlike(P.ORIGIN_CHECK) & ~F.col("text").rlike(P.ORIGIN_IS_SENDER)).groupBy("source_id", F.col("fn").alias("modifier")).agg(F.min("start_line").alias("line"))
    used = _callable(e).where("mutability not in ('view', 'pure')").select(*KEY, "contract", "fn", F.explode("modifiers").alias("modifier"))
    writes = _lines_of(e.line_flags, "writes_at", F.col("critical"), 4)
    assets = _lines_of(e.line_flags, "assets_at", F.col("asset"), 4)
    rows = used.join(m, ["source_id", "modifier"]).join(writes, KEY, "left").join(assets, KEY, "left").withColumn("w", F.coalesce("writes_at", "assets_at")).where("w is not null")
    return _candidates(rows, "AC1", "access_control", 0.93, "tx_origin_modifier_authorization", F.concat(F.lit("modifier "), "modifier", F.lit("() authorises by tx.origin before "), "fn", F.lit("()")), evidence_lines=F.concat(F.array("line"), "w"), state_write_lines=F.col("w"))


@once
def rule_ac2(e: Effects) -> DataFrame:
    """A public function without authority writes critical state itself, under an administrative name, or through what it reaches."""
    critical = _lines_of(e.line_flags, "at", F.col("critical"), 6)
    f = e.facts.functions.select("source_id", F.col("open_i").alias("target"), F.col("fn").alias("target_fn"), F.col("start_line").alias("target_line"), F.col("end_line").alias("target_end"))
    root = _callable(e).where("not auth_guard").select(*KEY, "contract", "fn", "start_line", "body")
    reach = e.graph.reach.select("source_id", F.col("root").alias("open_i"), F.col("fn").alias("target"))
    rows = root.join(reach, KEY).join(f, ["source_id", "target"]).join(critical.withColumnRenamed("open_i", "target"), ["source_id", "target"])
    first = F.row_number().over(W.partitionBy(*KEY).orderBy("target_line", "target_end", F.lower("target_fn")))
    own = F.max(F.when(F.col("target") == F.col("open_i"), F.col("at"))).over(W.partitionBy(*KEY))
    rows = rows.withColumn("r", first).withColumn("own", own).where("r = 1")
    initializer = F.lower("fn").isin("initialize", "init") & ~F.col("body").rlike(r"(?i)\b(?:initializer|reinitializer|onlyinitializing)\b")
    named = initializer | F.col("fn").rlike(P.ADMIN_NAMES)
    admin = named & F.col("own").isNotNull()
    helper = F.col("target") != F.col("open_i")
    sensible = helper | F.col("fn").rlike(P.SENSITIVE_WORDS) | F.col("body").rlike(P.ADMIN_SINK_WORDS)
    rows = rows.withColumn("admin", admin).where((named & admin) | (~(named & admin) & sensible))
    at = F.when(F.col("admin"), F.col("own")).otherwise(F.col("at"))
    rows = rows.withColumn("at", at).withColumn("line", F.col("at")[0]).withColumn("sink", F.when(F.col("admin"), F.col("fn")).otherwise(F.col("target_fn")))
    reason = F.concat(F.lit("anyone can change what "), "sink", F.lit("() stores by calling "), "fn", F.lit("()"))
    return _candidates(rows, "AC2", "access_control", F.when(F.col("admin"), 0.91).otherwise(0.88), "unprotected_critical_state_write", reason, sink=F.col("sink"), evidence_lines=F.concat(F.array("start_line"), "at"), state_write_lines=F.col("at"))


@once
def rule_ac5(e: Effects) -> DataFrame:
    """tx.origin handed to an asset call, or stored."""
    st = e.facts.statements.where("not is_modifier").where(F.col("text").rlike(P.ORIGIN) & ~F.col("text").rlike(r"^emit\b") & ~F.col("text").rlike(P.ORIGIN_IS_SENDER))
    rows = st.withColumn("line", F.col("start_line")).join(e.guards.where("visibility in ('public', 'external')").select(*KEY), KEY)
    asset = F.col("text").rlike(r"(?i)\.\s*(?:transfer|transferFrom|send|mint|safeTransfer|approve|call)\s*(?:\{[^}]*\}\s*)?\([^;]*tx\s*\.\s*origin")
    stored = F.col("text").rlike(r"(?i)=\s*[^=;]*\btx\s*\.\s*origin") & ~F.col("text").rlike("(?i)^(?:require|assert|if)")
    kind = F.when(asset, "tx_origin_asset_argument").when(stored, "tx_origin_state_value")
    return _candidates(rows.withColumn("kind", kind).where("kind is not null"), "AC5", "access_control", 0.9, F.col("kind"), F.concat("fn", F.lit("() uses tx.origin as a value")))


@once
def rule_ac6(e: Effects) -> DataFrame:
    """Native ether goes to the caller, without authority and without a debit of the caller before."""
    lines = e.line_flags
    send = lines.where(F.col("code").rlike(r"(?i)msg\s*\.\s*sender\s*\)?\s*\.\s*(?:transfer|send|call)\b")).select(*KEY, "contract", "fn", F.col("line_no").alias("line"))
    debit = lines.where(F.col("writes") & F.col("code").rlike(r"(?i)\[\s*msg\s*\.\s*sender\s*\]\s*(?:-=|=)")).select(*KEY, F.col("line_no").alias("debit"))
    free = _callable(e).where("not auth_guard").select(*KEY)
    rows = send.join(free, KEY).join(debit, KEY, "left").groupBy(*KEY, "contract", "fn", "line").agg(F.max(F.col("debit") < F.col("line")).alias("before")).where("not coalesce(before, false)")
    return _candidates(rows, "AC6", "access_control", 0.8, "unauthorized_native_transfer", F.concat("fn", F.lit("() sends ether to its caller without authority or debit")))


@once
def rule_ac8(e: Effects) -> DataFrame:
    """A super call that may write, reached from a callable root."""
    up = e.direct_effects.where("inherited").select("source_id", F.col("open_i").alias("fn_id"), "line", "method", F.col("fn").alias("holder"))
    roots = e.graph.reachable_roots.select("source_id", F.col("root").alias("open_i"), F.col("root_fn").alias("fn"), "fn_id")
    g = _callable(e).where("not auth_guard").select(*KEY, "contract")
    rows = up.join(roots, ["source_id", "fn_id"]).join(g, KEY)
    return _candidates(rows, "AC8", "access_control", 0.6, "inherited_effect_propagation", F.concat("fn", F.lit("() reaches super."), "method", F.lit("()")), sink=F.col("holder"))


@once
def rule_re1(e: Effects) -> DataFrame:
    """An external call before a later state write among what a root reaches, without a mutex; first call of each function."""
    root = _callable(e).where("not mutex_guard").select(*KEY, "contract", "fn", "visibility")
    reach = e.graph.reach.select("source_id", F.col("root").alias("open_i"), F.col("fn").alias("at"))
    free = e.guards.where("not mutex_guard").select("source_id", F.col("open_i").alias("at"), F.col("fn").alias("at_fn"))
    calls = e.external_calls.select("source_id", F.col("open_i").alias("at"), "line")
    pairs = root.join(reach, KEY)
    writes = pairs.join(e.state_writes.select("source_id", F.col("open_i").alias("at"), F.col("line").alias("w"), F.col("fn").alias("w_fn")), ["source_id", "at"]).select(*KEY, "w", "w_fn")
    rows = pairs.join(free, ["source_id", "at"]).join(calls, ["source_id", "at"]).join(writes, KEY).where("w > line")
    rows = rows.groupBy(*KEY, "contract", "fn", "at", "at_fn", "line").agg(F.min(F.struct("w", "w_fn")).alias("first"))
    one = F.row_number().over(W.partitionBy(*KEY, "at").orderBy("line"))
    rows = rows.withColumn("r", one).where("r = 1")
    across = (F.col("at_fn") != F.col("fn")) | (F.col("first.w_fn") != F.col("fn"))
    reason = F.concat("fn", F.lit("(): a call out of "), "at_fn", F.lit("() at @L"), F.col("line").cast("string"), F.lit(" comes first, stored state changes later at @L"), F.col("first.w").cast("string"))
    return _candidates(rows.withColumn("across", across), "RE1", "reentrancy", 0.84, F.when(F.col("across"), "interprocedural_external_call_before_state_write").otherwise("external_call_before_state_write"), reason, sink=F.col("at_fn"), sink_line=F.col("first.w"), evidence_lines=F.array("line", "first.w"), state_write_lines=F.array("first.w"))


@once
def rule_re2(e: Effects) -> DataFrame:
    """Call then write in run-time order, from the reentrancy summary; no mutex."""
    rows = e.reentrancy_summary.where("reentrant_order and not mutex").withColumnRenamed("root", "open_i").withColumn("line", F.col("call_line"))
    rows = rows.join(e.guards.select(*KEY, "contract"), KEY)
    return _candidates(rows, "RE2", "reentrancy", 0.86, "source_event_sequence", F.concat("fn", F.lit("() calls out before it writes")), sink_line=F.col("write_line"), evidence_lines=F.array("line", "write_line"), state_write_lines=F.array("write_line"))


@once
def rule_re5(e: Effects) -> DataFrame:
    """Control goes to others before an asset action of the same function, without a mutex, in three forms.

    A low-level call, or a call of a cast that may call back, before the first later external
    asset action (one row a function); a token transfer before the first later mint; a safe mint
    to a receiver of the user's choice after a critical write and before an asset action.
    """
    from quarrymill.operators import flows as L

    free = e.guards.where("not mutex_guard and not is_constructor").select(*KEY)
    assets = L.asset_events(e).select(*KEY, F.col("line").alias("action"), "family", "method", "place").hint("merge")
    found = L.callbacks(e)
    low = found.where(F.col("code").rlike(r"(?i)\.\s*(?:call|send)\s*(?:\{[^}\n]*\}\s*)?\(|\.\s*call\s*\.\s*value\s*\(") & ~F.col("code").rlike(P.ORIGIN_CALL)).withColumn("hands", F.lit("low_level_value_call"))
    cast = r"\b[A-Za-z_]\w*\s*\(\s*[A-Za-z_]\w*\s*\)\s*\.\s*([A-Za-z_]\w*)\s*\("
    casts = e.line_flags.where(F.exists(all_matches(F.col("code"), cast, 1), lambda m: F.lower(m).isin(P.CAST_CALLBACKS))).where(~F.col("code").rlike(P.EMPTY_SWAP)).select(*KEY, "contract", "fn", F.col("line_no").alias("line"), F.lit("qualified_external_callback").alias("hands"))
    opens = low.select(*KEY, "contract", "fn", "line", "hands").union(casts.join(low.select(*KEY, "line"), [*KEY, "line"], "left_anti").select(*KEY, "contract", "fn", "line", "hands"))
    first = opens.join(free, KEY).join(assets.where("family = 'external'"), KEY).where("action > line").groupBy(*KEY, "contract", "fn", "line", "hands").agg(F.min("action").alias("action"))
    one = F.row_number().over(W.partitionBy(*KEY).orderBy("line"))
    first = first.withColumn("r", one).where("r = 1").withColumn("c", F.when(F.col("hands") == "low_level_value_call", 0.95).otherwise(0.85)).drop("r")
    mints = found.where("callback = 'token_transfer'").join(free, KEY).join(assets.where("family = 'mint'"), KEY).where("action > line")
    mints = mints.groupBy(*KEY, "contract", "fn", "line").agg(F.min("action").alias("action")).withColumn("hands", F.lit("token_transfer")).withColumn("c", F.lit(0.85))
    rows = first.unionByName(mints)
    reason = F.concat("fn", F.lit("() hands control away at @L"), F.col("line").cast("string"), F.lit(" and moves assets after it at @L"), F.col("action").cast("string"))
    ordered = _candidates(rows, "RE5", "reentrancy", F.col("c"), F.concat("hands", F.lit("_before_external_asset_action")), reason, sink_line=F.col("action"), evidence_lines=F.array("line", "action"))
    lines = e.line_flags.join(_callable(e).where("not mutex_guard").select(*KEY), KEY).hint("merge")
    receiver = F.get(top_parts(bracketed(F.regexp_extract("code", r"(?i)_?safeMint\s*(\(.*)$", 1))["inner"]), F.lit(0))
    mint = lines.where(F.col("code").rlike(P.SAFE_MINT) & receiver.rlike(P.USER_RECEIVER)).select(*KEY, "contract", "fn", F.col("line_no").alias("line"))
    before = lines.where("critical").select(*KEY, F.col("line_no").alias("w"))
    after = lines.where(F.col("code").rlike(P.ASSET_ACTION)).select(*KEY, F.col("line_no").alias("a"))
    rows = mint.join(before, KEY).where("w < line").join(after, KEY).where("a > line").groupBy(*KEY, "contract", "fn", "line").agg(F.min("a").alias("action"), F.max("w").alias("write"))
    return ordered.unionByName(_candidates(rows, "RE5", "reentrancy", 0.86, "post_state_update_receiver_callback", F.concat("fn", F.lit("() mints to a receiver between a write and an asset action")), sink_line=F.col("action"), evidence_lines=F.array("line", "action"), state_write_lines=F.array("write")))


@once
def call_decisions(e: Effects) -> DataFrame:
    """One row for each low-level call: method, bindings, later checks and a state.

    refuted: the result feeds a control, or a bound name is checked later in the function;
    unresolved: it is returned, emitted or passed on; confirmed: nothing looks at it.
    """
    st = e.facts.statements.where("not is_modifier").where(F.col("text").rlike(P.STATUS_CALL))
    before = F.regexp_extract("text", r"(?is)^(.*?)[\w\])]*\s*" + P.STATUS_CALL.removeprefix("(?i)"), 1)
    method = F.lower(F.regexp_extract("text", P.STATUS_CALL, 1))
    control = F.lower(F.regexp_extract(before, r"(?is)\b(require|assert|if|while|try)\b[^;]*$", 1))
    left = F.regexp_extract(before, r"(?s)^\(?([^=]*?)\)?\s*=(?!=)", 1)
    names = F.filter(F.transform(F.split(left, ","), lambda p: F.regexp_extract(p, r"([A-Za-z_]\w*)\s*\)?\s*$", 1)), lambda n: (n != "") & ~n.isin("bool", "bytes", "memory", "address"))
    rows = st.select("source_id", "open_i", "contract", "fn", F.col("start_line").alias("line"), "end_line", "stmt_no", "text", method.alias("method"), control.alias("control"), before.alias("before"), names.alias("names"))
    rows = rows.withColumn("names", F.when(F.col("control") != "", F.array().cast("array<string>")).otherwise(F.col("names")))
    uses = rows.select("source_id", "open_i", "stmt_no", F.explode("names").alias("name")).join(e.facts.occurrences, [*KEY, "name"]).where("n > stmt_no")
    checks = F.col("use").rlike(r"(?i)^(?:\}\s*)*(?:else\s+)?(?:require|assert|if|while|(?:verify|check)\w*)\s*\(")
    kind = F.lower(F.regexp_extract("use", r"(?i)^(?:\}\s*)*(?:else\s+)?(\w+)\s*\(", 1))
    seen = uses.groupBy("source_id", "open_i", "stmt_no").agg(
        F.sort_array(F.collect_set(F.when(checks, F.col("at")))).alias("check_lines"), F.sort_array(F.collect_set(F.when(checks, kind))).alias("check_kinds"), F.max(F.col("use").rlike(r"(?i)^(?:return|emit)\b")).alias("passed")
    )
    rows = rows.join(seen, ["source_id", "open_i", "stmt_no"], "left")
    none = F.array().cast(_NONE)
    passed_on = F.col("before").rlike(r"(?i)\breturn\b|[A-Za-z_]\w*\s*\([^;{}]*$")
    state = (
        F.when(F.col("control") != "", "refuted").when((F.size("names") == 0) & passed_on, "unresolved").when(F.size("names") == 0, "confirmed")
        .when(F.size(F.coalesce("check_lines", none)) > 0, "refuted").when(F.coalesce("passed", F.lit(False)), "unresolved").otherwise("confirmed")
    )
    lines = F.when(F.col("control") != "", F.array("line").cast(_NONE)).otherwise(F.coalesce(F.col("check_lines").cast(_NONE), none))
    kinds = F.when(F.col("control") != "", F.array("control")).otherwise(F.coalesce("check_kinds", F.array().cast("array<string>")))
    return rows.select("source_id", "open_i", "contract", "fn", "line", "end_line", "method", "names", lines.alias("check_lines"), kinds.alias("check_kinds"), state.alias("state"))


def decision_at(e: Effects, places: DataFrame) -> DataFrame:
    """places(source_id, line) with the decision of the call there: the exact line, else the only call whose expression spans it."""
    d = call_decisions(e).select("source_id", F.col("line").alias("call_line"), "end_line", "fn", "state")
    rows = places.join(d, "source_id").where("line between call_line and end_line")
    exact = F.max((F.col("line") == F.col("call_line")).cast("int")).over(W.partitionBy("source_id", "line"))
    n = F.count("*").over(W.partitionBy("source_id", "line"))
    return rows.withColumn("exact", exact).withColumn("n", n).where("(exact = 1 and line = call_line) or (exact = 0 and n = 1)").select("source_id", "line", "call_line", "fn", "state")


@once
def rule_uc1(e: Effects) -> DataFrame:
    return _candidates(call_decisions(e).where("state = 'confirmed'"), "UC1", "unchecked_low_level_calls", 0.92, "low_level_status_unchecked", F.concat("fn", F.lit("() ignores the status of "), "method", F.lit("()")))


def typed_methods(e: Effects) -> DataFrame:
    """(source_id, method, returns, read_only): methods declared with a return value anywhere in a source."""
    heads = e.facts.pieces.where(F.col("body").rlike(r"(?s)^function\s+\w+.*\breturns\s*\("))
    return heads.select("source_id", F.lower(F.regexp_extract("body", r"^function\s+(\w+)", 1)).alias("method"), F.trim(F.regexp_extract("body", r"(?s)\breturns\s*\(([^)]*)\)", 1)).alias("returns"), F.col("body").rlike(r"\b(?:view|pure)\b").alias("read_only"))


def _heads(e: Effects) -> DataFrame:
    """(source_id, ancestor, method, arity, returns, read_only): the functions that contracts and interfaces declare, with or without a body."""
    heads = e.facts.pieces.where("c is not null").where(F.col("body").rlike(r"(?s)^function\s+\w+\s*\("))
    head = bracketed(F.regexp_extract("body", r"(?s)^function\s+\w+\s*(\(.*)$", 1))
    heads = heads.select("source_id", F.col("c.contract").alias("ancestor"), F.lower(F.regexp_extract("body", r"^function\s+(\w+)", 1)).alias("method"), head.alias("head"), F.col("body").rlike(r"\b(?:view|pure)\b").alias("read_only"))
    given = F.regexp_extract("head.rest", r"(?s)\breturns\s*(\(.*)$", 1)
    returns = F.when(given != "", F.trim(bracketed(given)["inner"])).otherwise("")
    return heads.select("source_id", "ancestor", "method", F.size(top_parts(F.col("head.inner"))).alias("arity"), returns.alias("returns"), "read_only")


def _known(e: Effects) -> DataFrame:
    """(type, method, returns, read_only) of the interfaces that sources import."""
    rows = [(t, m.lower(), r.removesuffix(" view"), r.endswith(" view")) for t, by in P.KNOWN_INTERFACES.items() for r, methods in by.items() for m in methods]
    return e.facts.sources.sparkSession.createDataFrame(rows, "type string, method string, returns string, read_only boolean")


def typed_signatures(e: Effects) -> DataFrame:
    """(source_id, type, method, returns, read_only): what each contract or interface returns, its own declaration before those of its bases."""
    rows = e.graph.ancestors.join(_heads(e), ["source_id", "ancestor"])
    near = F.row_number().over(W.partitionBy("source_id", "contract", "method").orderBy("depth", "ancestor", "arity"))
    return rows.withColumn("r", near).where("r = 1").select("source_id", F.col("contract").alias("type"), "method", "returns", "read_only")


def _declared(e: Effects, calls: DataFrame) -> DataFrame:
    """(use, returns, read_only) of calls (use, source_id, kind, low, n_args): the declaration that a type has, by itself or from its bases.

    Of overloads the one with as many parameters counts, then the nearest; interfaces that sources import come last.
    """
    own = e.graph.ancestors.join(_heads(e), ["source_id", "ancestor"]).select("source_id", F.lower("contract").alias("kind"), F.col("method").alias("low"), "arity", "returns", "read_only", "depth")
    asked = calls.where("kind is not null").select("use", "source_id", F.lower("kind").alias("kind"), "low", "n_args")
    found = asked.join(own, ["source_id", "kind", "low"]).select("use", "n_args", "arity", "returns", "read_only", "depth")
    known = asked.join(F.broadcast(_known(e).select(F.lower("type").alias("kind"), F.col("method").alias("low"), "returns", "read_only")), ["kind", "low"])
    found = found.unionByName(known.select("use", "n_args", F.lit(-1).alias("arity"), "returns", "read_only", F.lit(1 << 20).alias("depth")))
    near = F.row_number().over(W.partitionBy("use").orderBy(F.when(F.col("arity") == F.col("n_args"), 0).otherwise(1), "depth", "arity"))
    return found.withColumn("r", near).where("r = 1").select("use", "returns", "read_only")


def discarded_returns(e: Effects) -> DataFrame:
    """Calls whose declared return value is dropped, resolved by the type of the receiver.

    (source_id, open_i, contract, fn, line, name, type, method, returns).  Receivers are plain
    names and casts of names; their type is that of
    the innermost declaration of the name (local, parameter or state), of a cast, or of the contract itself after super; of
    overloads the one with as many parameters as the call has arguments counts, of the
    nearest type.  Low-level calls and methods of RESULT_METHODS on likely contracts count
    without a declaration (returns: unknown).  What a safe wrapper calls is left out.
    """
    calls = calls_of(e).where(~F.col("text").rlike(P.SAFE_WRAPPERS) & ~F.col("chained") & ~F.col("indexed"))
    before = F.expr("substring(text, 1, locate(call, text) - 1)")
    tried = before.rlike(r"(?i)\btry\b")
    used = before.rlike(r"(?is)\b(?:require|assert|if|while)\s*\([^;{}]*$|(?:^|[^=!<>])=\s*$|\breturn\s*\(?\s*$|\bemit\s*$|[\w\])]\s*\([^;{}]*$|[-+*/%&|^<>!?:,(]\s*$")
    calls = calls.where(~F.when(tried, F.col("rest").rlike(r"(?i)\breturns\s*\(")).otherwise(used))
    cast = F.col("called") & (F.col("inner") != "")
    kind = F.when(F.col("root") == "super", F.col("contract")).when(cast, F.col("root")).when(~F.col("called"), F.col("type"))
    name = F.when(cast, F.col("inner")).otherwise(F.col("receiver"))
    calls = calls.withColumns({"kind": kind, "name": name, "low": F.lower("method"), "n_args": F.size(top_parts(bracketed(F.col("rest"))["inner"]))})
    calls = calls.where(F.col("kind").isNull() | ~F.col("kind").rlike(ELEMENTARY))
    rows = calls.join(_declared(e, calls), "use", "left")
    status = F.col("low").isin("call", "send", "delegatecall", "staticcall")
    likely = F.col("kind").isNotNull() | F.col("called") | F.col("stored") | F.col("root").rlike(P.EXTERNAL_ROOTS)
    plain = F.coalesce(F.col("kind").rlike(r"^address\b"), F.lit(False)) & (F.col("low") == "transfer") | (F.lower("root") == "payable") | (F.lower("root") == "msg")
    fallback = F.col("returns").isNull() & (status | (F.col("low").isin(P.RESULT_METHODS) & likely & ~plain))
    rows = rows.where(((F.col("returns") != "") & ~F.col("read_only")) | fallback)
    return rows.select("source_id", "open_i", "contract", "fn", "line", "name", F.coalesce("kind", F.lit("")).alias("type"), F.col("low").alias("method"), F.coalesce("returns", F.lit("unknown")).alias("returns"))


@once
def rule_uc3(e: Effects) -> DataFrame:
    """By lines: a low-level call without a check from 3 lines before to 6 after, or a typed return value that is dropped."""
    w = W.partitionBy(*KEY).orderBy("line_no")
    lines = e.line_flags.withColumn("near", F.array_join(F.collect_list("code").over(w.rowsBetween(-3, 6)), "\n"))
    low = F.col("code").rlike(P.LOW_LEVEL)
    unchecked = lines.where(low & ~F.col("near").rlike(P.CHECKED_NEAR)).withColumn("kind", F.lit("source_unchecked_low_level_call")).withColumn("c", F.lit(0.93))
    typed = typed_methods(e).groupBy("source_id", "method").agg(F.max(F.col("returns").rlike(r"(?i)\bbool(?:\s+[A-Za-z_]\w*)?\b")).alias("bool"), F.max("read_only").alias("read_only"))
    called = lines.where(~low & (F.col("method") != "")).join(typed, ["source_id", "method"], "left")
    prefix = F.regexp_extract("code", r"^(.*?)\b[A-Za-z_]\w*\s*\.\s*[A-Za-z_]\w*\s*(?:\{[^}\n]*\}\s*)?\(", 1)
    token = F.col("method").isin(P.TOKEN_METHODS) & prefix.rlike(rf"(?i)\b\w*(?:{P.TOKEN_WORDS})\w*\b")
    used = (F.trim(prefix) != "") & prefix.rlike(P.USED_BEFORE)
    known = F.col("read_only").isNotNull()
    dropped = called.where((known | token) & ~F.coalesce("read_only", F.lit(False)) & ~used & ~F.col("code").rlike(r"(?i)\b(?:safeerc20|transferhelper)\b"))
    kind = F.when(F.coalesce("bool", F.lit(False)) | token, "typed_return_discard").otherwise("external_return_discard")
    dropped = dropped.withColumn("kind", kind).withColumn("c", F.lit(0.9))
    cols = ["source_id", "open_i", "contract", "fn", F.col("line_no").alias("line"), "kind", "c"]
    return _candidates(unchecked.select(cols).union(dropped.select(cols)), "UC3", "unchecked_low_level_calls", F.col("c"), F.col("kind"), F.concat("fn", F.lit("() discards the result at @L"), F.col("line").cast("string")))


@once
def rule_uc6(e: Effects) -> DataFrame:
    """A call inside the braces of an assembly block whose status neither its own line tests nor, by the name it is bound to, a later branch of the block."""
    order = W.partitionBy("source_id").orderBy("i")
    opens = (F.col("kind") == "{") & F.col("body").rlike(r"(?i)\bassembly(?:\s*\([^)]*\))?$")
    pieces = e.facts.pieces.where("u is not null").select("source_id", "i", "piece", "kind", "body", "close_i", "end_line", F.col("u.open_i").alias("open_i"), F.col("u.fn").alias("fn"), F.coalesce("c.contract", F.lit("")).alias("contract"))
    block = F.last(F.when(opens, F.struct(F.col("i").alias("first"), F.col("close_i").alias("last"), F.col("end_line").alias("line"))), ignorenulls=True).over(order)
    inside = pieces.withColumn("b", block).where("i > b.first and i <= b.last")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "piece"))), lambda x: x["piece"]), "")
    blocks = inside.groupBy(*KEY, "contract", "fn", "b").agg(F.split(text, "\n").alias("lines"))
    rows = blocks.select(*KEY, "contract", "fn", "b", "lines", F.posexplode("lines").alias("at", "code")).where(F.col("code").rlike(P.YUL_CALL))
    # each call of a line with all that stands before it there
    rows = rows.withColumn("parts", all_matches(F.col("code"), r"(?i)(.*?)" + P.YUL_CALL.removeprefix("(?i)"), 0)).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("parts"))))
    upto = F.array_join(F.slice("parts", 1, F.col("k")), "")
    before = F.regexp_replace(upto, P.YUL_CALL + "$", "")
    name = F.lower(F.regexp_extract(before, r"(?i)\blet\s+([A-Za-z_]\w*)\s*:=\s*$", 1))
    rest = F.concat(F.array(F.expr("substring(code, char_length(upto) + 1)")), F.slice("lines", F.col("at") + 2, F.size("lines")))
    named = lambda line: F.exists(all_matches(line, r"(?i)\b(?:if|switch)\b([^{}\n]*)", 1), lambda test: F.array_contains(F.split(F.lower(test), r"\W+"), F.col("name")))
    rows = rows.withColumns({"upto": upto, "name": name, "inline": before.rlike(P.YUL_CHECKED)}).withColumn("branch", (F.col("name") != "") & F.exists(rest, named))
    rows = rows.where("not inline and not branch").withColumn("line", F.col("b.line") + F.col("at"))
    return _candidates(rows, "UC6", "unchecked_low_level_calls", 0.92, "assembly_call_status_discard", F.concat("fn", F.lit("() ignores the status of a call in assembly")))


@once
def unchecked_arithmetic(e: Effects) -> DataFrame:
    """Statements with arithmetic that no compiler check and no guard among the two statements before and after protects."""
    st = e.facts.statements.where("not is_modifier")
    w = W.partitionBy(*KEY).orderBy("stmt_no").rowsBetween(-2, 2)
    near = F.array_join(F.collect_list("text").over(w), "\n")
    block = F.max(F.col("text").rlike(r"\bunchecked\s*\{")).over(W.partitionBy(*KEY))
    rows = st.withColumn("near", near).withColumn("block", block).join(e.facts.masked.select("source_id", "major", "minor"), "source_id")
    op = F.regexp_extract("text", r"(\+=|-=|\*=|(?<=[\w\])])\s*[+*-]\s*(?=[\w(]))", 1)
    operand = F.regexp_extract("text", r"(?:\+=|-=|\*=|[\w\])]\s*[+*-])\s*([A-Za-z_]\w*)", 1)
    rows = rows.withColumn("op", F.trim(op)).withColumn("operand", operand).where("op != ''").where(~F.col("text").rlike(r"^(?:require|assert|for|emit)\b"))
    old = F.col("minor").isNull() | ((F.col("major") == 0) & (F.col("minor") < 8))
    guard = F.expr(r"operand != '' and rlike(near, concat('(?s)\\b(?:require|assert|if)\\s*\\([^;]*(?:>=|<=|>|<)[^;]*\\b', operand, '\\b|\\b(?:require|assert|if)\\s*\\([^;]*\\b', operand, '\\b[^;]*(?:>=|<=|>|<)'))")
    return rows.where(old | F.col("block")).withColumn("protected", guard).select("source_id", "open_i", "contract", "fn", "stmt_no", F.col("start_line").alias("line"), "op", "operand", "text", "protected")


@once
def rule_ar1(e: Effects) -> DataFrame:
    """Unprotected arithmetic on a parameter that writes state at once or through a name that a later line stores."""
    ops = unchecked_arithmetic(e).where("not protected")
    params = e.facts.parameters.join(e.facts.functions.select("source_id", "contract", "fn", "start_line", "open_i"), ["source_id", "contract", "fn", "start_line"]).select("source_id", "open_i", F.col("name").alias("p"))
    used = ops.join(params, KEY).where(F.expr(r"p != '' and rlike(text, concat('\\b', p, '\\b'))"))
    writes = e.line_flags.where("writes").select(*KEY, F.col("line_no").alias("w"), "code")  # with its text, which the lines of whole sources need not be asked for
    target = F.regexp_extract("text", r"([A-Za-z_]\w*)\s*=(?!=)", 1)
    rows = used.withColumn("target", target).join(writes, KEY)
    rows = rows.where(F.expr(r"w = line or (target != '' and w > line and rlike(code, concat('\\b', target, '\\b')))")).join(_callable(e).select(*KEY), KEY)
    rows = rows.groupBy(*KEY, "contract", "fn", "line").agg(F.min("w").alias("w"))
    return _candidates(rows, "AR1", "arithmetic", 0.85, "caller_controlled_arithmetic_write", F.concat("fn", F.lit("() stores unchecked arithmetic on its arguments")), evidence_lines=F.array("line", "w"), operation_lines=F.array("line"), state_write_lines=F.array("w"))


@once
def rule_ar5(e: Effects) -> DataFrame:
    """Before 0.8: one row a function with unchecked arithmetic, with a confidence by how it is grounded; below 0.6 none."""
    ops = unchecked_arithmetic(e).where("not protected")
    writes = e.state_writes.select(*KEY, F.col("line"), F.lit(1).alias("stored"))
    rows = ops.join(writes, [*KEY, "line"], "left").groupBy(*KEY, "contract", "fn").agg(F.min("line").alias("line"), F.sort_array(F.collect_set("line")).alias("ops"), F.max("stored").alias("stored"))
    g = e.guards.select(*KEY, "visibility", "mutability")
    rows = rows.join(g, KEY).withColumn("c", F.when(F.col("stored") == 1, 0.8).when(~F.col("mutability").isin("view", "pure"), 0.7).when(F.col("visibility").isin("public", "external"), 0.55).otherwise(0.4)).where("c >= 0.6")
    return _candidates(rows, "AR5", "arithmetic", F.col("c"), "legacy_unchecked_arithmetic", F.concat("fn", F.lit("() computes without overflow checks")), evidence_lines=F.col("ops"), operation_lines=F.col("ops"))


def economic_bindings(e: Effects) -> DataFrame:
    """(source_id, open_i, fn, line, sink_line, word): an economic statement and the first later asset sink that shares a word."""
    st = e.facts.statements.where("not is_modifier").select("source_id", "open_i", "contract", "fn", "stmt_no", "start_line", "text")
    worded = lambda rows: rows.withColumn("word", F.explode(words_of(F.col("text")))).where(F.length("word") > 1)
    economic = worded(st.where(F.col("text").rlike(r"(?i)(?:quote|price|rate|amountout|getamount|reserve|share)") & F.col("text").rlike("=(?!=)")))
    sink = worded(st.where(F.col("text").rlike(P.ASSET_SINK)))
    a = economic.select("source_id", "open_i", "contract", "fn", F.col("stmt_no").alias("n"), F.col("start_line").alias("line"), "word")
    b = sink.select("source_id", "open_i", F.col("stmt_no").alias("m"), F.col("start_line").alias("sink_line"), "word")
    rows = a.join(b, ["source_id", "open_i", "word"]).where("m > n")
    return rows.groupBy("source_id", "open_i", "contract", "fn", "line").agg(F.min(F.struct("sink_line", "word")).alias("s")).select("source_id", "open_i", "contract", "fn", "line", "s.sink_line", "s.word")


@once
def rule_fr6(e: Effects) -> DataFrame:
    """A quoted value reaches an asset sink and nothing in the function bounds the order."""
    bound = e.guards.where(F.col("body").rlike(r"(?i)\b\w*(?:min|max|slippage|deadline|limit|nonce|commit)\w*\b")).select(*KEY)
    rows = economic_bindings(e).join(bound, KEY, "left_anti").join(_callable(e).select(*KEY), KEY)
    return _candidates(rows, "FR6", "front_running", 0.72, "unbounded_quote_to_asset_sink", F.concat("fn", F.lit("() settles a quote without a bound")), sink_line=F.col("sink_line"), evidence_lines=F.array("line", "sink_line"), operation_lines=F.array("line"))


def rw_conflicts(e: Effects) -> DataFrame:
    """(source_id, contract, name, writer, reader, financial): a public writer and a different public reader of one state variable, neither for administrators."""
    free = e.admin_restricted.where("not restricted").select(*KEY)
    uses = e.line_flags.join(free, KEY).where("not is_constructor").select(*KEY, "contract", "fn", "line_no", "code", "writes", F.explode("state_names").alias("name"))
    written_ = F.expr(r"writes and rlike(code, concat('^\\s*', name, '\\b'))")
    uses = uses.withColumn("w", written_)
    writer = uses.where("w").groupBy("source_id", "contract", "name", F.col("open_i").alias("w_id")).agg(F.min("fn").alias("writer"))
    money = F.col("code").rlike(r"(?i)\.\s*(?:transfer|send|call|mint|swap|withdraw)\b|msg\s*\.\s*value")
    reader = uses.where("not w").groupBy("source_id", "contract", "name", F.col("open_i").alias("r_id")).agg(F.min("fn").alias("reader"), F.max(money).alias("financial"))
    return writer.join(reader, ["source_id", "contract", "name"]).where("w_id <> r_id").select("source_id", "contract", "name", "writer", "reader", "financial", "w_id", "r_id")


@once
def rule_gr8(e: Effects) -> DataFrame:
    """One front-running hypothesis for each source with financial conflicts, at the first reader."""
    rows = rw_conflicts(e).where("financial")
    start = e.facts.functions.select("source_id", F.col("open_i").alias("r_id"), "start_line")
    first = rows.join(start, ["source_id", "r_id"]).groupBy("source_id").agg(F.min(F.struct("start_line", "contract", "reader", "r_id", "name")).alias("x"), F.sort_array(F.collect_set("writer")).alias("writers"))
    rows = first.select("source_id", F.col("x.r_id").alias("open_i"), "x.contract", F.col("x.reader").alias("fn"), F.col("x.start_line").alias("line"), F.col("x.name").alias("name"), "writers")
    return _candidates(rows, "GR8", "front_running", 0.65, "financial_read_write_conflict", F.concat(F.array_join("writers", ","), F.lit("() can change "), "name", F.lit(" before "), "fn", F.lit("()")))


@once
def clock_facts(e: Effects) -> DataFrame:
    """(source_id, open_i, contract, fn, is_modifier, kind, line, name): reads of the clock, aliases of it, guards on either."""
    st = e.facts.statements
    line = F.col("start_line").alias("line")
    clock = F.col("text").rlike(P.CLOCK)
    guard = r"(?i)^(?:require|assert|if|while)\s*\("
    row = lambda kind, name: ["source_id", "open_i", "contract", "fn", "is_modifier", F.lit(kind).alias("kind"), line, name.alias("name")]
    alias = F.regexp_extract("text", r"^(?:uint\d*\s+)?([A-Za-z_]\w*)\s*=(?!=)[^;]*(?:\bblock\s*\.\s*timestamp\b|\bnow\b)", 1)
    aliases = st.where(alias != "").select(*row("alias", alias))
    on_alias = st.where(F.col("text").rlike(guard) & ~clock).join(aliases.select("source_id", "open_i", F.col("name").alias("a")), KEY).where(F.expr(r"rlike(text, concat('\\b', a, '\\b'))"))
    compare = F.regexp_extract("text", r"(>=|<=|==|!=|>|<)", 1)
    return (
        st.where(clock).select(*row("read", F.lit("")))
        .union(aliases)
        .union(st.where(F.col("text").rlike(guard) & clock).select(*row("guard", compare)))
        .union(on_alias.select(*row("guard", compare)).distinct())
    )


@once
def effect_facts(e: Effects) -> DataFrame:
    """Writes and asset actions as rows of clock_facts."""
    contracts = e.facts.functions.select(*KEY, "contract")
    row = lambda kind, name: ["source_id", "open_i", "contract", "fn", F.lit(False).alias("is_modifier"), F.lit(kind).alias("kind"), "line", F.col(name).alias("name")]
    write, asset = e.direct_effects.where("kind = 'state_write'"), e.direct_effects.where("asset_call")
    return write.join(contracts, KEY).select(*row("write", "receiver")).union(asset.join(contracts, KEY).select(*row("asset", "method")))


def temporal_facts(e: Effects) -> DataFrame:
    """clock_facts and effect_facts: (source_id, open_i, contract, fn, is_modifier, kind, line, name)."""
    return clock_facts(e).union(effect_facts(e)).hint("merge")  # a union loses what is known of its tables' rows


def guarded_actions(e: Effects) -> DataFrame:
    """(source_id, open_i, fn, guard_line, action, action_line): a clock guard and each later write or asset action of the function."""
    guards = clock_facts(e).where("kind = 'guard'").select("source_id", "open_i", F.col("line").alias("guard_line")).distinct().hint("merge")
    acts = effect_facts(e).select("source_id", "open_i", "contract", "fn", F.col("kind").alias("action"), F.col("line").alias("action_line"))
    return guards.join(acts, KEY).where("action_line >= guard_line")


def temporal_relations(e: Effects) -> DataFrame:
    """(source_id, fn, relation, from_line, to_line): guard controls action, alias reaches guard, helper is called."""
    t = temporal_facts(e)
    a = t.where("kind = 'alias'").select("source_id", "open_i", "fn", F.col("line").alias("from_line"))
    g = t.where("kind = 'guard'").select("source_id", "open_i", F.col("line").alias("to_line"))
    timed = t.where("kind in ('read', 'guard')").select("source_id", F.col("open_i").alias("caller")).distinct()
    calls = e.graph.edges.join(timed, ["source_id", "caller"]).select("source_id", F.col("caller_fn").alias("fn"), F.lit("helper_call").alias("relation"), F.col("line").alias("from_line"), F.col("line").alias("to_line"))
    controls = guarded_actions(e).select("source_id", "fn", F.lit("guard_controls_action").alias("relation"), F.col("guard_line").alias("from_line"), F.col("action_line").alias("to_line"))
    return controls.union(a.join(g, KEY).where("to_line > from_line").select("source_id", "fn", F.lit("alias_to_guard").alias("relation"), "from_line", "to_line")).union(calls).distinct()


@once
def rule_tm5(e: Effects) -> DataFrame:
    """A clock gate, in the function or in a modifier that it uses, before a write or an asset action."""
    acts = guarded_actions(e).groupBy("source_id", "open_i", "contract", "fn").agg(F.min("guard_line").alias("line"), F.sort_array(F.collect_set("action_line")).alias("acts")).withColumn("kind", F.lit("timestamp_gate"))
    gates = temporal_facts(e).where("kind = 'guard' and is_modifier").groupBy("source_id", F.col("fn").alias("modifier")).agg(F.min("line").alias("line"))
    used = e.facts.functions.select("source_id", "open_i", "contract", "fn", F.explode("modifiers").alias("modifier")).join(gates, ["source_id", "modifier"])
    does = temporal_facts(e).where("kind in ('write', 'asset')").groupBy("source_id", "open_i").agg(F.sort_array(F.collect_set("line")).alias("acts"))
    by_modifier = used.join(does, KEY).select("source_id", "open_i", "contract", "fn", "line", "acts", F.lit("modifier_time_window").alias("kind"))
    rows = acts.unionByName(by_modifier).join(_callable(e).select(*KEY), KEY)
    return _candidates(rows, "TM5", "time_manipulation", F.when(F.col("kind") == "timestamp_gate", 0.7).otherwise(0.75), F.col("kind"), F.concat("fn", F.lit("() depends on the clock before it acts")), evidence_lines=F.concat(F.array("line"), "acts"))


@once
def rule_tm6(e: Effects) -> DataFrame:
    """Two or more public setters of times from the clock, and a gate that names at least two of those times."""
    w = e.direct_effects.where("kind = 'state_write'").select("source_id", "open_i", "line", F.col("receiver").alias("name"))
    reads = temporal_facts(e).where("kind in ('read', 'alias')").select("source_id", "open_i", "line").distinct()
    setters = w.join(reads, ["source_id", "open_i", "line"]).join(_callable(e).select(*KEY), KEY).select("source_id", "name", F.col("open_i").alias("setter"))
    gates = e.facts.statements.where(F.col("text").rlike(r"(?i)^(?:require|assert|if)\s*\(") & F.col("text").rlike(P.CLOCK)).select("source_id", "open_i", "contract", "fn", "is_modifier", F.col("start_line").alias("line"), F.explode(F.array_distinct(all_matches(F.col("text"), r"[A-Za-z_]\w*"))).alias("name"))
    rows = gates.join(setters, ["source_id", "name"]).groupBy("source_id", "open_i", "contract", "fn", "line").agg(F.count_distinct("name").alias("n"), F.count_distinct("setter").alias("s")).where("n >= 2 and s >= 2")
    return _candidates(rows, "TM6", "time_manipulation", 0.78, "lifecycle_boundary", F.concat("fn", F.lit("() opens and closes at times that anyone sets")))


@once
def rule_tm12(e: Effects) -> DataFrame:
    """Weak: the clock in a condition of a function for which no stronger row exists."""
    strong = rule_tm5(e).select(*KEY).union(rule_tm6(e).select(*KEY)).distinct().hint("merge")
    rows = temporal_facts(e).where("kind = 'guard'").groupBy("source_id", "open_i", "contract", "fn").agg(F.min("line").alias("line")).join(strong, KEY, "left_anti")
    return _candidates(rows, "TM12", "time_manipulation", 0.55, "clock_in_condition", F.concat("fn", F.lit("() compares with the clock")))


#: Single-function rules: what the body must and must not match, the line to report, and the label.
#: What looks ahead over the whole body starts with ^: tried at every place it takes the square of the body's length.
PATTERN_RULES = [
    ("FR1", "front_running", r"(?i)\.\s*(?:transfer|send)\s*\([^;]*\*", r"(?i)\bmin\w*\b|\bdeadline\b|only", r"(?i)\.\s*(?:transfer|send)\s*\(", 0.65),
    ("FR2", "front_running", r"(?i)\ballowance\s*\[[^;]*\]\s*=(?!=)", r"(?i)increaseAllowance|decreaseAllowance|==\s*0", r"(?i)\ballowance\s*\[", 0.6),
    ("FR3", "front_running", r"(?is)getAmountOut.*\.\s*swap\s*\(", r"(?i)\bmin\w*|slippage|deadline", r"(?i)\.\s*swap\s*\(", 0.7),
    ("AC4", "access_control", r"(?i)\b(?:selfdestruct|suicide)\s*\(", r"(?i)msg\s*\.\s*sender\s*==|only", r"(?i)\b(?:selfdestruct|suicide)\s*\(", 0.9),
    ("TM9", "time_manipulation", r"(?is)keccak256\s*\([^;]*block\s*\.\s*(?:timestamp|number)", r"(?!)", r"(?i)keccak256", 0.75),
    ("TM10", "time_manipulation", r"(?s)-\s*block\s*\.\s*timestamp|block\s*\.\s*timestamp\s*-", r"(?i)require\s*\([^;]*(?:>|<)", r"block\s*\.\s*timestamp", 0.6),
    (
        "AC3", "access_control",
        r"(?is)^(?=[^{]*\b(?:public|external)\b)(?=.*\bfunction\s+(?:update|set|change|record|assign|add|remove)\w*(?:reward|balance|share|supply|reserve|fee|amount|credit|debit|impact|score|metric)\b)"
        r"(?=.*\b(?:amount|value|fee|share|balance|reward|referral|recipient|account)\b).*(?:\[[^\]\n]+\]|\.[A-Za-z_]\w*)\s*(?:\+|-|\*|/)?=(?!=)",
        r"(?i)msg\s*\.\s*sender\s*(?:==|!=)|\bonly\w*|\bauth\w*|hasRole", r"(?:\[[^\]\n]+\]|\.[A-Za-z_]\w*)\s*(?:\+|-|\*|/)?=(?!=)", 0.9,
    ),
    (
        "RE9", "reentrancy", r"(?is)^[^{]*\bfunction\s+\w*flashloan\w*[^{]*\bstorage\s+(\w+)[^{]*\{.*=\s*\w+\s*\([^;]*receiverAddress.*\.\s*executeOperation\s*\(.*;.*\b\1\s*\.",
        r"(?i)nonReentrant|mutex|_?locked\b", r"(?i)\.\s*executeOperation\s*\(", 0.95,
    ),
    ("TM10_permit", "time_manipulation", r"(?is)^(?=.*\bdeadline\b).*\b(?:ECDSA\s*\.\s*recover|ecrecover)\s*\(", r"(?is)(?:require|if)\s*\(\s*(?:block\.timestamp\s*(?:<=|<|>=|>)\s*(?:\w+\.)?deadline|(?:\w+\.)?deadline\s*(?:<=|<|>=|>)\s*block\.timestamp)\b", r"(?i)\b(?:ECDSA\s*\.\s*recover|ecrecover)\s*\(", 0.87),
    ("TM10_leaf", "time_manipulation", r"(?s)^(?=.*keccak256\s*\(\s*abi\.encodePacked\s*\().*\bMerkleProof\s*\.\s*verify\s*\(", r"(?i)\b(?:nonce|timestamp|sequence|epoch|expir\w*|deadline|srcTimestamp|cross_?chain|from_chain|to_chain)\b", r"\bMerkleProof\s*\.\s*verify\s*\(", 0.85),
    ("TM10_delta", "time_manipulation", r"(?s)\b(?:timeDelta|timeElapsed)\s*=\s*block\.timestamp\s*-.*/\s*(?:timeDelta|timeElapsed)\b", r"(?:require|if)\s*\(\s*\w*(?:timeDelta|timeElapsed)\s*(?:>|!=)\s*0", r"\b(?:timeDelta|timeElapsed)\s*=\s*block\.timestamp\s*-", 0.88),
    (
        "TM10_oracle", "time_manipulation", r"(?is)^(?=.*\b(?:liquidate|borrow|mint|withdraw|redeem|swap|seize)\w*\s*\().*\b\w*(?:oracle|feed|aggregator)\w*\s*\.\s*(?:getPrice|latestAnswer|getAssetPrice)\s*\(",
        r"(?is)(?:lastUpdate|updatedAt|publishTime|lastUpdateTime|staleness).{0,80}?(?:block\.timestamp|HEARTBEAT|maxAge)|block\.timestamp\s*-\s*\w*(?:updated|publish)", r"(?i)\b\w*(?:oracle|feed|aggregator)\w*\s*\.\s*(?:getPrice|latestAnswer|getAssetPrice)\s*\(", 0.9,
    ),
]


#: Rules of steps that must follow one another, by the first match of each; then at least one match of the last step after them.
#: Name of the function, steps, last step, and what lets it off.
ORDERED_RULES = [
    (
        "FR3_share", "front_running", r"(?i)^(?:deposit|depositTo)$",
        [r"(?i)\b(?:underlyingTotal|totalAssets|underlyingBalance)\s*\(", r"(?i)\b(?:safeTransferFrom|transferFrom)\s*\(\s*msg\s*\.\s*sender\b", r"(?i)\bshares\b\s*=\s*[^;\n]*\btotalSupply\s*\(\s*\)"],
        r"(?i)\b_mint\s*\(", r"(?i)\b(?:minShares|minShare|minimumShares|minimumShare|sharesMin|minMinted|mintedMin|amountOutMin|slippage)\b", 0.9,
    ),
]


def ordered_steps(e: Effects, rules: list[tuple] = ORDERED_RULES) -> DataFrame:
    """Public functions without a restriction whose body takes the steps of a rule in their order; evidence are the lines of the steps.

    One pass over bodies gives the place of each step's first match; a rule compares its own places.
    """
    g = e.guards.where("visibility in ('public', 'external')").select(*KEY, "contract", "fn", "start_line", "body")
    g = g.join(e.admin_restricted.where("not restricted").select(*KEY), KEY)
    head = F.locate("{", F.col("body"))
    found = []
    for rule, _, name, steps, last, off, c in rules:
        inner = F.expr("substring(body, locate('{', body) + 1)")
        places = F.array(*[F.regexp_instr(inner, F.lit(p)) for p in steps])
        row = g.where(F.col("fn").rlike(name) & ~F.col("body").rlike(off)).withColumns({"inner": inner, "places": places, "head": head})
        rising = F.forall(F.sequence(F.lit(0), F.lit(len(steps) - 2)), lambda i: F.get("places", i) < F.get("places", i + 1))
        row = row.where(F.forall("places", lambda p: p > 0) & rising)
        tail = F.expr("substring(inner, element_at(places, -1))")
        row = row.where(tail.rlike(last))
        upto = lambda p: F.expr("start_line") + F.length(F.regexp_replace(F.substring(F.col("body"), F.lit(1), F.col("head") + p - 1), r"[^\n]", ""))
        ends = F.split(F.col("inner"), last)
        lasts = F.transform(F.sequence(F.lit(1), F.size(ends) - 1), lambda k: F.col("start_line") + F.length(F.regexp_replace(F.concat(F.substring(F.col("body"), F.lit(1), F.col("head")), F.array_join(F.slice(ends, F.lit(1), k), "")), r"[^\n]", "")))
        lines = F.concat(F.array("start_line"), F.transform("places", upto), lasts)
        found.append(row.select(*KEY, "contract", "fn", F.col("start_line").alias("line"), F.lit(rule).alias("rule"), F.lit(c).alias("c"), lines.alias("lines")))
    return reduce(DataFrame.union, found)


def pattern_scan(e: Effects, rules: list[tuple] = PATTERN_RULES) -> DataFrame:
    """Functions whose bodies fit a pattern rule, with the first line that fits its place.

    All rules are tested in one pass over bodies; only the lines of functions that fit are then looked at.
    """
    fits = F.array(*[F.when(F.col("body").rlike(must) & ~F.col("body").rlike(must_not), F.lit(rule)) for rule, _, must, must_not, _, _ in rules])
    hits = e.guards.where("visibility != 'private'").select(*KEY, "contract", "fn", F.explode(F.filter(fits, lambda r: r.isNotNull())).alias("rule"))
    place = F.coalesce(*[F.when(F.col("rule") == rule, F.col("code").rlike(at)) for rule, _, _, _, at, _ in rules])
    lines = e.facts.line_functions.select(*KEY, "line_no", "code").hint("merge")
    of = lambda i, kind: F.element_at(F.create_map(*[F.lit(v) for r in rules for v in (r[0], r[i])]), F.col("rule")).cast(kind)
    rows = hits.join(lines, KEY).where(place).groupBy(*KEY, "contract", "fn", "rule").agg(F.min("line_no").alias("line")).withColumn("c", of(5, "double"))
    out = _candidates(rows.withColumn("reason", F.concat("fn", F.lit("() matches "), "rule")), "PS1", "x", F.col("c"), F.col("rule"), F.col("reason"))
    if rules is PATTERN_RULES:
        steps = ordered_steps(e)
        out = out.unionByName(_candidates(steps, "PS1", "x", F.col("c"), F.col("rule"), F.concat("fn", F.lit("() takes the steps of "), "rule"), evidence_lines=F.col("lines")))
    label = F.element_at(F.create_map(*[F.lit(v) for r in [*rules, *ORDERED_RULES] for v in (r[0], r[1])]), F.col("evidence_kind"))
    return out.withColumn("risk_type", label).withColumn("rule_id", F.col("evidence_kind"))


def hints(e: Effects) -> DataFrame:
    """(source_id, fn, line, kind): structure hints of functions, one row for each that holds."""
    g = e.guards
    summary = e.reentrancy_summary.select("source_id", F.col("root").alias("open_i"), "reentrant_order")
    rows = g.join(summary, KEY, "left").withColumn("order", F.coalesce("reentrant_order", F.lit(False)))
    b = F.col("body")
    kinds = {
        "reentrancy_risk": F.col("order") & ~F.col("mutex"), "reentrancy_guarded": F.col("mutex"), "time": b.rlike(P.CLOCK), "tx_origin": b.rlike(P.ORIGIN),
        "loop": b.rlike(r"\b(?:for|while)\s*\("), "low_level_call": b.rlike(P.STATUS_CALL), "auth_guard": F.col("auth_guard"),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]), lambda x: x.isNotNull())
    return rows.select("source_id", "fn", F.col("start_line").alias("line"), F.explode(found).alias("kind"))


def risk_hints(e: Effects) -> DataFrame:
    """(source_id, contract, fn, line, kind): what public functions lack, one row for each that holds.

    missing_checks: stored state changes without any require or assert, and no result is
    checked later; lifecycle: a function named like a setup, or one that changes an owner unchecked,
    without restriction or initializer; fallback_call: a fallback calls others; overflow:
    arithmetic that the compiler does not check (before 0.8) in a function that changes state.
    """
    from quarrymill.operators import flows as L

    writes = e.state_writes.groupBy(*KEY).agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("written"))
    called = e.external_calls.select(*KEY).distinct().withColumn("calls", F.lit(True))
    late = L.tracked_results(e).where("tracking = 'delayed_check'").select("source_id", "fn", "line").join(e.facts.line_functions.select(*KEY, F.col("line_no").alias("line")), ["source_id", "line"]).select(*KEY).distinct().withColumn("late", F.lit(True))
    fallback = e.facts.functions.select(*KEY, "is_fallback")
    rows = e.guards.where("visibility in ('public', 'external')").join(writes, KEY, "left").join(called, KEY, "left").join(late, KEY, "left").join(fallback, KEY).join(e.admin_restricted.select(*KEY, "restricted"), KEY)
    rows = rows.join(e.facts.masked.select("source_id", "major", "minor"), "source_id")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    writes_any = F.col("written").isNotNull() & ~F.col("is_constructor")
    checked = F.col("body").rlike(r"\b(?:require|assert)\s*\(")
    owner = F.exists(F.coalesce("written", F.array().cast("array<string>")), lambda n: n.rlike(P.OWNER_STATE))
    guarded = F.exists("modifiers", lambda m: F.lower(m).contains("init")) | F.col("mutex_guard")
    arithmetic = F.col("body").rlike(r"[+*-]\s*=|\w\s*[+*-]\s*\w")
    old = (F.col("major") == 0) & (F.col("minor") < 8)
    kinds = {
        "missing_checks": writes_any & ~checked & ~is_("late"), "lifecycle": writes_any & (F.col("fn").rlike(P.SETUP_NAMES) | (owner & ~checked)) & ~F.col("restricted") & ~guarded,
        "fallback_call": is_("is_fallback") & is_("calls"), "overflow": old & arithmetic & (F.col("written").isNotNull() | F.col("body").rlike(r"\w\[.*\]\s*[+*-]=")),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]), lambda x: x.isNotNull())
    return rows.select("source_id", "contract", "fn", F.col("start_line").alias("line"), F.explode(found).alias("kind"))


def loop_features(e: Effects) -> DataFrame:
    """(source_id, fn, line, unbounded, sends, calls): loops, whether a length or nothing with a number bounds them, whether ether or tokens are sent between their braces, and whether others are called there."""
    st = e.facts.statements.where("not is_modifier")
    loops = st.where(F.col("text").rlike(r"^(?:for|while)\s*\("))
    sends = F.col("text").rlike(r"\.(?:send|transfer)|\.call\{value:")
    out = st.where(sends | F.col("text").rlike(r"\.(?:call|delegatecall)")).select(*KEY, F.col("first_i").alias("out_i"), sends.alias("sends"))
    condition = F.when(F.col("text").startswith("for"), F.regexp_extract("text", r"(?s)^for\s*\([^;]*;([^;]*);", 1)).otherwise(F.regexp_extract("text", r"(?s)^while\s*\((.*)\)", 1))
    condition = F.trim(condition)
    unbounded = condition.contains(".length") | ((condition != "") & ~condition.rlike(r"\d"))
    inside = loops.select(*KEY, "stmt_no", "first_i", "close_i").join(out, KEY).where("out_i > first_i and out_i < close_i").groupBy(*KEY, "stmt_no").agg(F.max("sends").alias("sends"), F.lit(True).alias("calls"))
    rows = loops.join(inside, [*KEY, "stmt_no"], "left")
    return rows.select("source_id", "fn", F.col("start_line").alias("line"), unbounded.alias("unbounded"), F.coalesce("sends", F.lit(False)).alias("sends"), F.coalesce("calls", F.lit(False)).alias("calls"))


RULES = {
    "AC1": rule_ac1, "AC2": rule_ac2, "AC5": rule_ac5, "AC6": rule_ac6, "AC8": rule_ac8, "RE1": rule_re1, "RE2": rule_re2, "RE5": rule_re5, "UC1": rule_uc1, "UC3": rule_uc3, "UC6": rule_uc6,
    "AR1": rule_ar1, "AR5": rule_ar5, "FR6": rule_fr6, "GR8": rule_gr8, "TM5": rule_tm5, "TM6": rule_tm6, "TM12": rule_tm12, "PS1": once(pattern_scan),
}
