"""Flows of values within functions: chains, tracked call results, best writes, typed callbacks, hard facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarrymill.functions import patterns as P
from quarrymill.functions.text import all_matches
from quarrymill.operators import rules as R
from quarrymill.operators.effects import KEY, Effects
from quarrymill.storage import once


def _later(e: Effects, rows: DataFrame) -> DataFrame:
    """rows(source_id, open_i, stmt_no, name, ...) with each later statement of the function that names it."""
    return rows.join(e.facts.occurrences, [*KEY, "name"]).where("n > stmt_no")


def def_use_chains(e: Effects) -> DataFrame:
    """(source_id, fn, source, name, line, sink, sink_line): a name bound to the clock, value, caller or block, and each later check, return, remainder, index or assignment that uses it."""
    st = e.facts.statements.where("not is_modifier")
    source = F.when(F.col("text").rlike(P.CLOCK), "time").when(F.col("text").rlike(r"\bmsg\s*\.\s*value\b"), "value").when(F.col("text").rlike(r"\b(?:msg\s*\.\s*sender|tx\s*\.\s*origin)\b"), "caller").when(F.col("text").rlike(r"\bblock\s*\.\s*difficulty\b|\bblockhash\s*\("), "block")
    name = F.regexp_extract("text", r"^\(?(?:[\w.\[\]]+\s+)?(?:memory\s+)?([A-Za-z_]\w*)\s*(?:,\s*)?\)?\s*=(?!=)", 1)
    defs = st.select(*KEY, "fn", "stmt_no", F.col("start_line").alias("line"), source.alias("source"), name.alias("name")).where("source is not null and name != ''")
    uses = _later(e, defs)
    sink = F.when(F.col("use").rlike(r"(?i)^(?:require|assert)\s*\("), "require").when(F.col("use").rlike(r"(?i)^(?:\}\s*)*(?:else\s+)?if\s*\("), "if").when(F.col("use").rlike(r"(?i)^return\b"), "return").when(F.col("use").contains("%"), "modulo").when(F.col("use").rlike(r"\["), "index").otherwise("assignment")
    return uses.select("source_id", "fn", "source", "name", "line", sink.alias("sink"), F.col("at").alias("sink_line")).distinct()


def tracked_results(e: Effects) -> DataFrame:
    """(source_id, fn, line, method, tracking, check_line): low-level calls whose result is checked later, never, or not even kept."""
    d = R.call_decisions(e).where("not (size(names) = 0 and state <> 'confirmed')")
    tracking = F.when(F.size("names") == 0, "orphan").when(F.size("check_lines") > 0, "delayed_check").otherwise("never_checked")
    return d.select("source_id", "fn", "line", "method", tracking.alias("tracking"), F.array_min("check_lines").alias("check_line"))


def undebited_transfers(e: Effects) -> DataFrame:
    """(source_id, fn, line): native ether to the caller without a debit of the caller earlier in the function."""
    lines = e.line_flags
    send = lines.where(F.col("code").rlike(r"(?i)msg\s*\.\s*sender\s*\)?\s*\.\s*(?:transfer|send|call)\b")).select(*KEY, "fn", F.col("line_no").alias("line"))
    debit = lines.where(F.col("writes") & F.col("code").rlike(r"(?i)\[\s*msg\s*\.\s*sender\s*\]\s*(?:-=|=)")).groupBy(*KEY).agg(F.min("line_no").alias("debit"))
    return send.join(debit, KEY, "left").where("debit is null or debit >= line").select("source_id", "fn", "line")


def arithmetic_sinks(e: Effects) -> DataFrame:
    """(source_id, fn, line, name, sink, sink_line): the first later return, branch or call that uses an unprotected result."""
    name = F.regexp_extract("text", r"([A-Za-z_]\w*)\s*(?:=(?!=)|\+=|-=|\*=)", 1)
    ops = R.unchecked_arithmetic(e).where("not protected").select(*KEY, "fn", "stmt_no", "line", name.alias("name")).where("name != ''")
    sink = F.when(F.col("use").rlike(r"(?i)^return\b"), "return").when(F.col("use").rlike(r"(?i)^(?:require|assert|if)\s*\("), "branch").when(F.col("use").rlike(P.ASSET_SINK), "call")
    uses = _later(e, ops).withColumn("sink", sink).where("sink is not null")
    return uses.groupBy("source_id", "fn", "line", "name").agg(F.min(F.struct("at", "sink")).alias("s")).select("source_id", "fn", "line", "name", "s.sink", F.col("s.at").alias("sink_line"))


def arithmetic_provenance(e: Effects) -> DataFrame:
    """(source_id, fn, line, provenance, impact_line): stored arithmetic first, else the sink that it reaches."""
    stored = R.rule_ar1(e).select("source_id", "fn", "line", F.col("state_write_lines")[0].alias("w"))
    reached = arithmetic_sinks(e).groupBy("source_id", "fn", "line").agg(F.min("sink_line").alias("s"))
    rows = stored.join(reached, ["source_id", "fn", "line"], "full")
    return rows.select("source_id", "fn", "line", F.when(F.col("w").isNotNull(), "state_write").otherwise("sink").alias("provenance"), F.coalesce(F.col("w"), F.col("s")).alias("impact_line"))


def best_state_writes(e: Effects) -> DataFrame:
    """(source_id, fn, call_line, write_line, score): after each external call the strongest write of the function; the earliest on ties."""
    calls = e.external_calls.select(*KEY, F.col("line").alias("call_line"))
    writes = e.state_writes.select(*KEY, "fn", F.col("line").alias("write_line"), "score")
    rows = calls.join(writes, KEY).where("write_line > call_line")
    top = F.row_number().over(W.partitionBy(*KEY, "call_line").orderBy(F.desc("score"), "write_line"))
    return rows.withColumn("r", top).where("r = 1").select("source_id", "fn", "call_line", "write_line", "score")


@once
def callbacks(e: Effects) -> DataFrame:
    """(source_id, open_i, contract, fn, line, callback, code): lines that may hand control to others, by the first type that fits.

    Not the head of a function, and no low-level call of tx.origin, which is never a contract.
    """
    code = F.col("code")
    kind = (
        F.when(code.rlike(r"(?i)\.\s*call\s*(?:\{[^}\n]*value|\.\s*value)"), "low_level_value_call").when(code.rlike(r"(?i)\.\s*(?:safeTransferFrom|transferFrom|safeTransfer)\s*\("), "token_transfer")
        .when(code.rlike(r"(?i)payable\s*\([^()]*(?:\([^()]*\))?[^()]*\)\s*\.\s*(?:transfer|send)\s*\("), "native_transfer").when(code.rlike(P.SAFE_MINT), "safe_mint")
        .when(code.rlike(P.SENDER_HOOK), "erc777_sender_hook").when(code.rlike(P.RECEIVER_HOOK), "erc777_receiver_hook")
        .when(code.rlike(r"(?i)\.\s*(?:delegatecall|call)\s*\("), "arbitrary_action").when(code.rlike(r"(?i)\.\s*transfer\s*\("), "token_transfer").when(code.rlike(r"(?i)\.\s*(?:swap|flashLoan)\s*\("), "pool_callback")
    )
    head = code.rlike(r"^\s*(?:function|modifier)\b[^{]*$") | (F.col("callback").isin("erc777_sender_hook", "erc777_receiver_hook") & code.rlike(r"^\s*function\b"))
    origin = F.col("callback").isin("low_level_value_call", "arbitrary_action") & code.rlike(P.ORIGIN_CALL)
    return e.line_flags.withColumn("callback", kind).where(F.col("callback").isNotNull() & ~head & ~origin).select(*KEY, "contract", "fn", F.col("line_no").alias("line"), "callback", "code")


@once
def asset_events(e: Effects) -> DataFrame:
    """(source_id, open_i, contract, fn, line, family, method, place): mints of others (`mint`), and calls that move assets on a cast or on what is named like a holder of assets (`external`).

    place orders the events of a line; a swap with an empty payload calls nobody back and does not count.
    """
    lines = e.line_flags.where(~F.col("code").rlike(r"^\s*(?:function|modifier)\b[^{]*$"))
    cols = [*KEY, "contract", "fn", F.col("line_no").alias("line")]
    mints = lines.select(*cols, F.lit("mint").alias("family"), F.posexplode(all_matches(F.col("code"), P.MINT_FAMILY, 1)).alias("place", "method"))
    call = r"\b((?:[A-Za-z_]\w*\s*\(\s*[A-Za-z_]\w*\s*\)|[A-Za-z_]\w*))\s*\.\s*([A-Za-z_]\w*)\s*(?:\{[^}\n]*\}\s*)?\("
    calls = lines.select(*cols, "code", F.posexplode(all_matches(F.col("code"), call)).alias("place", "call"))
    calls = calls.withColumn("receiver", F.regexp_extract("call", call, 1)).withColumn("method", F.regexp_extract("call", call, 2))
    calls = calls.where(F.lower("method").isin(P.EXTERNAL_ASSET_METHODS) & (F.col("receiver").endswith(")") | F.col("receiver").rlike(P.ASSET_HOLDERS))).where(~((F.lower("method") == "swap") & F.col("code").rlike(P.EMPTY_SWAP)))
    return mints.select(*KEY, "contract", "fn", "line", "family", "method", "place").union(calls.select(*KEY, "contract", "fn", "line", F.lit("external").alias("family"), "method", "place"))


def callback_events(e: Effects) -> DataFrame:
    return callbacks(e).select("source_id", "fn", "line", "callback")


def _guarded_sums(e: Effects) -> DataFrame:
    """One row a statement that adds to or takes from a mapping: whether a check before it names its operands."""
    st = e.facts.statements.where("not is_modifier")
    ops = st.withColumn("left", F.regexp_extract("text", r"^([A-Za-z_]\w*)\s*\[[^\]]*\]\s*(?:\+=|-=)", 1)).withColumn("right", F.regexp_extract("text", r"(?:\+=|-=)\s*([A-Za-z_]\w*)", 1)).where("left != '' and right != ''")
    ops = ops.select(*KEY, "fn", "stmt_no", "left", "right")
    checks = st.where(F.col("text").rlike(r"(?i)^(?:require|assert|if)\s*\(")).select(*KEY, F.col("stmt_no").alias("n"), F.col("text").alias("check"))
    covers = F.expr(r"n < stmt_no and rlike(check, concat('\\b', `left`, '\\b')) and rlike(check, concat('\\b', `right`, '\\b'))")
    return ops.join(checks, KEY, "left").groupBy(*KEY, "fn", "stmt_no").agg(F.max(F.coalesce(covers, F.lit(False))).alias("covered"))


def complete_arithmetic_guards(e: Effects) -> DataFrame:
    """(source_id, fn, n, complete): functions that add to or take from mappings; complete if a check before each names its operands."""
    return _guarded_sums(e).groupBy("source_id", "open_i", "fn").agg(F.count("*").alias("n"), F.bool_and("covered").alias("complete")).select("source_id", "fn", "n", "complete")


def hard_facts(e: Effects) -> DataFrame:
    """(source_id, fn, line, fact): protected calls, checked and dropped results, functions that nothing reaches."""
    g = e.guards.where("auth_guard").select(*KEY)
    protected = e.external_calls.join(g, KEY).select("source_id", "fn", "line", F.lit("protected_call").alias("fact"))
    d = R.call_decisions(e)
    checked = d.where("state = 'refuted'").select("source_id", "fn", "line", F.lit("checked_return").alias("fact"))
    dropped = d.where("state = 'confirmed'").select("source_id", "fn", "line", F.lit("dropped_return").alias("fact"))
    lost = e.graph.unreachable.select("source_id", "fn", F.col("start_line").alias("line"), F.lit("unreachable").alias("fact"))
    return protected.union(checked).union(dropped).union(lost)
