"""One registered query for each operator, over the corpus made from the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import candidates as C
from quarrymill.operators import facts as T
from quarrymill.operators import flows as L
from quarrymill.operators import paths as H
from quarrymill.operators import responses as M
from quarrymill.operators import rules as R
from quarrymill.operators.effects import KEY, Effects
from quarrymill.operators.facts import Facts
from quarrymill.sources import corpus
from quarrymill.sources.io import read_sources, source_receipts, write_findings
from quarrymill.storage import shared_folder


def _flat(df: DataFrame) -> DataFrame:
    """Arrays as comma-joined text, so that engines print the same."""
    kinds = dict(df.dtypes)
    return df.select(*[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if kinds[c].startswith("array") else F.col(c) for c in df.columns])


def _named(e: Effects, df: DataFrame, column: str, as_: str) -> DataFrame:
    """df with a function's id replaced by its name."""
    names = e.facts.functions.select("source_id", F.col("open_i").alias(column), F.col("fn").alias(as_))
    return df.join(names, ["source_id", column]).drop(column)


def _risky(e: Effects) -> DataFrame:
    return C.audited(e).where("admission").select(*KEY).distinct()


_FN = ["source_id", "contract", "fn", "start_line"]
_CANDIDATE = ["source_id", "rule_id", "risk_type", "contract", "fn", "entrypoint", "sink", "line", "sink_line", "evidence_lines", "state_write_lines", "operation_lines", "confidence", "evidence_kind"]


def _refs(e: Effects) -> DataFrame:
    """References to every function by upper-case name, with its contract and a line inside it."""
    return e.facts.functions.select(F.concat_ws(":", "source_id", "start_line").alias("ref_id"), "source_id", F.upper("fn").alias("name"), "contract", F.col("end_line").alias("line"))


def _temporal_summary(e: Effects) -> DataFrame:
    kinds = R.temporal_facts(e).groupBy("source_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("read", "alias", "guard", "write", "asset")])
    near = e.graph.neighbourhood(R.temporal_facts(e).where("kind = 'read'").select(*KEY).distinct()).groupBy("source_id").agg(F.count("*").alias("n_functions"))
    return kinds.join(near, "source_id", "left").withColumn("n_functions", F.coalesce("n_functions", F.lit(0)))


#: name -> what it computes over the effects of a corpus
AUDIT: dict[str, Callable[[Effects], DataFrame]] = {
    "tx3_pragma_versions": lambda e: T.pragma_versions(e.facts.sources),
    "tx5_contracts": lambda e: e.facts.contracts,
    "tx6_functions": lambda e: e.facts.functions.select(*_FN, "end_line", "visibility", "mutability", "modifiers", "is_constructor", "is_fallback", "is_receive"),
    "tx7_parameters": lambda e: e.facts.parameters,
    "tx8_modifiers": lambda e: e.facts.modifiers.drop("open_i"),
    "tx9_state_variables": lambda e: e.facts.state_variables,
    "tx10_statements": lambda e: e.facts.statements.drop("open_i", "first_i", "close_i"),
    "tx11_line_functions": lambda e: e.facts.line_functions.select("source_id", F.col("line_no").alias("line"), "contract", "fn"),
    "tx12_matching_lines": lambda e: e.facts.matching_lines(r"msg\s*\.\s*sender"),
    "tx13_identifier_words": lambda e: e.facts.identifier_words,
    "tx15_resolve_spans": lambda e: C.resolve_spans(_refs(e), e).select("source_id", "contract", "fn", "start_line", "end_line"),
    "tx16_typed_signatures": lambda e: R.typed_signatures(e),
    "gr1_call_edges": lambda e: e.graph.edges.select("source_id", "caller_fn", "line", "callee_fn"),
    "gr2_reachable_roots": lambda e: e.graph.reachable_roots.select("source_id", "root_fn", "fn", "depth"),
    "gr3_reachability_paths": lambda e: e.graph.paths.select("source_id", "fn", F.array_join("path", ">").alias("path")),
    "gr3_unreachable": lambda e: e.graph.unreachable.select(*_FN),
    "gr4_write_closure": lambda e: _named(e, e.write_closure, "root", "fn"),
    "gr6_helper_neighbourhood": lambda e: _named(e, e.graph.neighbourhood(e.external_calls.select(*KEY).distinct()), "open_i", "fn"),
    "gr6_public_callers": lambda e: e.graph.public_callers.select("source_id", "fn", "callers"),
    "gr7_rw_conflicts": lambda e: R.rw_conflicts(e).select("source_id", "contract", "name", "writer", "reader", "financial"),
    "gr10_guarded_actions": lambda e: R.guarded_actions(e).select("source_id", "fn", "guard_line", "action", "action_line"),
    "gr11_economic_bindings": lambda e: R.economic_bindings(e).select("source_id", "fn", "line", "sink_line", "word"),
    "gr12_backward_slice": lambda e: C.backward_slice(e, _risky(e), keep_whole=10).select("source_id", "n_kept"),
    "ef1_direct_effects": lambda e: e.direct_effects.drop("open_i"),
    "ef3_state_write_lines": lambda e: e.state_writes.select("source_id", "contract", "fn", "line", "critical", "names"),
    "ef5_external_calls": lambda e: e.external_calls.select("source_id", "contract", "fn", "line", "method"),
    "ef5_asset_events": lambda e: L.asset_events(e).select("source_id", "fn", "line", "family", "method"),
    "gr9_nearest_locator": lambda e: C.nearest_locator(R.rule_re1(e), e.external_calls.select(*KEY, F.col("line").alias("at"))).select("source_id", "fn", "line", "at"),
    "ef6_runtime_events": lambda e: _named(e, e.runtime_events, "root", "root_fn").select("source_id", "root_fn", "step", "kind", "line"),
    "ef7_reentrancy_summary": lambda e: e.reentrancy_summary.drop("root"),
    "ef9_loop_features": lambda e: R.loop_features(e),
    "gu1_authorization": lambda e: e.guards.select(*_FN, "auth_status", "auth_lines"),
    "gu2_admin_restricted": lambda e: e.admin_restricted.select("source_id", "contract", "fn", "restricted"),
    "gu3_mutex": lambda e: e.guards.select(*_FN, "mutex", "mutex_lines", "mutex_guard"),
    "gu4_protected_functions": lambda e: e.guards.where("auth_guard").select(*_FN),
    "gu6_unchecked_arithmetic": lambda e: R.unchecked_arithmetic(e).select("source_id", "fn", "stmt_no", "line", "op", "operand", "protected"),
    "uc1_call_decisions": lambda e: R.call_decisions(e).select("source_id", "fn", "line", "method", "names", "check_lines", "check_kinds", "state"),
    "uc2_decision_at_line": lambda e: R.decision_at(e, e.external_calls.select("source_id", "line")),
    "uc4_discarded_returns": lambda e: R.discarded_returns(e).select("source_id", "fn", "line", "name", "type", "method", "returns"),
    "tm1_temporal_facts": lambda e: R.clock_facts(e).select("source_id", "fn", "is_modifier", "kind", "line", "name"),
    "tm2_temporal_relations": lambda e: R.temporal_relations(e),
    "tm13_temporal_summary": _temporal_summary,
    "hi1_hints": lambda e: R.hints(e),
    "hi1_risk_hints": lambda e: R.risk_hints(e),
    "hi2_hard_facts": lambda e: L.hard_facts(e),
    "gr14_def_use_chains": lambda e: L.def_use_chains(e),
    "uc5_undebited_transfers": lambda e: L.undebited_transfers(e),
    "uc7_tracked_results": lambda e: L.tracked_results(e),
    "ar2_arithmetic_sinks": lambda e: L.arithmetic_sinks(e),
    "ar3_provenance": lambda e: L.arithmetic_provenance(e),
    "ef4_callback_events": lambda e: L.callback_events(e),
    "ef8_best_state_writes": lambda e: L.best_state_writes(e),
    "gr5_callback_libraries": lambda e: H.callback_libraries(e),
    "gr13_sink_flows": lambda e: H.sink_flows(e).drop("n_kept", "slice"),
    "re10_callback_anchors": lambda e: H.callback_anchors(e),
    "re11_evidence_chains": lambda e: H.evidence_chains(e),
    "tm3_field_flows": lambda e: H.field_flows(e).drop("open_i"),
    "tm4_unbounded_signatures": lambda e: H.unbounded_signatures(e).select(*_FN),
    "gu5_complete_guards": lambda e: L.complete_arithmetic_guards(e),
    "ca1_union": lambda e: C.all_candidates(e).select(_CANDIDATE),
    "ca2_append": lambda e: C.append_candidates(R.rule_re1(e), R.rule_re2(e)).select(_CANDIDATE),
    "ca3_normalize": lambda e: C.normalize(C.all_candidates(e), e).select("source_id", "rule_id", "fn", "line", "evidence_lines"),
    "ca4_admit": lambda e: C.admit(C.all_candidates(e), e).select("source_id", "rule_id", "fn", "line", "clean", "admission_reason"),
    "ca5_merge": lambda e: C.audited(e).select("source_id", "risk_type", "fn", "line", "entrypoint", "rule_id", "evidence_lines", "clean", "admission"),
    "ca7_findings_call_site": lambda e: C.to_findings(C.audited(e), e).drop("alert_id", "candidate_id", "attack_path"),
    "ca7_findings_sink": lambda e: C.to_findings(C.audited(e), e, "sink").select("source_id", "vulnerability_type", "fn", "primary_line", "anchor_lines"),
    "ca8_risk_function_map": lambda e: C.risk_function_map(C.audited(e).where("admission")),
    "ca9_enabled_rules": lambda e: C.enabled_rules(C.all_candidates(e), "core").select("source_id", "rule_id", "fn", "line"),
} | {f"{name.lower()}_rule": (lambda e, rule=rule: rule(e).select(_CANDIDATE)) for name, rule in H.ALL_RULES.items()}


def audit(spark: SparkSession, sf_dir: str) -> Effects:
    return Effects(Facts(corpus.sources(spark, sf_dir)))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before and after: every source's text, and the same with its second line changed for two of three."""
    s = corpus.sources(spark, sf_dir)
    after = F.when(F.col("source_id") % 3 == 0, F.col("text")).otherwise(F.regexp_replace("text", "uint256 amount", "uint128 amount"))
    return s.select(F.col("source_id").alias("pair_id"), F.col("text").alias("vulnerable"), after.alias("patched"))


def _read_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus written as a table of sources, and read from there."""
    path = f"{shared_folder(spark)}/sources-{uuid.uuid4().hex}.parquet"
    corpus.sources(spark, sf_dir).write.parquet(path)
    return read_sources(spark, path).select("source_id", F.char_length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


def _written_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of one rule written as files by label, and read from there."""
    e = audit(spark, sf_dir)
    path = f"{shared_folder(spark)}/findings-{uuid.uuid4().hex}"
    rule = C.append_candidates(R.rule_re1(e), R.rule_re2(e))
    write_findings(rule.select("source_id", F.col("risk_type").alias("vulnerability_type"), "rule_id", "fn", "line"), path)
    schema = "source_id long, rule_id string, fn string, line int, vulnerability_type string"
    return spark.read.schema(schema).json(path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {name: (lambda spark, sf_dir, make=make: _flat(make(audit(spark, sf_dir)))) for name, make in AUDIT.items()}
    found |= {
        "io3_source_receipts": lambda spark, d: source_receipts(corpus.sources(spark, d)),
        "io1_read_sources": _read_again,
        "io5_findings_written": _written_findings,
        "tx2_lines": lambda spark, d: T.lines(corpus.sources(spark, d)),
        "tx4_delimiter_pairs": lambda spark, d: T.delimiter_pairs(corpus.sources(spark, d)),
        "ca6_candidate_ids": lambda spark, d: C.with_candidate_id(R.rule_re1(audit(spark, d))).select("source_id", "fn", "line", "candidate_id"),
        "io4_archive_receipts": lambda spark, d: M.archive_receipts(corpus.responses(spark, d)),
        "mr1_classify": lambda spark, d: M.classify_responses(corpus.responses(spark, d)).select("response_id", "class", "present", "utf8_valid", "json_syntax_valid", "strict_contract_valid"),
        "mr2_canonical_hash": lambda spark, d: M.canonical_hash(corpus.responses(spark, d)).select("response_id", "canonical_sha256"),
        "mr3_unwrap_fenced": lambda spark, d: M.unwrap_fenced(corpus.responses(spark, d)).select("response_id", "raw_class", "applied", "accepted", "reason"),
        "mr4_findings": lambda spark, d: M.flatten_findings(corpus.responses(spark, d)).drop("source_id"),
        "mr4_risks": lambda spark, d: M.flatten_risks(corpus.responses(spark, d)),
        "mr4_constraints": lambda spark, d: M.flatten_constraints(corpus.responses(spark, d)),
        "mr5_validate": lambda spark, d: _flat(M.validate_responses(corpus.responses(spark, d))),
        "mr6_selected": lambda spark, d: M.selected_ids(corpus.responses(spark, d)),
        "mr6_unknown": lambda spark, d: M.unknown_ids(corpus.sources(spark, d).select(F.concat(F.col("source_id").cast("string"), F.lit("-1")).alias("candidate_id")), corpus.responses(spark, d)),
        "mr7_report": lambda spark, d: M.response_report(corpus.responses(spark, d)),
        "mr8_pair_views": lambda spark, d: M.pair_views(_pairs(spark, d), 700, 700).select("pair_id", "view", "n_groups", "n_visible"),
    }
    return found
