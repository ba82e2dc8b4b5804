"""Archived model responses: classes, fences, schemas, and the candidates that they name."""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.patterns import LABELS
from quarrymill.functions.text import normalize_lf
from quarrymill.storage import written

_BLANK = r"[\s\x1c-\x1f\x85\xa0]"
#: The member names of each closed object, by mode.
MEMBERS = {
    "full": ["identified_risks", "root_cause_analysis", "primary_vulnerabilities", "findings", "dos_pre_flight_check", "lifecycle_guardrail"],
    "four_field": ["identified_risks", "root_cause_analysis", "primary_vulnerabilities", "findings"],
    "compact": ["findings"],
    "candidate_ids": ["selected_candidate_ids"],
}
_RISK_KEYS = ["risk_type", "function_name", "triggering_data_flow", "terminal_action_check"]
_CONSTRAINT_KEYS = ["id", "description", "expression", "must_be", "related_line", "z3_schema", "llm_reasoning"]
_FINDING_KEYS = ["vulnerability_type", "function_name", "attack_path", "temporal_pattern", "ast_match_confidence", "constraint_violation_confidence", "constraints"]
_AUDIT = {
    "identified_risks[]": _RISK_KEYS, "findings[]": _FINDING_KEYS, "findings[].constraints[]": _CONSTRAINT_KEYS,
    "findings[].constraints[].z3_schema": ["state_variables", "pre_conditions", "state_transitions"],
    "findings[].constraints[].z3_schema.state_variables[]": ["name", "type"],
    "findings[].constraints[].z3_schema.pre_conditions[]": ["variable", "operator", "value", "must_be"],
    "findings[].constraints[].z3_schema.state_transitions[]": ["variable", "operator", "value"],
}
#: The member names of the closed objects inside, by mode and path; [] stands for the elements of an array.
INNER = {
    "full": _AUDIT | {
        "dos_pre_flight_check": ["is_gas_exhaustion_possible", "can_attacker_infinitely_inflate_loop", "is_ether_permanently_trapped_without_profit", "loop_variable", "is_attacker_controlled", "veto_dos"],
        "lifecycle_guardrail": ["is_initialization_function", "sets_critical_state", "has_reinit_guard", "has_access_check", "verdict"],
    },
    "four_field": _AUDIT,
    "compact": {"findings[]": ["category", "function_name", "primary_line", "evidence_lines", "reason"]},
    "candidate_ids": {},
}
_RISK = "struct<risk_type: string, function_name: string, triggering_data_flow: string, terminal_action_check: string>"
_CONSTRAINT = "struct<id: string, description: string, expression: string, must_be: string, related_line: string, llm_reasoning: string>"
_FINDING = f"struct<vulnerability_type: string, function_name: string, attack_path: string, temporal_pattern: string, ast_match_confidence: double, constraint_violation_confidence: double, constraints: array<{_CONSTRAINT}>, category: string, primary_line: int, evidence_lines: array<int>, reason: string>"
SCHEMA = f"struct<identified_risks: array<{_RISK}>, root_cause_analysis: string, primary_vulnerabilities: array<string>, findings: array<{_FINDING}>, selected_candidate_ids: array<string>>"


def _parsed(text: str) -> tuple[str, str]:
    """Class of a text that is not blank, and the canonical form of its JSON value (or '')."""

    def reject(name: str):
        raise ValueError(name)

    body = text.lstrip()
    try:
        value, end = json.JSONDecoder(parse_constant=reject).raw_decode(body)
    except (ValueError, RecursionError):
        return "MALFORMED_JSON", ""
    if body[end:].strip():
        return "TRAILING_DATA", ""
    canonical = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return ("JSON_OBJECT" if isinstance(value, dict) else "NON_OBJECT_JSON"), canonical


def _parse(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([("EMPTY_RESPONSE", "") if not t or not t.strip() else _parsed(t) for t in texts], columns=["class", "canonical"])


def classify_responses(df: DataFrame, raw: str = "raw") -> DataFrame:
    """class, present, utf8_valid, json_syntax_valid, strict_contract_valid and canonical (key-sorted compact JSON) of each response.

    raw is a string or binary column; the text is LF-normalised first.  A null is empty.
    """
    is_bytes = dict(df.dtypes)[raw] == "binary"
    valid = F.is_valid_utf8(F.col(raw).cast("string")) if is_bytes else F.lit(True)
    text = normalize_lf(F.coalesce(F.col(raw).cast("string"), F.lit("")))
    parse = F.pandas_udf(_parse, "struct<class: string, canonical: string>")
    rows = df.withColumn("utf8_valid", F.coalesce(valid, F.lit(True))).withColumn("p", parse(F.when(F.col("utf8_valid"), text).otherwise("")))
    kind = F.when(~F.col("utf8_valid"), "INVALID_UTF8").otherwise(F.col("p.class"))
    rows = rows.withColumn("class", kind).withColumn("canonical", F.col("p.canonical")).drop("p")
    present = F.when(F.col("class") == "INVALID_UTF8", F.octet_length(raw) > 0).otherwise(F.col("class") != "EMPTY_RESPONSE")
    return rows.withColumn("present", present).withColumn("json_syntax_valid", F.col("class").isin("JSON_OBJECT", "NON_OBJECT_JSON")).withColumn("strict_contract_valid", F.col("class") == "JSON_OBJECT")


def canonical_hash(df: DataFrame, raw: str = "raw") -> DataFrame:
    """canonical_sha256: hash of the canonical JSON; null where the response is no single JSON value."""
    rows = classify_responses(df, raw)
    return rows.withColumn("canonical_sha256", F.when(F.col("json_syntax_valid"), F.sha2("canonical", 256)))


def archive_receipts(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Class, encoding, newline, byte_length and sha256 of each response as it is archived: UTF-8 with LF line ends."""
    text = normalize_lf(F.coalesce(F.col(raw).cast("string"), F.lit("")))
    rows = classify_responses(df, raw)
    return rows.select("response_id", "class", "present", "strict_contract_valid", F.lit("utf-8").alias("encoding"), F.lit("lf").alias("newline"), F.octet_length(text).alias("byte_length"), F.sha2(text, 256).alias("sha256"))


def unwrap_fenced(df: DataFrame, raw: str = "raw") -> DataFrame:
    """applied, accepted, reason and normalized_text: exactly one json fence around one JSON object is taken off, nothing is repaired."""
    rows = classify_responses(df, raw).withColumnRenamed("class", "raw_class").withColumnRenamed("strict_contract_valid", "raw_valid")
    rows = rows.drop("canonical", "present", "json_syntax_valid")
    stripped = F.regexp_replace(normalize_lf(F.coalesce(F.col(raw).cast("string"), F.lit(""))), f"^{_BLANK}+|{_BLANK}+$", "")
    body = F.regexp_extract(stripped, r"(?s)^```json[ \t]*\n(.*?)\n```$", 1)
    whole = stripped.rlike(r"(?s)^```json[ \t]*\n.*?\n```$")
    fences = F.regexp_count(stripped, F.lit("```"))
    rows = rows.withColumn("stripped", stripped).withColumn("body", F.regexp_replace(body, f"^{_BLANK}+|{_BLANK}+$", ""))
    rows = classify_responses(rows.withColumnRenamed("utf8_valid", "raw_utf8"), "body")
    reason = (
        F.when(F.col("raw_class") == "INVALID_UTF8", "INVALID_UTF8").when(F.col("raw_class") == "EMPTY_RESPONSE", "EMPTY_RESPONSE").when(F.col("raw_valid"), "RAW_JSON_OBJECT_ALREADY_VALID")
        .when(fences != 2, "EXPECTED_EXACTLY_ONE_FENCE_PAIR").when(~whole, "FENCE_MUST_BE_THE_ONLY_OUTER_CONTENT")
        .when(~F.col("strict_contract_valid"), F.concat(F.lit("NORMALIZED_CONTRACT_INVALID:"), "class")).otherwise("SINGLE_JSON_FENCE_UNWRAPPED")
    )
    rows = rows.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "SINGLE_JSON_FENCE_UNWRAPPED")
    text = F.when(F.col("accepted"), F.col("body")).when(F.col("raw_valid"), F.col("stripped"))
    return rows.withColumn("applied", F.col("accepted")).withColumn("normalized_text", text).drop("stripped", "body", "class", "canonical", "present", "utf8_valid", "json_syntax_valid", "strict_contract_valid", "raw_utf8")


def _read(df: DataFrame) -> DataFrame:
    return unwrap_fenced(df).where("normalized_text is not null").withColumn("j", F.from_json("normalized_text", SCHEMA))


def flatten_findings(df: DataFrame) -> DataFrame:
    """One row a finding of each response that is, or unwraps to, a JSON object: full and compact forms in the same columns."""
    rows = _read(df).select("response_id", "source_id", "mode", F.posexplode("j.findings").alias("place", "f"))
    label = F.coalesce("f.vulnerability_type", "f.category")
    return rows.select("response_id", "source_id", "mode", "place", label.alias("label"), F.col("f.function_name").alias("fn"), "f.primary_line", F.coalesce(F.size("f.evidence_lines"), F.lit(0)).alias("n_evidence"), F.coalesce(F.col("f.attack_path"), F.col("f.reason")).alias("path"), "f.constraint_violation_confidence", label.isin(LABELS).alias("known_label"))


def flatten_risks(df: DataFrame) -> DataFrame:
    rows = _read(df).select("response_id", "mode", F.posexplode("j.identified_risks").alias("place", "r"))
    return rows.select("response_id", "mode", "place", "r.risk_type", "r.function_name", "r.triggering_data_flow", "r.terminal_action_check")


def flatten_constraints(df: DataFrame) -> DataFrame:
    rows = _read(df).select("response_id", F.posexplode("j.findings").alias("finding", "f")).select("response_id", "finding", F.posexplode("f.constraints").alias("place", "c"))
    return rows.select("response_id", "finding", "place", "c.id", "c.expression", "c.must_be", "c.related_line")


def json_paths(rows: DataFrame) -> DataFrame:
    """(response_id, mode, path, key, kind) of rows (response_id, mode, text): extra and missing keys of the closed objects inside, at any depth of the schema.

    Texts are shredded level by level into (path, value) rows, where a value is JSON text; a
    level keeps the paths that the schema of the mode closes or that lead to one, so there are as many levels as
    the schema is deep.  Values that are no objects where the schema has one count as empty ones; nulls are left alone.
    """
    paths = {(mode, path[:end]) for mode, inner in INNER.items() for path in inner for end in [i for i, c in enumerate(path + ".") if c == "." or path[i : i + 2] == "[]"]}
    paths |= {(mode, path) for mode, inner in INNER.items() for path in inner}
    depth = max(path.count(".") + path.count("[]") for _, path in paths) + 1
    mark = lambda mode, path: F.concat(mode, F.lit("|"), path)
    on_way = F.array(*[F.lit(f"{mode}|{path}") for mode, path in sorted(paths)])
    wanted = F.create_map(*[x for mode, inner in INNER.items() for path, keys in inner.items() for x in (F.lit(f"{mode}|{path}"), F.array(*map(F.lit, keys)))])
    none = F.array().cast("array<string>")
    part = lambda path, value: F.struct(path.alias("path"), F.ltrim(value).alias("value"))
    level, found = rows.select("response_id", "mode", F.lit("").alias("path"), F.col("text").alias("value")), []
    for _ in range(depth):
        fields = F.transform(F.map_entries(F.from_json("value", "map<string,string>")), lambda e: part(F.concat(F.col("path"), F.when(F.col("path") != "", ".").otherwise(""), e["key"]), e["value"]))
        items = F.transform(F.from_json("value", "array<string>"), lambda v: part(F.concat(F.col("path"), F.lit("[]")), v))
        inside = F.filter(F.when(F.col("value").startswith("["), items).otherwise(fields), lambda x: x["value"].isNotNull() & F.array_contains(on_way, mark(F.col("mode"), x["path"])))
        level = written(level.select("response_id", "mode", F.explode(inside).alias("x")).select("response_id", "mode", "x.path", "x.value"), "paths")
        keys = F.coalesce(F.map_keys(F.from_json("value", "map<string,string>")), none)
        here = level.withColumn("want", F.try_element_at(wanted, mark(F.col("mode"), F.col("path")))).where("want is not null").withColumn("keys", keys)
        odd = lambda kind, keys: F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(kind).alias("kind")))
        here = here.select("response_id", "mode", "path", F.explode(F.concat(odd("extra_key", F.array_except("keys", "want")), odd("missing_key", F.array_except("want", "keys")))).alias("x"))
        found.append(here.select("response_id", "mode", "path", "x.key", "x.kind"))
    return reduce(DataFrame.union, found).distinct()


def validate_responses(df: DataFrame) -> DataFrame:
    """problems of each response against the closed schema of its mode: extra and missing keys, labels, shares outside 0..1, lines under 1.

    Keys of objects inside are named with their path, as in `missing_key:findings[].reason`.
    """
    members = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in MEMBERS.items() for x in kv])
    rows = _read(df).withColumn("keys", F.coalesce(F.json_object_keys("normalized_text"), F.array().cast("array<string>"))).withColumn("want", F.element_at(members, F.col("mode")))
    labels = F.concat(F.coalesce(F.transform("j.findings", lambda x: F.coalesce(x["vulnerability_type"], x["category"])), F.array().cast("array<string>")), F.coalesce("j.primary_vulnerabilities", F.array().cast("array<string>")))
    share = lambda x: x.isNull() | x.between(0, 1)
    findings = F.coalesce(F.col("j.findings"), F.from_json(F.lit("[]"), f"array<{_FINDING}>"))
    problems = F.array(
        F.when(F.size(F.array_except("keys", "want")) > 0, "extra_key"),
        F.when(F.size(F.array_except("want", "keys")) > 0, "missing_key"),
        F.when(F.exists(labels, lambda x: ~F.coalesce(x.isin(LABELS), F.lit(False))), "unknown_label"),
        F.when(~F.forall(findings, lambda x: share(x["ast_match_confidence"]) & share(x["constraint_violation_confidence"])), "share_out_of_range"),
        F.when(~F.forall(findings, lambda x: x["primary_line"].isNull() | (x["primary_line"] >= 1)), "line_out_of_range"),
    )
    rows = rows.select("response_id", "mode", F.col("normalized_text").alias("text"), F.filter(problems, lambda x: x.isNotNull()).alias("problems"))
    rows = written(rows, "problems")  # read twice: the responses are parsed once
    inner = json_paths(rows.select("response_id", "mode", "text"))
    named = F.concat("kind", F.lit(":"), "path", F.lit("."), "key")
    inner = inner.groupBy("response_id").agg(F.sort_array(F.collect_set(named)).alias("inside"))
    rows = rows.join(inner, "response_id", "left")
    problems = F.concat("problems", F.coalesce("inside", F.array().cast("array<string>")))
    return rows.select("response_id", "mode", problems.alias("problems"), (F.size(problems) == 0).alias("valid"))


def selected_ids(df: DataFrame) -> DataFrame:
    return _read(df).select("response_id", "source_id", F.explode(F.array_distinct("j.selected_candidate_ids")).alias("candidate_id"))


def select_candidates(candidates: DataFrame, df: DataFrame) -> DataFrame:
    """candidates(candidate_id, ...) that some response selected."""
    return candidates.join(selected_ids(df), "candidate_id", "left_semi")


def unknown_ids(candidates: DataFrame, df: DataFrame) -> DataFrame:
    """Selected ids that no candidate has."""
    return selected_ids(df).join(candidates, "candidate_id", "left_anti")


def response_report(df: DataFrame) -> DataFrame:
    """Counts by mode, class and adapter outcome; a wrapped response still counts under its raw class."""
    return unwrap_fenced(df).groupBy("mode", "raw_class", "reason").agg(F.count("*").alias("n"), F.count_if("accepted").alias("n_accepted"), F.count_if("raw_valid").alias("n_raw_valid"))


_TOKENS = re.compile(r""""(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\w+|[^\w\s]""")


def _pair(old: str, new: str, old_limit: int, new_limit: int) -> tuple | None:
    a, b = list(_TOKENS.finditer(old)), list(_TOKENS.finditer(new))
    if not a or not b or min(old_limit, new_limit) <= 0:
        return None
    groups = list(difflib.SequenceMatcher(None, [t[0] for t in a], [t[0] for t in b], autojunk=False).get_grouped_opcodes(8))
    if not groups:
        return None
    if len(old) <= old_limit and len(new) <= new_limit:
        return "full_pair", old, new, len(groups), len(groups)

    def lines(text: str, tokens: list, start: int, stop: int) -> str:
        first = tokens[min(start, len(tokens) - 1)].start()
        last = tokens[min(max(stop, min(start, len(tokens) - 1) + 1), len(tokens)) - 1].end()
        begin = text.rfind("\n", 0, first) + 1
        end = text.find("\n", last) if "\n" in text[last:] else len(text)
        return f"[Historical document lines {text.count(chr(10), 0, begin) + 1}-{text.count(chr(10), 0, end) + 1}]\n{text[begin:end]}"

    kept: list[tuple[str, str]] = []
    for g in groups:
        more = [*kept, (lines(old, a, g[0][1], g[-1][2]), lines(new, b, g[0][3], g[-1][4]))]
        if all(len("\n...\n".join(p[i] for p in more)) <= limit for i, limit in enumerate((old_limit, new_limit))):
            kept = more
    if not kept:
        return None
    return "changed_line_windows", "\n...\n".join(p[0] for p in kept), "\n...\n".join(p[1] for p in kept), len(groups), len(kept)


def pair_views(pairs: DataFrame, document_limit: int, patch_limit: int) -> DataFrame:
    """pairs(pair_id, vulnerable, patched) as views that fit both limits: whole, or the changed lines, group by group while they fit.

    Pairs without a change of tokens, or of which no group fits, have none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            got = [(i, _pair(v or "", p or "", document_limit, patch_limit)) for i, v, p in zip(df.pair_id, df.vulnerable, df.patched)]
            yield pd.DataFrame([(i, *x) for i, x in got if x], columns=["pair_id", "view", "before", "after", "n_groups", "n_visible"])

    return pairs.select("pair_id", "vulnerable", "patched").mapInPandas(run, "pair_id long, view string, before string, after string, n_groups long, n_visible long")
