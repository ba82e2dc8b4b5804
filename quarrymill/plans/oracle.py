"""SQL that the registered queries are held against.

Where SQL can compute a query from the sources' text, it does.  For the rest, the rows that
each template must give are listed in expected.py; SQL spreads them over the parts, puts the
key into names and moves lines by the filler lines of each source.
"""

from __future__ import annotations

from quarrymill.functions.patterns import EXTERNAL_ASSET_METHODS
from quarrymill.plans.expected import EXPECTED
from quarrymill.sources.corpus import N, RESPONSES_SQL, SOURCES_SQL, TEMPLATES

#: The line with the first contract's opening brace, after which filler lines stand.
_FILLER_AFTER = [t[: t.index("#")].count("\n") for t in TEMPLATES]


def _literal(value, kind: str) -> str:
    if value is None:
        return "NULL"
    if kind == "L":
        return "[" + ",".join(map(str, value)) + "]::BIGINT[]"
    if kind == "S":
        value = ",".join(value)
    if kind in "sS":
        return "'" + value.replace("'", "''") + "'"
    if kind == "b":
        return "TRUE" if value else "FALSE"
    return f"{value}::DOUBLE" if kind == "d" else str(value)


def expected_sql(name: str) -> str:
    columns, rows = EXPECTED[name]
    kinds = [c.split(":") for c in columns.split()]
    if not rows:  # no template gives a row
        rows = [(-1, *({"l": 0, "L": [], "i": 0, "d": 0.0, "b": False, "S": []}.get(k, "") for _, k in kinds))]
    shift = "(CASE WHEN {x} > a.after THEN p.p_size % 5 ELSE 0 END)"
    values = ",\n".join("(" + ", ".join([str(r[0]), *(_literal(v, k) for v, (_, k) in zip(r[1:], kinds))]) + ")" for r in rows)
    out = []
    for c, k in kinds:
        if k in "sS":
            out.append(f"replace(v.\"{c}\", '@', CAST(p.p_partkey AS VARCHAR)) AS \"{c}\"")
        elif k == "l":
            out.append(f'CAST(v."{c}" + {shift.format(x=f"v.{chr(34)}{c}{chr(34)}")} AS BIGINT) AS "{c}"')
        elif k == "L":
            out.append(f'array_to_string(list_transform(v."{c}", lambda x: x + {shift.format(x="x")}), \',\') AS "{c}"')
        else:
            out.append(f'v."{c}"')
    after = ", ".join(f"({i}, {a})" for i, a in enumerate(_FILLER_AFTER))
    names = ", ".join(["t", *(f'"{c}"' for c, _ in kinds)])
    return f"SELECT p.p_partkey AS source_id, {', '.join(out)} FROM part p JOIN (VALUES {after}) a(t, after) ON p.p_partkey % {N} = a.t JOIN (VALUES {values}) v({names}) ON v.t = a.t"


_TOKEN = r"""(?s)//[^\n]*|/\*.*?(?:\*/|\z)|"(?:\\.|[^"\\\n])*"?|''(?:\\.|[^''\\\n])*''?|[^/"'']+|."""
_MASK = f"""array_to_string(list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda x: CASE WHEN starts_with(x, '//') OR starts_with(x, '/*') THEN regexp_replace(x, '[^\\n]', ' ', 'g') ELSE x END), '')"""
_MASK_ALL = f"""array_to_string(list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda x: CASE WHEN starts_with(x, '//') OR starts_with(x, '/*') THEN regexp_replace(x, '[^\\n]', ' ', 'g') WHEN x[1] IN ('"', '''') AND length(x) >= 2 THEN concat(x[1], regexp_replace(x[2:length(x) - 1], '[^\\n]', ' ', 'g'), x[length(x)]) ELSE x END), '')"""

_LF = "regexp_replace(raw, '\\r\\n?', chr(10), 'g')"
#: For each response by its number: class, canonical JSON, adapter reason.
_CANON_FINDING = '{"category":"%s","evidence_lines":[1,2],"function_name":"f","primary_line":%s,"reason":"r"}'
_CLASSES = [
    ("EMPTY_RESPONSE", None, "EMPTY_RESPONSE"),
    ("EMPTY_RESPONSE", None, "EMPTY_RESPONSE"),
    ("JSON_OBJECT", '{"findings":[' + _CANON_FINDING % ("reentrancy", "3") + "]}", "RAW_JSON_OBJECT_ALREADY_VALID"),
    ("JSON_OBJECT", '{"findings":[' + _CANON_FINDING % ("reentrancy", "0") + "," + _CANON_FINDING % ("gas", "4") + "]}", "RAW_JSON_OBJECT_ALREADY_VALID"),
    ("JSON_OBJECT", '{"selected_candidate_ids":["@-1","@-9","@-1"]}', "RAW_JSON_OBJECT_ALREADY_VALID"),
    ("TRAILING_DATA", None, "EXPECTED_EXACTLY_ONE_FENCE_PAIR"),
    ("NON_OBJECT_JSON", "[1,2]", "EXPECTED_EXACTLY_ONE_FENCE_PAIR"),
    ("NON_OBJECT_JSON", "12.5", "EXPECTED_EXACTLY_ONE_FENCE_PAIR"),
    ("MALFORMED_JSON", None, "EXPECTED_EXACTLY_ONE_FENCE_PAIR"),
    ("MALFORMED_JSON", None, "EXPECTED_EXACTLY_ONE_FENCE_PAIR"),
    ("MALFORMED_JSON", None, "SINGLE_JSON_FENCE_UNWRAPPED"),
    ("MALFORMED_JSON", None, "EXPECTED_EXACTLY_ONE_FENCE_PAIR"),
    ("MALFORMED_JSON", None, "FENCE_MUST_BE_THE_ONLY_OUTER_CONTENT"),
    ("JSON_OBJECT", '{"b":{"a":[true,null,"é"],"z":1},"findings":[]}', "RAW_JSON_OBJECT_ALREADY_VALID"),
    ("JSON_OBJECT", '{"findings":[{"ast_match_confidence":0.9,"attack_path":"p","constraint_violation_confidence":1.5,"constraints":[{"description":"d","expression":"e","id":"c1","llm_reasoning":"l","must_be":"true","related_line":"7","z3_schema":{"pre_conditions":[],"state_transitions":[],"state_variables":[]}}],"function_name":"f","temporal_pattern":"t","vulnerability_type":"reentrancy"}],"identified_risks":[{"function_name":"f","risk_type":"reentrancy","terminal_action_check":"t","triggering_data_flow":"d"}],"primary_vulnerabilities":["reentrancy"],"root_cause_analysis":"r"}', "RAW_JSON_OBJECT_ALREADY_VALID"),
    ("MALFORMED_JSON", None, "NORMALIZED_CONTRACT_INVALID:NON_OBJECT_JSON"),
]
_KNOWN = f"known(t, class, canonical, reason) AS (VALUES {', '.join('(' + ', '.join([str(i), *(_literal(v, 's') for v in r)]) + ')' for i, r in enumerate(_CLASSES))})"
_R = f"WITH {RESPONSES_SQL}, {_KNOWN} "


def _spread(columns: str, rows: list[tuple]) -> str:
    """Rows listed by response number, spread over the responses."""
    names = columns.split()
    values = ", ".join("(" + ", ".join("NULL" if v is None else ("TRUE" if v else "FALSE") if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else _literal(v, "s") for v in r) + ")" for r in rows)
    return f"WITH {RESPONSES_SQL} SELECT response_id, {', '.join('v.' + n for n in names)} FROM responses r JOIN (VALUES {values}) v(t, {', '.join(names)}) ON r.t = v.t"


ORACLE = {name: expected_sql(name) for name in EXPECTED} | {
    "io3_source_receipts": f"WITH {SOURCES_SQL}, h AS (SELECT source_id, sha256(text) AS sha256 FROM sources) SELECT source_id, sha256, count(*) OVER (PARTITION BY sha256) AS n_copies, min(source_id) OVER (PARTITION BY sha256) AS first_id FROM h",
    "tx2_lines": f"WITH {SOURCES_SQL}, m AS (SELECT source_id, string_split(text, chr(10)) AS raws, string_split({_MASK}, chr(10)) AS codes FROM sources), u AS (SELECT source_id, unnest(raws) AS raw, unnest(codes) AS code, generate_subscripts(raws, 1) AS line_no FROM m) SELECT source_id, line_no, raw, code, CAST(coalesce(sum(length(raw) + 1) OVER (PARTITION BY source_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start_off FROM u",
    "tx4_delimiter_pairs": f"WITH {SOURCES_SQL}, m AS (SELECT source_id, {_MASK_ALL} AS m FROM sources), c AS (SELECT source_id, unnest(range(1, length(m) + 1)) AS i, m FROM m), b AS (SELECT source_id, i, m[i] AS ch, length(m) AS n FROM c WHERE m[i] IN ('{{', '}}')), d AS (SELECT *, sum(CASE WHEN ch = '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY source_id ORDER BY i) + CASE WHEN ch = '}}' THEN 1 ELSE 0 END AS depth FROM b), l AS (SELECT *, lead(i) OVER (PARTITION BY source_id, depth ORDER BY i) AS nx FROM d) SELECT source_id, i - 1 AS open_off, coalesce(nx - 1, n) AS close_off, depth FROM l WHERE ch = '{{'",
    "io1_read_sources": f"WITH {SOURCES_SQL} SELECT source_id, length(text) AS n_chars, sha256(text) AS sha256 FROM sources",
    "io5_findings_written": f"SELECT source_id, rule_id, fn, line, risk_type AS vulnerability_type FROM ({expected_sql('ca2_append')})",
    "gr9_nearest_locator": f"""WITH near AS (
  SELECT r.source_id, r.fn, r.line, c.line AS "at", row_number() OVER (PARTITION BY r.source_id, r.fn, r.line ORDER BY list_min(list_transform(string_split(r.evidence_lines, ','), lambda x: abs(x::BIGINT - c.line))), abs(r.line - c.line), c.line) AS k
  FROM ({expected_sql('re1_rule')}) r JOIN ({expected_sql('ef5_external_calls')}) c ON r.source_id = c.source_id AND r.contract = c.contract AND r.fn = c.fn)
SELECT source_id, fn, line, "at" FROM near WHERE k = 1""",
    "ef5_asset_events": rf"""WITH {SOURCES_SQL}, m AS (SELECT source_id, string_split({_MASK}, chr(10)) AS codes FROM sources),
l AS (SELECT source_id, unnest(codes) AS code, generate_subscripts(codes, 1) AS line FROM m),
f AS (SELECT l.*, t.fn FROM l JOIN ({expected_sql('tx11_line_functions')}) t ON l.source_id = t.source_id AND l.line = t.line WHERE NOT regexp_matches(code, '^\s*(function|modifier)\b[^{{]*$')),
c AS (SELECT source_id, fn, line, code, unnest(regexp_extract_all(code, '\b(?:[A-Za-z_]\w*\s*\(\s*[A-Za-z_]\w*\s*\)|[A-Za-z_]\w*)\s*\.\s*[A-Za-z_]\w*\s*(?:\{{[^}}
]*\}}\s*)?\(')) AS call FROM f),
e AS (SELECT *, trim(regexp_extract(call, '^(.*?)\s*\.\s*[A-Za-z_]\w*\s*(?:\{{[^}}
]*\}}\s*)?\($', 1)) AS receiver, regexp_extract(call, '\.\s*([A-Za-z_]\w*)\s*(?:\{{[^}}
]*\}}\s*)?\($', 1) AS method FROM c)
SELECT source_id, fn, line, 'mint' AS family, unnest(regexp_extract_all(code, '(?i)\.\s*(batchMint|safeMint|mint)\s*\(', 1)) AS method FROM f
UNION ALL
SELECT source_id, fn, line, 'external', method FROM e
WHERE lower(method) IN ({", ".join(f"'{x}'" for x in EXTERNAL_ASSET_METHODS)}) AND (ends_with(receiver, ')') OR regexp_matches(receiver, '^[A-Z]') OR regexp_matches(receiver, '(?i)token|router|pool|vault|asset|auction|helper'))
  AND NOT (lower(method) = 'swap' AND regexp_matches(code, '(?i)new\s+bytes\s*\(\s*0\s*\)'))""",
    "hi1_risk_hints": rf"""WITH {SOURCES_SQL}, m AS (SELECT source_id, string_split({_MASK}, chr(10)) AS codes FROM sources),
f AS (SELECT f.*, v.major, v.minor, g.restricted, u.mutex_guard, array_to_string(m.codes[f.start_line:f.end_line], chr(10)) AS body
  FROM ({expected_sql('tx6_functions')}) f JOIN m ON f.source_id = m.source_id JOIN ({expected_sql('tx3_pragma_versions')}) v ON f.source_id = v.source_id
  JOIN ({expected_sql('gu2_admin_restricted')}) g ON f.source_id = g.source_id AND f.contract = g.contract AND f.fn = g.fn
  JOIN ({expected_sql('gu3_mutex')}) u ON f.source_id = u.source_id AND f.contract = u.contract AND f.fn = u.fn AND f.start_line = u.start_line
  WHERE f.visibility IN ('public', 'external')),
w AS (SELECT f.source_id, f.start_line, string_agg(w.names, ',') AS names FROM f JOIN ({expected_sql('ef3_state_write_lines')}) w ON f.source_id = w.source_id AND w.line BETWEEN f.start_line AND f.end_line GROUP BY ALL),
c AS (SELECT DISTINCT f.source_id, f.start_line FROM f JOIN ({expected_sql('ef5_external_calls')}) c ON f.source_id = c.source_id AND c.line BETWEEN f.start_line AND f.end_line),
d AS (SELECT DISTINCT f.source_id, f.start_line FROM f JOIN ({expected_sql('uc7_tracked_results')}) t ON f.source_id = t.source_id AND t.line BETWEEN f.start_line AND f.end_line WHERE t.tracking = 'delayed_check'),
a AS (SELECT f.*, w.names, w.names IS NOT NULL AS writes, c.source_id IS NOT NULL AS calls, d.source_id IS NOT NULL AS late, regexp_matches(body, '\b(require|assert)\s*\(') AS checked
  FROM f LEFT JOIN w ON f.source_id = w.source_id AND f.start_line = w.start_line LEFT JOIN c ON f.source_id = c.source_id AND f.start_line = c.start_line LEFT JOIN d ON f.source_id = d.source_id AND f.start_line = d.start_line),
k AS (
  SELECT *, 'missing_checks' AS kind FROM a WHERE writes AND NOT is_constructor AND NOT checked AND NOT late
  UNION ALL SELECT *, 'lifecycle' FROM a WHERE writes AND NOT is_constructor AND (regexp_matches(fn, '(?i)init|setup|configure|setowner|changeowner') OR (regexp_matches(names, '(?i)owner|admin|wallet|authority|master') AND NOT checked)) AND NOT restricted AND NOT (regexp_matches(modifiers, '(?i)init') OR mutex_guard)
  UNION ALL SELECT *, 'fallback_call' FROM a WHERE is_fallback AND calls
  UNION ALL SELECT *, 'overflow' FROM a WHERE major = 0 AND minor < 8 AND regexp_matches(body, '[+*-]\s*=|\w\s*[+*-]\s*\w') AND (writes OR regexp_matches(body, '\w\[.*\]\s*[+*-]=')))
SELECT source_id, contract, fn, start_line AS line, kind FROM k""",
    "io4_archive_receipts": _R + f"SELECT response_id, class, class <> 'EMPTY_RESPONSE' AS present, class = 'JSON_OBJECT' AS strict_contract_valid, 'utf-8' AS encoding, 'lf' AS newline, strlen({_LF}) AS byte_length, sha256({_LF}) AS sha256 FROM responses JOIN known USING (t)",
    "mr1_classify": _R + "SELECT response_id, class, class <> 'EMPTY_RESPONSE' AS present, TRUE AS utf8_valid, class IN ('JSON_OBJECT', 'NON_OBJECT_JSON') AS json_syntax_valid, class = 'JSON_OBJECT' AS strict_contract_valid FROM responses JOIN known USING (t)",
    "mr2_canonical_hash": _R + "SELECT response_id, sha256(replace(canonical, '@', CAST(source_id AS VARCHAR))) AS canonical_sha256 FROM responses JOIN known USING (t)",
    "mr3_unwrap_fenced": _R + "SELECT response_id, class AS raw_class, reason = 'SINGLE_JSON_FENCE_UNWRAPPED' AS applied, reason = 'SINGLE_JSON_FENCE_UNWRAPPED' AS accepted, reason FROM responses JOIN known USING (t)",
    "mr4_findings": _spread("mode place label fn primary_line n_evidence path constraint_violation_confidence known_label", [
        (2, "compact", 0, "reentrancy", "f", 3, 2, "r", None, True), (3, "compact", 0, "reentrancy", "f", 0, 2, "r", None, True), (3, "compact", 1, "gas", "f", 4, 2, "r", None, False),
        (10, "compact", 0, "arithmetic", "f", 7, 2, "r", None, True), (14, "four_field", 0, "reentrancy", "f", None, 0, "p", 1.5, True),
    ]),
    "mr4_risks": _spread("mode place risk_type function_name triggering_data_flow terminal_action_check", [(14, "four_field", 0, "reentrancy", "f", "d", "t")]),
    "mr4_constraints": _spread("finding place id expression must_be related_line", [(14, 0, 0, "c1", "e", "true", "7")]),
    "mr5_validate": _spread("mode problems valid", [
        (2, "compact", "", True), (3, "compact", "unknown_label,line_out_of_range", False), (4, "candidate_ids", "", True), (10, "compact", "extra_key", False),
        (13, "compact", "extra_key", False), (14, "four_field", "share_out_of_range", False),
    ]),
    "mr6_selected": f"WITH {RESPONSES_SQL} SELECT response_id, source_id, concat(CAST(source_id AS VARCHAR), s) AS candidate_id FROM responses, (VALUES ('-1'), ('-9')) v(s) WHERE t = 4",
    "mr6_unknown": f"WITH {RESPONSES_SQL} SELECT response_id, source_id, concat(CAST(source_id AS VARCHAR), s) AS candidate_id FROM responses, (VALUES ('-1'), ('-9')) v(s) WHERE t = 4 AND (s = '-9' OR source_id NOT IN (SELECT p_partkey FROM part))",
    "mr7_report": _R + "SELECT mode, class AS raw_class, reason, count(*) AS n, count(*) FILTER (WHERE reason = 'SINGLE_JSON_FENCE_UNWRAPPED') AS n_accepted, count(*) FILTER (WHERE class = 'JSON_OBJECT') AS n_raw_valid FROM responses JOIN known USING (t) GROUP BY ALL",
    "ca6_candidate_ids": f"""SELECT source_id, fn, line, concat('SRC-', substr(sha256(concat('{{"entrypoint":"', entrypoint, '","evidence_lines":[', evidence_lines, '],"function_name":"', fn, '","line":', line, ',"risk_type":"', risk_type, '","sink":"', sink, '","source_evidence_kind":"', evidence_kind, '","source_id":"', source_id, '"}}')), 1, 20)) AS candidate_id FROM ({expected_sql('re1_rule')})""",
}


def oracle_sql() -> dict[str, str]:
    return ORACLE
