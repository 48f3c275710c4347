"""Queries: responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom import rules as R
from auditloom.operators import responses as P
from auditloom.plans.bindings import bind, case, ctes, text
from auditloom.plans.q_screen import lines_sql
from auditloom.plans.registry import query


def block_sql(column: str) -> str:
    end = f"(length({column}) - instr(reverse({column}), '}}') + 1)"
    return (f"CASE WHEN contains({column}, '{{') AND contains({column}, '}}') AND {end} > instr({column}, '{{') "
            f"THEN substring({column}, instr({column}, '{{'), {end} - instr({column}, '{{') + 1) END")


STRIPPED = r"trim(regexp_replace(raw, '^\s*```(?:json)?\s*|\s*```\s*$', '', 'g'))"


def parsed_sql(source: str, raw: str = "raw") -> str:
    """Rows of a binding with ``v``: the JSON object, or NULL."""
    return (f"SELECT * EXCLUDE (b), CASE WHEN json_valid(b) AND json_type(b) = 'OBJECT' AND b NOT SIMILAR TO "
            f"'\\{{\\s*\\}}' THEN CAST(b AS json) END AS v FROM (SELECT *, {block_sql(raw)} AS b FROM {source})")


@query("rs1_json_block", ctes("reviews") + f"SELECT response_id, {block_sql('raw')} AS block FROM reviews")
def rs1(spark, sf):
    return bind(spark, sf, "reviews").select("response_id", P.json_block(F.col("raw")).alias("block"))


@query("rs2_lenient_parse", ctes("reviews", extra={
    "s": f"SELECT response_id, path, {STRIPPED} AS raw FROM reviews", "p": parsed_sql("s")}) + """
SELECT response_id, path, v IS NULL AS parse_error, coalesce(v->>'action', 'ACCEPT') AS action,
coalesce(TRY_CAST(v->>'drift_score' AS double), 0) AS drift_score, coalesce(v->>'severity', 'NONE') AS severity,
coalesce(v->>'exploitability', 'none') AS exploitability, coalesce(TRY_CAST(v->>'confidence' AS double), 0) AS confidence,
coalesce(v->>'pattern_detected', CASE WHEN v IS NULL THEN 'parse_error' END) AS pattern_detected,
coalesce(v->>'reasoning', CASE WHEN v IS NULL THEN 'Failed to parse response' END) AS reasoning FROM p""")
def rs2(spark, sf):
    return P.lenient(bind(spark, sf, "reviews"))


@query("rs2_quarantine", ctes("reviews", extra={
    "s": f"SELECT response_id, path, {STRIPPED} AS raw FROM reviews", "p": parsed_sql("s")})
    + "SELECT response_id, path, raw FROM p WHERE v IS NULL")
def rs2_quarantine(spark, sf):
    return P.quarantine(bind(spark, sf, "reviews"))


_ITEMS = {
    "j0": "SELECT response_id, path, CASE WHEN json_valid(trim(raw)) THEN CAST(trim(raw) AS json) END AS j FROM reviews",
    "j1": "SELECT *, json_type(j) AS jt, json_extract(j, '$.findings') AS f, json_type(j, '$.findings') AS ft FROM j0",
    "j2": """SELECT *, CASE WHEN ft = 'VARCHAR' AND json_valid(f->>'$') THEN CAST(f->>'$' AS json) END AS s FROM j1""",
    "items": """SELECT response_id, path, CASE WHEN j IS NULL THEN 'unreadable' WHEN jt = 'ARRAY' THEN 'root_array'
WHEN ft = 'ARRAY' AND json_array_length(f) > 0 THEN 'findings'
WHEN json_type(s) = 'ARRAY' AND json_array_length(s) > 0 THEN 'findings_text'
WHEN json_exists(j, '$.is_vulnerable') THEN 'single' ELSE 'empty' END AS shape,
CASE WHEN jt = 'ARRAY' THEN json_extract(j, '$[*]') WHEN ft = 'ARRAY' AND json_array_length(f) > 0
THEN json_extract(f, '$[*]') WHEN json_type(s) = 'ARRAY' AND json_array_length(s) > 0 THEN json_extract(s, '$[*]')
WHEN json_exists(j, '$.is_vulnerable') THEN [j] ELSE [] END AS items FROM j2""",
    "each": "SELECT response_id, path, unnest(items) AS i, unnest(range(0, len(items))) AS seq FROM items",
    "sure": """SELECT response_id, path, CAST(seq AS integer) AS seq, upper(coalesce(i->>'severity', 'UNKNOWN')) AS severity,
coalesce(i->>'vulnerability_type', 'Unknown Vulnerability') AS vulnerability_type,
TRY_CAST(i->>'line_number' AS integer) AS line_number,
coalesce(i->>'description', 'No description provided.') AS description FROM each
WHERE json_type(i) = 'OBJECT' AND json_type(i, '$.is_vulnerable') = 'BOOLEAN' AND (i->>'is_vulnerable') = 'true'""",
}


@query("rs3_findings_shapes", ctes("reviews", extra=_ITEMS) + """
SELECT i.response_id, i.path, i.shape, CAST(coalesce(n, 0) AS integer) AS n_findings,
CASE WHEN coalesce(n, 0) > 0 THEN 'REJECT' ELSE 'ACCEPT' END AS action
FROM items i LEFT JOIN (SELECT response_id, count(*) AS n FROM sure GROUP BY 1) s ON s.response_id = i.response_id""")
def rs3(spark, sf):
    return P.actions(P.finding_items(bind(spark, sf, "reviews")))


@query("rs4_confirmed_findings", ctes("reviews", extra=_ITEMS) + "SELECT * FROM sure")
def rs4(spark, sf):
    return P.confirmed_findings(P.finding_items(bind(spark, sf, "reviews")))


def holds_sql(value: str) -> str:
    """Whether a JSON value counts as true."""
    return (f"CASE json_type({value}) WHEN 'BOOLEAN' THEN ({value}->>'$') = 'true' WHEN 'VARCHAR' THEN ({value}->>'$') <> '' "
            f"WHEN 'OBJECT' THEN len(json_keys({value})) > 0 WHEN 'ARRAY' THEN json_array_length({value}) > 0 "
            f"WHEN 'NULL' THEN false ELSE TRY_CAST({value}->>'$' AS double) <> 0 END")


_WITH = {"p": parsed_sql("reviews"),
         "w": f"""SELECT response_id, path, CASE WHEN json_type(v, '$.findings') = 'ARRAY' THEN json_extract(v, '$.findings[*]') ELSE [] END AS fs,
coalesce({holds_sql("json_extract(v, '$.findings')")}, false) AS claimed FROM p WHERE json_exists(v, '$.findings')""",
         "e": "SELECT response_id, path, len(fs) AS n, unnest(fs) AS i, unnest(range(0, len(fs))) AS seq FROM w"}


@query("rs5_violations", ctes("reviews", extra=_WITH) + f"""
SELECT response_id, path, CAST(seq AS integer) AS seq, coalesce(i->>'rule_id', {text(P.DEFAULT_RULE_ID)}) AS rule_id,
coalesce(i->>'vulnerability_type', {text(P.DEFAULT_RULE_NAME)}) AS rule_name,
CASE WHEN json_exists(i, '$.line_number') THEN TRY_CAST(i->>'line_number' AS integer) ELSE 0 END AS line_number,
coalesce(i->>'description', {text(P.DEFAULT_VIOLATION)}) AS violation, coalesce(i->>'severity', 'MEDIUM') AS severity,
'HIGH' AS confidence FROM e WHERE json_type(i) = 'OBJECT'""")
def rs5(spark, sf):
    return P.violations(bind(spark, sf, "reviews"))


_WEIGHT = case("coalesce(i->>'severity', 'MEDIUM')", {k: str(v) for k, v in R.SEVERITY_WEIGHT.items()},
               str(R.SEVERITY_WEIGHT_OTHER))


@query("rs6_rs7_score_and_reasoning", ctes("reviews", extra=_WITH) + f"""
SELECT w.response_id, w.path, CASE WHEN claimed THEN 'REJECT' ELSE 'ACCEPT' END AS verdict,
CASE WHEN len(fs) > 0 THEN least(coalesce(g.total, 0) / len(fs), 1) ELSE 0 END AS score,
CASE WHEN NOT claimed THEN 'No security violations detected.' ELSE coalesce(g.said, 'Security violations detected.') END AS reasoning
FROM w LEFT JOIN (SELECT response_id, CAST(sum({_WEIGHT}) AS double) AS total,
string_agg('[' || coalesce(i->>'rule_id', {text(P.DEFAULT_RULE_ID)}) || '] ' || CASE WHEN coalesce(TRY_CAST(i->>'line_number' AS integer), 0) <> 0
THEN 'Line ' || (i->>'line_number') || ': ' ELSE '' END || coalesce(i->>'description', {text(P.DEFAULT_DESCRIPTION)}), '; ' ORDER BY seq) AS said
FROM e WHERE json_type(i) = 'OBJECT' GROUP BY 1) g ON g.response_id = w.response_id""")
def rs6(spark, sf):
    return P.finding_verdicts(bind(spark, sf, "reviews"))


def _near(column: str) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(w)})" for w in R.PROXIMITY_WORDS) + ")"


_LADDER = {
    "p": parsed_sql("flow_reviews"),
    "q": f"""SELECT p.response_id, p.path, p.raw, p.v, d.code, upper(coalesce(v->>'verdict', 'ACCEPT')) AS verdict,
coalesce(v->>'rejection_reason', '') AS why, coalesce({holds_sql("json_extract(v, '$.chain_complete')")}, false) AS chain,
len(list_filter(coalesce(json_extract(v, '$.sinks_scanned[*]'), []), lambda s: (s->>'verdict') = 'VIOLATION')) > 0 AS confirmed,
CASE json_type(v, '$.data_flow_logic.step_1_source') WHEN 'ARRAY' THEN json_extract(v, '$.data_flow_logic.step_1_source[0]')
WHEN 'OBJECT' THEN json_extract(v, '$.data_flow_logic.step_1_source') END AS step, {block_sql('p.raw')} AS block
FROM p LEFT JOIN doc_files d ON d.path = p.path WHERE NOT coalesce(json_exists(v, '$.findings'), false)""",
    "r": """SELECT *, TRY_CAST(step->>'line' AS integer) AS line, step->>'line' AS told, coalesce(json_type(step, '$.line'), 'NULL') = 'NULL' AS lineless,
CASE WHEN why <> '' THEN why ELSE trim(string_split(raw, '{')[1]) END AS own, trim(coalesce(step->>'expression', '')) AS expr FROM q""",
    "o0": f"""SELECT *, CASE WHEN v IS NULL THEN 'malformed_json_schema'
WHEN coalesce(json_type(v, '$.data_flow_logic'), 'NULL') = 'NULL' OR NOT json_exists(v, '$.chain_complete')
  OR NOT json_exists(v, '$.verdict') OR NOT json_exists(v, '$.confidence') THEN 'malformed_cot_schema'
WHEN verdict = 'REJECT' AND NOT chain AND NOT confirmed AND NOT (contains(lower(why), 'line') OR contains(why, 'L')) THEN 'incomplete_chain'
WHEN verdict = 'REJECT' AND lineless THEN 'missing_source_line'
WHEN verdict = 'REJECT' AND (starts_with(expr, '"') OR starts_with(expr, '''') OR contains(expr, '= "') OR contains(expr, '= ''')
  OR coalesce(regexp_matches(list_extract(string_split(code, chr(10)), line), {text(P.LITERAL_LINE)}), false)) THEN 'literal_string_source'
WHEN verdict = 'REJECT' AND {_near("lower(own || ' ' || coalesce(block, ''))")} THEN 'proximity_argument_detected' END AS what FROM r""",
    "o": "SELECT *, CASE WHEN what = 'missing_source_line' THEN 'incomplete_chain' ELSE what END AS override_reason FROM o0",
    "final": f"""SELECT response_id, path, CASE WHEN override_reason IS NOT NULL THEN 'ACCEPT' ELSE verdict END AS verdict,
CAST(CASE WHEN override_reason IS NULL AND verdict = 'REJECT' THEN 1.0 ELSE 0.0 END AS double) AS score, override_reason,
CASE WHEN override_reason IS NOT NULL THEN replace({case('what', {k: text(v) for k, v in P.FORCED_TEXT.items()}, "''")},
'{{}}', coalesce(told, '')) ELSE own END AS reasoning FROM o""",
}


@query("rs8_rs10_override_ladder", ctes("flow_reviews", "doc_files", extra=_LADDER) + "SELECT * FROM final")
def rs8(spark, sf):
    return P.override(bind(spark, sf, "flow_reviews"), bind(spark, sf, "doc_files"))


@query("rs9_override_frequency", ctes("flow_reviews", "doc_files", extra=_LADDER) + """
SELECT override_reason, DATE '2024-01-01' + CAST(f.response_id % 7 AS integer) AS day, count(*) AS n_overrides FROM final f
WHERE override_reason IS NOT NULL GROUP BY 1, 2""")
def rs9(spark, sf):
    done = P.override(bind(spark, sf, "flow_reviews"), bind(spark, sf, "doc_files"))
    at = F.expr("TIMESTAMP '2024-01-01 00:00:00' + (response_id % 7) * INTERVAL '1' DAY")
    return P.override_frequency(P.override_log(done, at))


@query("rs11_line_validity", ctes("reviews", "doc_files", extra=_ITEMS) + """
SELECT s.response_id, s.seq, s.line_number, CAST(len(string_split(d.code, chr(10))) - CASE WHEN d.code = '' OR d.code LIKE '%' || chr(10)
THEN 1 ELSE 0 END AS integer) AS n_lines, coalesce(s.line_number BETWEEN 1 AND len(string_split(d.code, chr(10)))
 - CASE WHEN d.code = '' OR d.code LIKE '%' || chr(10) THEN 1 ELSE 0 END, false) AS valid_line
FROM sure s LEFT JOIN doc_files d ON d.path = s.path""")
def rs11(spark, sf):
    found = P.confirmed_findings(P.finding_items(bind(spark, sf, "reviews")))
    return P.check_lines(found, bind(spark, sf, "doc_files")).select(
        "response_id", "seq", "line_number", "n_lines", "valid_line")


_SNIP = ("CASE ext WHEN '.py' THEN '4 | ' || {0} WHEN '.go' THEN 'no such text' WHEN '.json' THEN '' ELSE {0} END").format


@query("rs12_line_repair", ctes("code_files", extra={
    "f": f"SELECT path, code, 2 AS line_number, {_SNIP('list_extract(string_split(code, chr(10)), 4)')} AS snippet FROM code_files",
    "c": r"SELECT *, trim(regexp_replace(snippet, '^[0-9]+\s*\|\s*', '')) AS s FROM f"}) + """
SELECT path, line_number, snippet, CASE WHEN s = '' OR contains(trim(list_extract(string_split(code, chr(10)), line_number)), s)
THEN line_number WHEN instr(code, s) > 0 THEN CAST(len(string_split(left(code, instr(code, s) - 1), chr(10))) AS integer) ELSE line_number END AS fixed_line FROM c""")
def rs12(spark, sf):
    files = bind(spark, sf, "code_files")
    found = files.selectExpr("path", "2 AS line_number", f"{_SNIP('get(split(code, chr(10)), 3)')} AS snippet")
    return P.repair_lines(found, files)


_TYPES = dict(zip(P.FIELDS, ("varchar", "boolean", "boolean", "varchar", "varchar", "varchar", "double", "varchar")))
_CHECK = {
    "p": parsed_sql("eight_reviews"),
    "f": "SELECT response_id, path, v, " + ", ".join(
        f"{holds_sql(f'json_extract(v, {text(chr(36) + chr(46) + k)})')} AS {k}" if t == "boolean" else
        f"CASE WHEN json_type(v, '$.{k}') NOT IN ('VARCHAR', 'BOOLEAN') THEN TRY_CAST(v->>'{k}' AS double) END AS {k}"
        if t == "double" else f"TRY_CAST(v->>'{k}' AS {t}) AS {k}" for k, t in _TYPES.items())
         + " FROM p WHERE v IS NOT NULL",
    "g": f"""SELECT *, list_filter([{', '.join(f"CASE WHEN NOT json_exists(v, '$.{k}') THEN 'Missing required field: {k}' END" for k in P.FIELDS)}],
lambda x: x IS NOT NULL) AS absent, NOT coalesce(user_controlled_input, false) AND severity = 'CRITICAL' AS e1,
NOT coalesce(uses_shell, false) AND argument_type = 'list' AND severity IN ('CRITICAL', 'HIGH', 'MEDIUM') AS e2,
exploitability = 'none' AND severity <> 'NONE' AS e3,
({' OR '.join(f"contains(lower(coalesce(pattern_detected, '')), {text(w)})" for w in P.SAFE_PATTERN_WORDS)}) AND severity <> 'NONE' AS e4,
NOT coalesce(confidence BETWEEN 0 AND 1, false) AS e5 FROM f""",
    "h": """SELECT *, len(absent) = 0 AS complete, CASE WHEN len(absent) > 0 THEN absent ELSE list_filter([
CASE WHEN e1 THEN 'Logical error: No user input but CRITICAL severity' END,
CASE WHEN e2 THEN 'Logical error: Safe subprocess usage but high severity' END,
CASE WHEN e3 THEN 'Logical error: No exploitability but non-zero severity' END,
CASE WHEN e4 THEN 'Logical error: No pattern detected but non-zero severity' END,
CASE WHEN e5 THEN 'Invalid confidence value (must be 0.0-1.0)' END], lambda x: x IS NOT NULL) END AS errors FROM g""",
    "k": """SELECT *, CASE WHEN NOT complete THEN severity WHEN e4 OR e3 THEN 'NONE' WHEN e2 THEN 'LOW' WHEN e1 THEN 'HIGH'
ELSE severity END AS corrected_severity, CASE WHEN complete AND e5 THEN 0.5 ELSE confidence END AS corrected_confidence FROM h""",
}


@query("rs13_consistency", ctes("eight_reviews", extra=_CHECK) + """SELECT response_id, path, severity, confidence,
array_to_string(errors, '; ') AS errors, corrected_severity, corrected_confidence FROM k""")
def rs13(spark, sf):
    return P.checked(bind(spark, sf, "eight_reviews")).select(
        "response_id", "path", "severity", "confidence", F.array_join("errors", "; ").alias("errors"),
        "corrected_severity", "corrected_confidence")


@query("rs14_to_verdict", ctes("eight_reviews", extra=_CHECK) + f"""
SELECT response_id, path, CASE WHEN coalesce(severity, 'NONE') IN ('CRITICAL', 'HIGH', 'MEDIUM') THEN 'REJECT' ELSE 'ACCEPT' END AS action,
CAST({case("coalesce(severity, 'NONE')", {k: str(v) for k, v in R.SEVERITY_SCORE.items()}, '0.0')} AS double) AS drift_score,
CASE WHEN severity IN ('CRITICAL', 'HIGH', 'MEDIUM') THEN 1 ELSE 0 END AS n_violations,
CASE WHEN severity IN ('CRITICAL', 'HIGH', 'MEDIUM') THEN 'V2_ANALYSIS' END AS rule_id,
CASE WHEN severity IN ('CRITICAL', 'HIGH', 'MEDIUM') THEN 1 END AS line_number,
CASE WHEN severity IN ('CRITICAL', 'HIGH', 'MEDIUM') THEN coalesce(pattern_detected, 'Security violation detected') END AS violation,
CASE WHEN severity IN ('CRITICAL', 'HIGH', 'MEDIUM') THEN CASE WHEN coalesce(confidence, 0) > 0.7 THEN 'HIGH' ELSE 'LOW' END END AS confidence,
coalesce(reasoning, 'V2 analysis completed') AS reasoning FROM k""")
def rs14(spark, sf):
    return P.to_verdict(P.checked(bind(spark, sf, "eight_reviews")))


@query("rs15_retries", ctes("eight_reviews", extra=_CHECK) + f"""
SELECT response_id, path, CAST(len(errors) AS integer) AS n_errors, {text(P.STRICT_REMINDER)} || chr(10) || chr(10) || array_to_string(errors, chr(10)) AS prompt
FROM k WHERE len(errors) > 0""")
def rs15(spark, sf):
    return P.retries(P.checked(bind(spark, sf, "eight_reviews")))


@query("rs16_broken_rules", ctes("rule_reviews", extra={
    "p": parsed_sql("rule_reviews"),
    "w": "SELECT response_id, path, json_extract(v, '$.broken_rules[*]') AS l FROM p",
    "e": "SELECT response_id, path, unnest(l) AS i, CAST(unnest(range(0, len(l))) AS integer) AS seq FROM w"}) + """
SELECT response_id, path, seq, 'HIGH' AS severity, 'Architectural Drift' AS vulnerability_type,
CASE WHEN json_type(i) = 'VARCHAR' THEN coalesce(nullif(regexp_extract(i->>'$', '(?i)(Rule \\d+)', 1), ''), 'DRIFT-00' || CAST(seq + 1 AS varchar))
ELSE coalesce(nullif(i->>'rule_id', ''), 'DRIFT-00' || CAST(seq + 1 AS varchar)) END AS rule_id,
CASE WHEN json_type(i) <> 'VARCHAR' THEN nullif(TRY_CAST(i->>'line_number' AS integer), 0) END AS line_number,
CASE WHEN json_type(i) = 'VARCHAR' THEN i->>'$' ELSE coalesce(nullif(i->>'description', ''), 'Architectural rule violation detected') END AS description
FROM e""")
def rs16(spark, sf):
    return P.broken_rules(bind(spark, sf, "rule_reviews"))


def _each(pattern: str) -> str:
    def g(k: int) -> str:
        return f"unnest(regexp_extract_all(reasoning, {text(pattern)}, {k}))"
    return (f"{g(1)} AS a, {g(2)} AS b, {g(3)} AS c, "
            f"CAST(unnest(range(0, len(regexp_extract_all(reasoning, {text(pattern)})))) AS integer) AS seq")


_CITED = {
    "c1": f"SELECT response_id, project, path, TRUE AS cited, {_each(P.CITED)} FROM reasons",
    "c2": f"SELECT response_id, project, path, FALSE AS cited, {_each(P.NAMED)} FROM reasons "
          f"WHERE NOT regexp_matches(reasoning, {text(P.CITED)})",
    "c3": "SELECT * FROM c1 UNION ALL SELECT * FROM c2",
    "c4": """SELECT response_id, project, path, seq, CASE WHEN trim(coalesce(a, '')) <> '' THEN '#' || trim(a) WHEN cited THEN 'SYSTEM_RULES' ELSE '' END AS rule_id,
trim(coalesce(a, '')) AS rule_num, trim(coalesce(b, '')) AS rule_name, trim(coalesce(c, '')) AS violation FROM c3""",
    "cited": "SELECT * FROM c4 WHERE rule_id <> '' OR violation <> ''",
}


@query("rs17_citations", ctes("reasons", extra=_CITED) + "SELECT * FROM cited")
def rs17(spark, sf):
    return P.citations(bind(spark, sf, "reasons"))


@query("rs18_rule_location", ctes("reasons", "rule_docs", extra=_CITED | {"rl": lines_sql("rule_docs", "project", "rules")}) + """
SELECT c.response_id, c.seq, c.project, c.rule_id, (SELECT min(l.line_no) FROM rl l WHERE l.project = c.project AND c.rule_num <> ''
AND (contains(l.line, 'Rule ' || c.rule_num) OR contains(l.line, 'Rule #' || c.rule_num))) AS location_line FROM cited c""")
def rs18(spark, sf):
    cited = P.citations(bind(spark, sf, "reasons"))
    return P.locate_rules(cited, bind(spark, sf, "rule_docs")).select(
        "response_id", "seq", "project", "rule_id", "location_line")


@query("rs19_code_location", ctes("reasons", "code_files", extra=_CITED | {
    "m": r"""SELECT c.response_id, c.seq, c.violation, f.code, regexp_extract(violation, '^(\d+)\s*\|\s*', 1) AS said,
regexp_replace(violation, '^\d+\s*\|\s*', '') AS piece FROM cited c LEFT JOIN code_files f ON f.path = c.path"""}) + """
SELECT response_id, seq, violation, CASE WHEN said <> '' THEN CAST(said AS integer) WHEN piece <> '' AND spot > 0
THEN CAST(len(string_split(left(code, spot - 1), chr(10))) AS integer) ELSE 0 END AS line_number
FROM (SELECT *, coalesce(nullif(instr(code, piece), 0), instr(code, left(piece, 30))) AS spot FROM m)""")
def rs19(spark, sf):
    cited = P.citations(bind(spark, sf, "reasons"))
    return P.locate_code(cited, bind(spark, sf, "code_files")).select(
        "response_id", "seq", "violation", "line_number")


@query("rs20_unique_citations", ctes("reasons", extra=_CITED | {
    "u": "SELECT *, row_number() OVER (PARTITION BY response_id, rule_id, violation ORDER BY seq) AS k FROM cited",
    "t": "SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY seq) AS rank FROM u WHERE k = 1"}) + """
SELECT response_id, CAST(rank AS integer) AS rank, rank <= 5 AS within_limit, rule_id, rule_name, violation, seq FROM t""")
def rs20(spark, sf):
    return P.unique_citations(P.citations(bind(spark, sf, "reasons"))).select(
        "response_id", "rank", "within_limit", "rule_id", "rule_name", "violation", "seq")


def _section(start: str, stop: str | None) -> str:
    body = f"string_split(analysis, '[{start}]')[2]"
    return f"trim({body}, chr(10) || ' ')" if stop is None else f"trim(string_split({body}, '[{stop}]')[1], chr(10) || ' ')"


def _bullets(body: str, needs: str) -> str:
    return (f"CASE WHEN {needs} AND {body} <> '' AND NOT contains(upper({body}), 'NONE') THEN CAST(len(list_filter(string_split({body}, chr(10)), "
            f"lambda x: ltrim(x) LIKE '-%')) AS integer) ELSE 0 END")


@query("rs21_tagged_sections", ctes("analyses") + f"""SELECT response_id,
{_bullets(_section('RESOLVED_PATTERNS', 'NEGATIVE_RULES'), "contains(analysis, '[RESOLVED_PATTERNS]') AND contains(analysis, '[NEGATIVE_RULES]')")} AS patterns_added,
{_bullets(_section('NEGATIVE_RULES', 'LESSONS_LEARNED'), "contains(analysis, '[NEGATIVE_RULES]')")} AS rules_added,
{_bullets(_section('LESSONS_LEARNED', None), "contains(analysis, '[LESSONS_LEARNED]')")} AS lessons_added FROM analyses""")
def rs21(spark, sf):
    return P.tagged_sections(bind(spark, sf, "analyses"))


@query("rs22_append_commands", ctes("analyses", extra={
    "a": r"SELECT response_id, regexp_extract(analysis, '(?s)\[(?:AI_ASSISTANT_ACTIONS|ACTIONS)\](.*?)(?:\[|$)', 1) AS sec FROM analyses",
    "b": "SELECT response_id, string_split(sec, 'APPEND_TO_FILE: ')[2:] AS bs FROM a",
    "c": "SELECT response_id, unnest(bs) AS b, CAST(unnest(range(1, len(bs) + 1)) AS integer) AS seq FROM b"}) + r"""
SELECT response_id, seq, trim(string_split(b, chr(10))[1]) AS file,
trim(regexp_replace(b, '^[^\n]+\nCONTENT:[ \t]*\|?[ \t]*\n', ''), chr(10) || ' ') AS content FROM c""")
def rs22(spark, sf):
    return P.append_commands(bind(spark, sf, "analyses"))


def _tag(name: str) -> str:
    return "(" + " OR ".join(f"contains(lower(reasoning), {text(w)})" for w in P.TAG_WORDS[name]) + ")"


@query("rs23_event_tags", ctes("reasons") + f"""
SELECT response_id, 'rule_violation' AS tag, 'problems_and_resolutions.md' AS file FROM reasons WHERE verdict = 'REJECT' AND score >= 0.4 AND {_tag('rule_violation')}
UNION ALL SELECT response_id, 'error', 'problems_and_resolutions.md' FROM reasons WHERE {_tag('error')}
UNION ALL SELECT response_id, 'pattern_followed', 'history_phases.md' FROM reasons WHERE verdict = 'ACCEPT' AND score <= 0.15 AND {_tag('pattern_followed')}""")
def rs23(spark, sf):
    return P.event_tags(bind(spark, sf, "reasons"))
