"""Queries: whole audits."""

from __future__ import annotations

from auditloom import rules as R
from auditloom.plans import audits
from auditloom.plans.bindings import bind, ctes, text
from auditloom.plans.q_budget import _EST
from auditloom.plans.q_screen import _PARTS, gate_sql, line_rules_sql, lines_sql
from auditloom.plans.registry import query

_RULES = R.exploit_line_rules(R.LOCAL) + R.SECRET_RULES
_CLEAN = _PARTS | {"cl": _PARTS["cl"].replace("FROM code_files)", "FROM code_files WHERE path NOT IN (SELECT path FROM l1))")}
_LAYERS = {"g": gate_sql(R.LOCAL, "code_files"), "gl": lines_sql("g", "path, should_audit"),
           "l1": line_rules_sql("gl", _RULES, extra_where="should_audit")} | _CLEAN | {
    "u": "SELECT path, rule_id, line_number, 'Layer 1' AS source_layer, 0 AS rank, lpad(CAST(line_number AS varchar), 8, '0') || rule_name AS seq FROM l1 "
         "UNION ALL SELECT path, rule_id, line_number, 'Layer 2', 1, lpad(CAST(line_number AS varchar), 8, '0') || variable FROM found",
    "t": "SELECT path, count(*) AS n, arg_min(rule_id || ' on line ' || CAST(line_number AS varchar), (rank, seq)) AS top, "
         "string_agg(DISTINCT source_layer, ' + ' ORDER BY source_layer) AS found_in FROM u GROUP BY path",
    "ran": "SELECT path, 'Layer1' AS layer FROM code_files UNION SELECT path, 'Layer2' FROM sources"}


@query("audit_layered_verdicts", ctes("code_files", extra=_LAYERS).replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT c.path, CASE WHEN n > 0 THEN 'REJECT' ELSE 'ACCEPT' END AS verdict, CAST(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END AS double) AS drift_score,
coalesce(n, 0) AS n_violations, '[' || r.layers || '] ' || CASE WHEN n > 0 THEN CAST(n AS varchar) || ' violation(s) found. Most severe: '
|| top || '.' ELSE 'All layers cleared. No violations found.' END AS reasoning FROM code_files c LEFT JOIN t ON t.path = c.path
JOIN (SELECT path, string_agg(DISTINCT layer, ' + ' ORDER BY layer) AS layers FROM ran GROUP BY path) r ON r.path = c.path""")
def layered(spark, sf):
    return audits.audit(bind(spark, sf, "code_files"), profile=R.LOCAL)


# The model's layer: answers on files that the first layers pass, vulnerable items on lines the file has, once a line.
_ANSWERED = {k: v for k, v in _LAYERS.items() if k not in ("t", "ran")} | {
    "asked": "SELECT * FROM answers WHERE path NOT IN (SELECT path FROM u)",
    "items": "SELECT path, response_id, unnest(CAST(json_extract(raw, '$.findings') AS JSON[])) AS i, "
             "unnest(range(CAST(json_array_length(raw, '$.findings') AS bigint))) AS pos FROM asked",
    "told": "SELECT path, pos, coalesce(i->>'vulnerability_type', 'Unknown Vulnerability') AS rule_id, "
            "CAST(i->>'line_number' AS integer) AS line_number FROM items WHERE (i->>'is_vulnerable') = 'true'",
    "model": "SELECT t.* FROM told t JOIN code_files c ON c.path = t.path WHERE line_number BETWEEN 1 AND "
             "len(string_split(code, chr(10))) - CASE WHEN code = '' OR ends_with(code, chr(10)) THEN 1 ELSE 0 END "
             "QUALIFY row_number() OVER (PARTITION BY t.path, line_number ORDER BY pos) = 1",
    "every": "SELECT path, rule_id, line_number, rank, seq FROM u UNION ALL "
             "SELECT path, rule_id, line_number, 2, lpad(CAST(pos AS varchar), 8, '0') FROM model",
    "t": "SELECT path, count(*) AS n, arg_min(rule_id || ' on line ' || CAST(line_number AS varchar), (rank, seq)) AS top "
         "FROM every GROUP BY path",
    "ran": "SELECT path, 'Layer1' AS layer FROM code_files UNION SELECT path, 'Layer2' FROM sources "
           "UNION SELECT path, 'V1.0' FROM asked"}


@query("audit_answered_verdicts", ctes("code_files", "answers", extra=_ANSWERED).replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT c.path, CASE WHEN n > 0 THEN 'REJECT' ELSE 'ACCEPT' END AS verdict, coalesce(n, 0) AS n_violations,
'[' || r.layers || '] ' || CASE WHEN n > 0 THEN CAST(n AS varchar) || ' violation(s) found. Most severe: '
|| top || '.' ELSE 'All layers cleared. No violations found.' END AS reasoning FROM code_files c LEFT JOIN t ON t.path = c.path
JOIN (SELECT path, string_agg(DISTINCT layer, ' + ' ORDER BY layer) AS layers FROM ran GROUP BY path) r ON r.path = c.path""")
def answered(spark, sf):
    """All three layers; the model's answers stand in a table."""
    return audits.audit(bind(spark, sf, "code_files"), bind(spark, sf, "answers"), R.LOCAL).select(
        "path", "verdict", "n_violations", "reasoning")


_SYSTEM = "You are a code auditor. Answer in JSON."


@query("audit_folder_requests", ctes("doc_files", extra={
    "g": gate_sql(R.BATCH, "doc_files"),
    "q": "SELECT path, code FROM g WHERE should_audit",
    "r": f"SELECT path, code, {_EST['by_numbered']} AS tokens FROM q"}) + f"""
SELECT path, tokens, {text(_SYSTEM)} AS system,
CASE WHEN tokens > 6000 THEN 'File too large (' || format('{{:,}}', tokens) || ' tokens)' END AS skip_reason FROM r""")
def folder(spark, sf):
    return audits.scan_folder(bind(spark, sf, "doc_files"), _SYSTEM, R.BATCH).requests.select(
        "path", "tokens", "system", "skip_reason")


@query("audit_guarded_documents", ctes("live", "snapshot") + """
SELECT coalesce(s.project, l.project) AS project, coalesce(s.name, l.name) AS name,
md5(CASE WHEN l.name IS NULL OR (l.name = 'system_rules.md' AND s.name IS NOT NULL) THEN s.content ELSE l.content END) AS hash
FROM live l FULL JOIN snapshot s ON s.project = l.project AND s.name = l.name
WHERE NOT (s.name IS NULL AND l.name = 'system_rules.md')""")
def guarded(spark, sf):
    """Every change of a rules file is rejected, the others are accepted."""
    live = bind(spark, sf, "live")
    reviews = live.where("name = 'system_rules.md'").selectExpr("project", "name", "'REJECT' AS action", "1.0 AS drift_score")
    return audits.guard_documents(live, bind(spark, sf, "snapshot"), reviews).selectExpr(
        "project", "name", "md5(content) AS hash")
