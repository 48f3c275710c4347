"""Queries: merge, evaluation, snapshots, memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom import rules as R
from auditloom.functions.session import materialise
from auditloom.operators import evaluate as E
from auditloom.operators import memory as M
from auditloom.operators import merge as G
from auditloom.operators import screen as S
from auditloom.operators import snapshots as N
from auditloom.plans import bindings as B
from auditloom.plans.bindings import STR, bind, case, ctes, text
from auditloom.plans.q_screen import EXPLOITABILITY_SQL, imports_sql, line_rules_sql, lines_sql
from auditloom.plans.registry import query
from auditloom.sources.tables import table

# --- merge ------------------------------------------------------------------------------------------
# Three layers over the code files: screen rules, call rules, and the remaining declared rules as the
# model's findings.
LAYERS = (("Layer 1", R.exploit_line_rules(R.LOCAL) + R.SECRET_RULES),
          ("Layer 2", R.UNSAFE_CALLS + R.SENSITIVE_OUTPUT),
          ("V1.0", R.DYNAMIC_SQL + R.KEY_LITERAL + R.HYGIENE + R.DANGEROUS_CONTENT))
SEQ = "lpad(CAST(line_number AS string), 8, '0') || rule_name"
_RANK = case("severity", {k: str(v) for k, v in R.SEVERITY_RANK.items()}, str(R.SEVERITY_RANK_OTHER))

_MERGE = {"l": lines_sql("code_files")} | {
    f"f{i}": line_rules_sql("l", rules) for i, (_, rules) in enumerate(LAYERS, 1)} | {
    "u": " UNION ALL ".join(
        f"SELECT path, line_number, rule_id, severity, rule_name AS violation, {SEQ} AS seq, {text(name)} AS source_layer, "
        f"{i} AS layer_order FROM f{i}" for i, (name, _) in enumerate(LAYERS, 1)),
    "m": """SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY path, line_number ORDER BY seq) AS k FROM u
WHERE layer_order = 3) WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM u e WHERE e.layer_order < 3 AND e.path = path
AND e.line_number = line_number)""",
    "kept": "SELECT * FROM u WHERE layer_order < 3 UNION ALL SELECT * FROM (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() "
            "OVER (PARTITION BY path, line_number ORDER BY seq) AS k FROM u WHERE layer_order = 3) WHERE k = 1) w "
            "WHERE NOT EXISTS (SELECT 1 FROM u e WHERE e.layer_order < 3 AND e.path = w.path AND e.line_number = w.line_number)",
}
del _MERGE["m"]


def _layers(spark, sf):
    """Files and the findings of all layers.  Texts are scanned once for the rules of every layer; the
    findings are written, and the merge reads that narrow table."""
    files = bind(spark, sf, "code_files")
    found = materialise(S.line_findings(files, sum((rules for _, rules in LAYERS), ())).selectExpr(
        "path", "line_number", "rule_id", "severity", "rule_name AS violation", f"{SEQ} AS seq"), "findings")
    return files.select("path"), G.union_layers(*[
        (name, found.where(F.col("violation").isin(*[r.name for r in rules]))) for name, rules in LAYERS])


def _kept(spark, sf):
    files, rows = _layers(spark, sf)
    return files, G.drop_repeated_model(rows)


_COLS = ["path", "line_number", "rule_id", "severity", "violation", "source_layer", "layer_order"]


@query("mg1_layer_union", ctes("code_files", extra=_MERGE) + f"SELECT {', '.join(_COLS)} FROM u")
def mg1(spark, sf):
    return _layers(spark, sf)[1].select(*_COLS)


@query("mg2_priority_dedupe", ctes("code_files", extra=_MERGE) + f"SELECT {', '.join(_COLS)} FROM kept")
def mg2(spark, sf):
    return _kept(spark, sf)[1].select(*_COLS)


@query("mg3_severity_order", ctes("code_files", extra=_MERGE) + f"""
SELECT {', '.join(_COLS)}, {_RANK} AS severity_rank FROM kept ORDER BY path, severity_rank, layer_order, seq""")
def mg3(spark, sf):
    return G.by_severity(_kept(spark, sf)[1]).select(*_COLS, "severity_rank")


@query("mg4_file_verdicts", ctes("code_files", extra=_MERGE | {
    "t": f"""SELECT path, count(*) AS n, arg_min(rule_id || ' on line ' || CAST(line_number AS varchar), ({_RANK}, layer_order, seq)) AS top,
string_agg(DISTINCT source_layer, ' + ' ORDER BY source_layer) AS found_in FROM kept GROUP BY path"""}) + """
SELECT c.path, CASE WHEN n > 0 THEN 'REJECT' ELSE 'ACCEPT' END AS verdict, CAST(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END AS double) AS drift_score,
coalesce(n, 0) AS n_violations, '[' || CASE WHEN ends_with(c.path, '.json') THEN 'unknown' WHEN ends_with(c.path, '.go')
THEN 'Layer1' ELSE 'Layer1 + Layer2 + V1.0' END || '] ' || CASE WHEN n > 0 THEN CAST(n AS varchar) || ' violation(s) found. Most severe: '
|| top || '.' ELSE 'All layers cleared. No violations found.' END AS reasoning FROM code_files c LEFT JOIN t ON t.path = c.path""")
def mg4(spark, sf):
    """No layer runs on settings, the first one alone on Go files."""
    files, kept = _kept(spark, sf)
    ran = files.selectExpr("path", "explode(CASE WHEN endswith(path, '.json') THEN array() WHEN endswith(path, '.go') "
                           "THEN array('Layer1') ELSE array('Layer1', 'Layer2', 'V1.0') END) AS layer")
    return G.file_verdicts(files, kept, ran)


@query("mg5_short_circuit", ctes("code_files", extra=_MERGE) + """
SELECT path, 'REJECT' AS action, 'layer1' AS layer FROM code_files WHERE path IN (SELECT path FROM f1)
UNION ALL SELECT path, 'L1_PASS', 'layer2' FROM code_files WHERE path NOT IN (SELECT path FROM f1)""")
def mg5(spark, sf):
    files = bind(spark, sf, "code_files")
    return G.route(files.select("path"), S.line_findings(files, LAYERS[0][1]))


@query("mg5_next_stage", ctes("code_files", extra=_MERGE)
       + "SELECT path FROM code_files WHERE path NOT IN (SELECT path FROM f1)")
def mg5_next(spark, sf):
    files = bind(spark, sf, "code_files")
    return G.next_stage(files.select("path"), S.line_findings(files, LAYERS[0][1]))


@query("mg6_findings_by_file", ctes("code_files", extra=_MERGE) + f"""
SELECT k.path, n_in_file, top_rank, line_number, rule_id, severity, violation FROM kept k JOIN
(SELECT path, count(*) AS n_in_file, min({_RANK}) AS top_rank FROM kept GROUP BY path) t ON t.path = k.path""")
def mg6(spark, sf):
    return G.findings_by_file(_kept(spark, sf)[1])


_RESULTS = ["CASE event_type WHEN 'purchase' THEN 'vulnerable' WHEN 'error' THEN 'error' WHEN 'view' THEN 'skipped' ELSE 'safe' END AS status",
            "CASE WHEN value > 10 THEN 'cloud' ELSE 'layer1' END AS layer", "CAST(floor(value * 100) AS bigint) AS tokens_used",
            "value / 10 AS latency"]
_RESULTS_SQL = f"WITH r AS (SELECT {', '.join(_RESULTS)} FROM events) "


@query("mg7_status_summary", _RESULTS_SQL + """SELECT layer, count(*) FILTER (status = 'safe') AS n_safe,
count(*) FILTER (status = 'vulnerable') AS n_vulnerable, count(*) FILTER (status = 'error') AS n_error,
count(*) FILTER (status = 'skipped') AS n_skipped, CAST(sum(tokens_used) AS bigint) AS tokens_used FROM r GROUP BY layer""")
def mg7(spark, sf):
    return G.status_summary(table(spark, sf, "events").selectExpr(*_RESULTS))


@query("mg7_severity_summary", ctes("code_files", extra=_MERGE) + """
SELECT source_layer, severity, rule_id, count(*) AS n_findings, count(DISTINCT path) AS n_files FROM kept GROUP BY 1, 2, 3""")
def mg7_severity(spark, sf):
    return G.severity_summary(_kept(spark, sf)[1])


@query("mg8_latency_stats", _RESULTS_SQL + """SELECT layer, round(avg(latency), 6) AS avg_latency, max(latency) AS max_latency,
count(*) AS n_calls FROM r WHERE latency > 0 AND status <> 'skipped' GROUP BY layer""")
def mg8(spark, sf):
    return G.latency_stats(table(spark, sf, "events").selectExpr(*_RESULTS))


@query("mg9_void_findings", ctes("reasons") + """SELECT response_id, CASE WHEN verdict = 'ACCEPT' AND score < 0.1 THEN 0
ELSE CAST(len(string_split(reasoning, ' ')) AS integer) END AS n_violations FROM (SELECT response_id, verdict, reasoning,
CASE verdict WHEN 'ACCEPT' THEN score - 0.1 ELSE score END AS score FROM reasons)""")
def mg9(spark, sf):
    r = bind(spark, sf, "reasons").selectExpr(
        "response_id", "verdict", "CASE verdict WHEN 'ACCEPT' THEN score - 0.1 ELSE score END AS score",
        "split(reasoning, ' ') AS violations")
    return r.select("response_id", F.size(G.strip_void(
        F.col("verdict"), F.col("score"), F.col("violations"))).alias("n_violations"))


@query("mg10_score_bands", """SELECT CASE WHEN s < 0.3 THEN 'healthy' WHEN s < 0.6 THEN 'warning' ELSE 'critical' END AS band,
count(*) AS n FROM (SELECT l_discount * 8 AS s FROM lineitem) GROUP BY 1""")
def mg10(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_discount * 8 AS s")
    return rows.groupBy(G.score_band(F.col("s")).alias("band")).agg(F.count("*").alias("n"))


# --- evaluation ------------------------------------------------------------------------------------------
_VERDICT = ("CASE version WHEN 'V1' THEN n_chars > 1500 WHEN 'V2' THEN lang <> 'en' OR n_chars > 4000 "
            "ELSE source IN ('src0', 'src1', 'src2', 'src3') END")
_EVAL = ["version", f"CASE lang WHEN 'en' THEN 'E' ELSE 'T' END || {STR('case_id')} AS case_id",
         "CASE WHEN vulnerable THEN 'REJECT' ELSE 'ACCEPT' END AS expected",
         f"CASE WHEN {_VERDICT} THEN 'REJECT' ELSE 'ACCEPT' END AS verdict",
         "n_chars / CASE version WHEN 'V1' THEN 1000 WHEN 'V2' THEN 1600 ELSE 2000 END AS elapsed"]
_EVAL_CTE = {"ev": f"SELECT {', '.join(_EVAL)} FROM (SELECT *, unnest(['V1', 'V2', 'V2F']) AS version FROM truth)"}


def _eval(spark, sf):
    return bind(spark, sf, "truth").selectExpr("*", "explode(array('V1', 'V2', 'V2F')) AS version").selectExpr(*_EVAL)


@query("ev1_severity_verdict", f"""SELECT o_orderpriority, count(*) FILTER (verdict = 'REJECT') AS n_reject, count(*) AS n FROM (
SELECT o_orderpriority, CASE WHEN s IN ('CRITICAL', 'HIGH', 'MEDIUM') THEN 'REJECT' ELSE 'ACCEPT' END AS verdict FROM (
SELECT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'CRITICAL' WHEN 'O' THEN 'MEDIUM' ELSE 'LOW' END AS s FROM orders)) GROUP BY 1""")
def ev1(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderpriority", "CASE o_orderstatus WHEN 'F' THEN 'CRITICAL' WHEN 'O' THEN 'MEDIUM' ELSE 'LOW' END AS s")
    return rows.groupBy("o_orderpriority").agg(
        F.count_if(E.verdict_of(F.col("s")) == "REJECT").alias("n_reject"), F.count("*").alias("n"))


def _acc(cond: str) -> str:
    return f"round(coalesce(avg(CASE WHEN verdict = expected THEN 100.0 ELSE 0.0 END) FILTER ({cond}), 0), 6)"


@query("ev2_accuracy_by_slice", ctes("truth", extra=_EVAL_CTE) + f"""SELECT version, {_acc('TRUE')} AS overall,
{_acc("expected = 'ACCEPT'")} AS false_positive_traps, {_acc("expected = 'REJECT'")} AS violations,
{_acc("case_id LIKE 'E%'")} AS edge_cases, count(*) AS n_cases FROM ev GROUP BY version""")
def ev2(spark, sf):
    return E.accuracy_by_slice(_eval(spark, sf))


@query("ev3_confusion", ctes("truth") + """SELECT *, round(tp / nullif(tp + fn, 0), 6) AS recall,
round(tp / nullif(tp + fp, 0), 6) AS precision, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM (
SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn,
count(*) FILTER (NOT t AND NOT p) AS tn FROM (SELECT coalesce(a.vulnerable, false) AS t, coalesce(b.p, false) AS p FROM
(SELECT doc_id, toxic = 1 OR quality = 0 AS vulnerable FROM labels) a FULL JOIN (SELECT doc_id, n_chars > 1500 AS p FROM documents WHERE lang = 'en') b USING (doc_id)))""")
def ev3(spark, sf):
    truth = table(spark, sf, "labels").selectExpr("doc_id AS case_id", "toxic = 1 OR quality = 0 AS vulnerable")
    flagged = table(spark, sf, "documents").where("lang = 'en'").selectExpr("doc_id AS case_id", "n_chars > 1500 AS flagged")
    return E.confusion(truth, flagged)


_STATUS = "CASE lang WHEN 'en' THEN 'safe' WHEN 'fr' THEN 'error' WHEN 'de' THEN 'skipped' ELSE 'odd' END"


@query("ev4_miss_causes", ctes("truth") + f"""SELECT path, CASE WHEN n_chars > 3000 THEN 'Caught'
WHEN n_chars < 700 THEN 'Layer 1 Blindspot' WHEN source = 'src9' THEN 'Unknown Status: Unknown'
ELSE CASE {_STATUS} WHEN 'safe' THEN 'Model False Negative' WHEN 'error' THEN 'Model Error' WHEN 'skipped' THEN 'Token Limit Skip'
ELSE 'Unknown Status: odd' END END AS cause, CASE WHEN n_chars < 700 THEN 'File too small' END AS reason FROM truth WHERE vulnerable""")
def ev4(spark, sf):
    t = bind(spark, sf, "truth")
    return E.miss_causes(t, t.where("n_chars > 3000"),
                         t.where("n_chars < 700").selectExpr("path", "'File too small' AS reason"),
                         t.where("source <> 'src9'").selectExpr("path", f"{_STATUS} AS status"))


@query("ev5_version_wins", ctes("truth", extra=_EVAL_CTE | {"w": """SELECT case_id,
bool_or(verdict = expected) FILTER (version = 'V1') AS r1, bool_or(verdict = expected) FILTER (version = 'V2') AS r2,
bool_or(verdict = expected) FILTER (version = 'V2F') AS r3 FROM ev GROUP BY 1"""}) + """
SELECT count(*) FILTER (r1 AND NOT r2 AND NOT r3) AS v1_wins, count(*) FILTER (r2 AND NOT r1) AS v2_wins,
count(*) FILTER (r3 AND NOT r1 AND NOT r2) AS v3_wins FROM w""")
def ev5(spark, sf):
    return E.version_wins(_eval(spark, sf))


@query("ev6_version_speed", ctes("truth", extra=_EVAL_CTE | {"w": "SELECT " + ", ".join(
    f"count(*) FILTER (version = '{v}' AND verdict = expected) AS c{i}, avg(elapsed) FILTER (version = '{v}') AS e{i}"
    for i, v in enumerate(("V1", "V2", "V2F"), 1)) + " FROM ev"}) + """SELECT c1, c2, c3, round(e1, 6) AS e1, round(e2, 6) AS e2,
round(e3, 6) AS e3, round((e2 - e3) / nullif(e2, 0) * 100, 6) AS speedup_pct, CASE WHEN c3 >= c2 AND e3 < e2 THEN 'V2_FAST'
WHEN c2 > c1 THEN 'V2_FULL' WHEN c1 > c2 THEN 'V1' ELSE 'TIE' END AS winner FROM w""")
def ev6(spark, sf):
    return E.version_speed(_eval(spark, sf))


_V1 = ["case_id", "CASE WHEN n_chars > 1500 THEN 'REJECT' ELSE 'ACCEPT' END AS action",
       "CASE WHEN n_chars > 1500 THEN 1.0 ELSE 0.0 END AS drift_score", "CASE WHEN n_chars > 1500 THEN 2 ELSE 0 END AS n_violations"]
_V2 = ["case_id", "CASE WHEN lang <> 'en' THEN 'REJECT' ELSE 'ACCEPT' END AS action",
       "CASE WHEN lang <> 'en' THEN 0.6 ELSE 0.3 END AS drift_score", "CASE WHEN lang <> 'en' THEN 1 ELSE 0 END AS n_violations",
       "CASE lang WHEN 'en' THEN 'none' ELSE 'real' END AS exploitability", "source = 'src1' AS user_controlled_input"]


@query("ev7_compare_versions", ctes("truth", extra={
    "a": f"SELECT {', '.join(_V1)} FROM truth", "b": f"SELECT {', '.join(_V2)} FROM truth"}) + """
SELECT a.case_id, a.action AS v1_action, b.action AS v2_action, a.action <> b.action AS action_changed,
CAST(round(b.drift_score - a.drift_score, 6) AS double) AS score_delta, a.n_violations AS v1_violations, b.n_violations AS v2_violations,
array_to_string(list_filter([CASE WHEN a.action = 'REJECT' AND b.action = 'ACCEPT' THEN 'Reduced false positive' END,
CASE WHEN round(b.drift_score - a.drift_score, 6) < -0.2 THEN 'Significantly lower risk score' END,
CASE WHEN b.exploitability = 'none' THEN 'Correctly identified no exploitability' END,
CASE WHEN NOT b.user_controlled_input THEN 'Correctly identified no user input' END], lambda x: x IS NOT NULL), '; ') AS indicators
FROM a JOIN b ON a.case_id = b.case_id""")
def ev7(spark, sf):
    t = bind(spark, sf, "truth")
    out = E.compare_versions(t.selectExpr(*_V1), t.selectExpr(*_V2))
    return out.withColumn("indicators", F.array_join("indicators", "; ")).withColumn(
        "score_delta", F.col("score_delta").cast("double"))


_AST, _MODEL, _EXPECT = (
    "CASE o_orderstatus WHEN 'F' THEN 'CRITICAL' WHEN 'O' THEN 'SAFE' ELSE 'HIGH' END",
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' ELSE 'SAFE' END",
    "CASE WHEN o_totalprice > 250000 THEN 'CRITICAL' WHEN o_totalprice > 200000 THEN 'HIGH' ELSE 'LOW' END")


@query("ev8_agreement", f"""SELECT confidence, reason, count(*) AS n FROM (SELECT CASE WHEN a = e AND m = e THEN 100
WHEN a = 'CRITICAL' AND m = 'SAFE' THEN 70 WHEN m <> 'SAFE' AND a = 'SAFE' THEN 30 WHEN a = 'SAFE' AND m = 'SAFE' THEN 0 ELSE 50 END AS confidence,
CASE WHEN a = e AND m = e THEN 'AST and LLM both confirm' WHEN a = 'CRITICAL' AND m = 'SAFE' THEN 'AST confirms exploit but LLM says safe (possible LLM miss)'
WHEN m <> 'SAFE' AND a = 'SAFE' THEN 'LLM flags issue but AST finds no user-controlled path' WHEN a = 'SAFE' AND m = 'SAFE' THEN 'Both agree it''s safe'
ELSE 'Partial agreement' END AS reason FROM (SELECT {_AST} AS a, {_MODEL} AS m, {_EXPECT} AS e FROM orders)) GROUP BY 1, 2""")
def ev8(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(f"{_AST} AS a", f"{_MODEL} AS m", f"{_EXPECT} AS e")
    confidence, reason = E.agreement(F.col("a"), F.col("m"), F.col("e"))
    return rows.groupBy(confidence.alias("confidence"), reason.alias("reason")).agg(F.count("*").alias("n"))


_TIER = "substring(ext, 2, 10)"
_EXPECTED = "CASE WHEN code LIKE '%shell: true%' OR code LIKE '%req.%' OR code LIKE '%request.%' THEN 'CRITICAL' ELSE 'SAFE' END"
_CASES = {"cs": f"SELECT {_TIER} AS tier, path AS case_id, {EXPLOITABILITY_SQL} AS severity, {_EXPECTED} AS expected FROM code_files"}


def _cases(spark, sf):
    rows = bind(spark, sf, "code_files").withColumn("severity", S.exploitability(F.col("code")))
    return rows.selectExpr(f"{_TIER} AS tier", "path AS case_id", "severity", f"{_EXPECTED} AS expected").withColumn(
        "passed", F.col("severity") == F.col("expected"))


@query("ev9_tier_pass_rate", ctes("code_files", extra=_CASES) + """SELECT tier, count(*) AS n_cases,
count(*) FILTER (severity = expected) AS n_passed, round(avg(CASE WHEN severity = expected THEN 1.0 ELSE 0.0 END), 6) AS pass_rate
FROM cs GROUP BY tier""")
def ev9(spark, sf):
    return E.tier_report(_cases(spark, sf))


@query("ev9_release_gate", ctes("code_files", extra=_CASES) + """SELECT count(*) AS n_cases, count(*) FILTER (severity = expected) AS n_passed,
coalesce(bool_and(severity <> 'SAFE') FILTER (case_id LIKE 'shop/src/route%'), true) AS critical_ok,
bool_and(severity = expected) AND coalesce(bool_and(severity <> 'SAFE') FILTER (case_id LIKE 'shop/src/route%'), true) AS gate FROM cs""")
def ev9_gate(spark, sf):
    return E.release_gate(_cases(spark, sf), F.expr(
        "CASE WHEN case_id LIKE 'shop/src/route%' THEN severity <> 'SAFE' END"))


@query("ev10_categories", ctes("truth") + """SELECT path, CASE WHEN n_chars > 1000 THEN 'Category ' || lang ELSE 'Unknown' END AS category
FROM truth WHERE vulnerable""")
def ev10(spark, sf):
    t = bind(spark, sf, "truth")
    return E.categorise(t.where("vulnerable").select("path"),
                        t.where("n_chars > 1000").selectExpr("path", "'Category ' || lang AS category"))


@query("ev11_first_reason", ctes("code_files", extra=_MERGE) + """SELECT path, arg_min(violation, seq) AS reason, count(*) AS n_reasons
FROM kept WHERE path LIKE 'shop/node_modules/%' GROUP BY path""")
def ev11(spark, sf):
    rows = _kept(spark, sf)[1].where("path LIKE 'shop/node_modules/%'")
    return E.first_reason(rows.selectExpr("path", "violation AS reason", "seq"))


# --- snapshots ----------------------------------------------------------------------------------------------

@query("sn1_content_hash", ctes("live") + "SELECT project, name, md5(content) AS md5, sha256(content) AS sha256 FROM live")
def sn1(spark, sf):
    return N.fingerprints(bind(spark, sf, "live"))


def _signature(source: str) -> str:
    return f"SELECT project, sha256(string_agg(content, '' ORDER BY name)) AS signature FROM {source} GROUP BY project"


@query("sn2_project_signature", ctes("live") + _signature("live"))
def sn2(spark, sf):
    return N.project_signature(bind(spark, sf, "live"))


@query("sn3_verify_signature", ctes("live", "snapshot", extra={"a": _signature("live"), "b": _signature("snapshot")}) + """
SELECT a.project, a.signature, coalesce(a.signature = b.signature, true) AS valid FROM a LEFT JOIN b ON a.project = b.project""")
def sn3(spark, sf):
    return N.verify_signatures(bind(spark, sf, "live"), N.project_signature(bind(spark, sf, "snapshot")))


_NAMES = ", ".join(text(n) for n in R.DOCUMENT_NAMES)


@query("sn4_snapshot_status", ctes("live", "snapshot", extra={
    "e": f"SELECT project, unnest([{_NAMES}]) AS name FROM (SELECT project FROM live UNION SELECT project FROM snapshot)"}) + """
SELECT e.project, e.name, CASE WHEN l.name IS NULL AND s.name IS NULL THEN 'N/A' WHEN l.name IS NULL THEN 'MISSING IN LIVE'
WHEN s.name IS NULL THEN 'MISSING IN VAULT' WHEN l.content = s.content THEN 'IN SYNC' ELSE 'OUT OF SYNC' END AS status
FROM e LEFT JOIN live l ON l.project = e.project AND l.name = e.name LEFT JOIN snapshot s ON s.project = e.project AND s.name = e.name""")
def sn4(spark, sf):
    return N.snapshot_status(bind(spark, sf, "live"), bind(spark, sf, "snapshot"))


@query("sn5_changed_documents", ctes("live", "snapshot") + """SELECT l.project, l.name, md5(l.content) AS hash FROM live l
LEFT JOIN snapshot s ON s.project = l.project AND s.name = l.name WHERE s.content IS DISTINCT FROM l.content""")
def sn5(spark, sf):
    return N.changed_documents(bind(spark, sf, "live"), bind(spark, sf, "snapshot")).select(
        "project", "name", F.md5("content").alias("hash"))


@query("sn5_changed_keys", ctes("live", "snapshot") + """SELECT l.project, l.name FROM live l
LEFT JOIN snapshot s ON s.project = l.project AND s.name = l.name WHERE s.content IS DISTINCT FROM l.content""")
def sn5_keys(spark, sf):
    return N.changed_keys(bind(spark, sf, "live"), bind(spark, sf, "snapshot"))


@query("sn5_sync", ctes("live", "snapshot") + """SELECT coalesce(l.project, s.project) AS project, coalesce(l.name, s.name) AS name,
md5(coalesce(l.content, s.content)) AS hash FROM live l FULL JOIN snapshot s ON s.project = l.project AND s.name = l.name""")
def sn5_sync(spark, sf):
    return N.sync(bind(spark, sf, "live"), bind(spark, sf, "snapshot")).select(
        "project", "name", F.md5("content").alias("hash"))


_CRLF = "replace(text, chr(10), chr(13) || chr(10)) || chr(13)"


@query("sn6_line_endings", "SELECT doc_id, md5(text || chr(10)) AS hash FROM documents")
def sn6(spark, sf):
    from auditloom.functions.text import unify_newlines
    rows = table(spark, sf, "documents", "doc_id").selectExpr("doc_id", f"{_CRLF} AS t")
    return rows.select("doc_id", F.md5(unify_newlines(F.col("t"))).alias("hash"))


_HIST = {"versions": B.VERSIONS_SQL,
         "h": "SELECT path, ts, content, lag(content) OVER (PARTITION BY path ORDER BY ts) AS prev FROM versions"}
_FORM = "array_to_string(list_filter(list_transform(string_split({}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), '')".format


@query("sn7_changed_lines", ctes(extra=_HIST | {
    "p": """SELECT path, ts, unnest(range(1, greatest(len(string_split(content, chr(10))), len(string_split(prev, chr(10)))) + 1)) AS n,
string_split(content, chr(10)) AS a, string_split(prev, chr(10)) AS b FROM h WHERE prev IS NOT NULL"""}) + """
SELECT path, ts, CAST(n AS integer) AS line_no, a[n] AS line, b[n] AS prev_line FROM p WHERE a[n] IS DISTINCT FROM b[n]""")
def sn7(spark, sf):
    return N.changed_pairs(N.version_pairs(B.versions(spark, sf)))


@query("sn8_audit_chunk", ctes(extra=_HIST | {
    "p": """SELECT path, ts, CAST(unnest(range(1, greatest(len(string_split(content, chr(10))), len(string_split(prev, chr(10)))) + 1)) AS integer) AS n,
string_split(content, chr(10)) AS a, string_split(prev, chr(10)) AS b FROM h WHERE prev IS NOT NULL""",
    "w": """SELECT path, ts, n, a, max(CASE WHEN a[n] IS DISTINCT FROM b[n] THEN 1 ELSE 0 END) OVER (PARTITION BY path, ts ORDER BY n
ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS near FROM p"""}) + """
SELECT path, ts, string_agg(CAST(n AS varchar) || ' | ' || a[n], chr(10) ORDER BY n) AS chunk FROM w
WHERE near = 1 AND n <= len(a) GROUP BY path, ts""")
def sn8(spark, sf):
    return N.audit_pairs(N.version_pairs(B.versions(spark, sf)))


@query("sn9_sn10_skip_flags", ctes(extra=_HIST) + f"""SELECT path, ts, coalesce(content = prev, false) AS unchanged,
coalesce(content <> prev AND {_FORM('content')} = {_FORM('prev')}, false) AS cosmetic FROM h""")
def sn9(spark, sf):
    return N.skip_flags(B.versions(spark, sf))


@query("sn11_audit_mode", ctes(extra=_HIST | {
    "m": f"""SELECT path, ts, CAST(len(string_split(content, chr(10))) AS integer) AS n_lines, CASE WHEN coalesce(content = prev, false)
OR coalesce({_FORM('content')} = {_FORM('prev')}, false) THEN 'skip' WHEN prev IS NULL AND len(string_split(content, chr(10))) > 20 THEN 'index_only'
WHEN prev IS NULL OR len(string_split(content, chr(10))) <= 5 THEN 'full' ELSE 'diff' END AS mode FROM h"""}) + "SELECT * FROM m")
def sn11(spark, sf):
    # Limits of 20 and 5 lines: the documents have fewer lines than the defaults of 200 and 150.
    return N.audit_mode(N.with_history(B.versions(spark, sf)), first_limit=20, full_limit=5)


@query("sn11_sent_texts", ctes(extra=_HIST | {
    "m": f"""SELECT *, CASE WHEN coalesce(content = prev, false)
OR coalesce({_FORM('content')} = {_FORM('prev')}, false) THEN 'skip' WHEN prev IS NULL AND len(string_split(content, chr(10))) > 20 THEN 'index_only'
WHEN prev IS NULL OR len(string_split(content, chr(10))) <= 5 THEN 'full' ELSE 'diff' END AS mode FROM h""",
    "p": """SELECT path, ts, CAST(unnest(range(1, greatest(len(string_split(content, chr(10))), len(string_split(prev, chr(10)))) + 1)) AS integer) AS n,
string_split(content, chr(10)) AS a, string_split(prev, chr(10)) AS b FROM m WHERE mode = 'diff'""",
    "w": """SELECT path, ts, n, a, max(CASE WHEN a[n] IS DISTINCT FROM b[n] THEN 1 ELSE 0 END) OVER (PARTITION BY path, ts ORDER BY n
ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS near FROM p""",
    "k": """SELECT path, ts, string_agg(CAST(n AS varchar) || ' | ' || a[n], chr(10) ORDER BY n) AS chunk FROM w
WHERE near = 1 AND n <= len(a) GROUP BY path, ts"""}) + """
SELECT m.path, m.ts, mode, md5(CASE mode WHEN 'full' THEN content WHEN 'diff' THEN chunk END) AS sent FROM m
LEFT JOIN k ON k.path = m.path AND k.ts = m.ts""")
def sn11_sent(spark, sf):
    pairs = N.version_pairs(B.versions(spark, sf))
    return N.sent_pairs(pairs, first_limit=20, full_limit=5).withColumn("sent", F.md5("sent"))


_REMOVED = {"dl": lines_sql("diffs", "project, path", "diff"), "rem": f"""SELECT DISTINCT project, path, lower(unnest({imports_sql('t')})) AS tech
FROM (SELECT project, path, trim(substring(line, 2)) AS t FROM dl WHERE line LIKE '-%' AND line NOT LIKE '---%')"""}


@query("sn12_removed_dependencies", ctes("diffs", extra=_REMOVED) + "SELECT path, tech FROM rem")
def sn12(spark, sf):
    return N.removed_imports(bind(spark, sf, "diffs"))


_BLOCKS = {"pb0": r"SELECT project, name, regexp_split_to_array(content, '##\s+Problem\s+#\d+:')[2:] AS bs FROM notes",
           "pb": r"""SELECT project, name, seq, description, coalesce(nullif(regexp_extract(description, '\*\*Status\*\*:\s*(\w+)', 1), ''), 'UNKNOWN') AS status
FROM (SELECT project, name, unnest(bs) AS description, CAST(unnest(range(1, len(bs) + 1)) AS integer) AS seq FROM pb0)"""}


@query("sn13_pivots", ctes("diffs", "notes", extra=_REMOVED | _BLOCKS) + """SELECT DISTINCT p.project, p.name, p.seq, r.tech FROM pb p
JOIN rem r ON r.project = p.project WHERE p.status = 'UNRESOLVED' AND contains(lower(p.description), r.tech)""")
def sn13(spark, sf):
    removed = N.removed_imports(bind(spark, sf, "diffs"), "project", "path")
    return M.pivots(removed.select("project", "tech"), M.problem_blocks(bind(spark, sf, "notes")))


_MISSING = " UNION ALL ".join(
    f"SELECT project, rules, {i} AS i, {text(full)} AS rule_text FROM rule_docs WHERE NOT ("
    + " OR ".join(f"contains(rules, {text(m)})" for m in marks) + f") AND NOT contains(rules, {text(R.MANDATORY_HEADER)})"
    for i, (marks, full) in enumerate(R.MANDATORY_RULES))


@query("sn14_missing_rules", ctes("rule_docs", extra={"mi": _MISSING}) + r"""SELECT project, CAST(coalesce(list_max(list_transform(
regexp_extract_all(rules, '(?i)(?:^|\n)Rule\s+(\d+)\s*:', 1), lambda d: CAST(d AS integer))), 0)
+ row_number() OVER (PARTITION BY project ORDER BY i) AS integer) AS rule_no, rule_text FROM mi""")
def sn14(spark, sf):
    return N.missing_rules(bind(spark, sf, "rule_docs"))


@query("sn15_history_flag", ctes("rule_docs") + """SELECT project, len(list_filter(string_split(rules, chr(10)),
lambda x: trim(x) <> '' AND x NOT LIKE '#%' AND NOT contains(x, 'No problems'))) > 0 AS has_history FROM rule_docs""")
def sn15(spark, sf):
    return bind(spark, sf, "rule_docs").select("project", N.has_history(F.col("rules")).alias("has_history"))


# --- memory -------------------------------------------------------------------------------------------------

@query("mm1_problem_blocks", ctes("notes", extra=_BLOCKS) + "SELECT project, name, seq, description, status FROM pb")
def mm1(spark, sf):
    return M.problem_blocks(bind(spark, sf, "notes"))


@query("mm2_status_routing", ctes("notes", extra=_BLOCKS | {
    "t": "SELECT project, trim(string_split(description, chr(10))[1]) AS title, status FROM pb"}) + """
SELECT project, title, count(*) AS n_seen, CASE WHEN count(*) FILTER (status = 'UNRESOLVED') > 0 AND count(*) > 1 THEN 'urgent_rule'
WHEN count(*) FILTER (status = 'UNRESOLVED') > 0 THEN 'negative_rule' WHEN count(*) FILTER (status = 'RESOLVED') > 0 THEN 'pattern'
ELSE 'none' END AS target FROM t GROUP BY 1, 2""")
def mm2(spark, sf):
    return M.route_problems(M.problem_blocks(bind(spark, sf, "notes")))


_PENDING = [f"'cust' || {STR('o_custkey')} AS project", "o_orderkey AS line_no",
            f"'- [ ] ship order ' || {STR('o_orderkey')} AS line"]
_DONE = [f"'cust' || {STR('o_custkey')} AS project", "CASE WHEN o_totalprice > 400000 THEN 'call customer ' || "
         f"{STR('o_custkey')} ELSE 'ship order ' || {STR('o_orderkey')} END AS task", "o_orderdate AS ts"]
_TASKS = {"pend": f"SELECT {', '.join(_PENDING)} FROM orders",
          "comp": f"SELECT {', '.join(_DONE)} FROM orders WHERE o_orderstatus = 'F'"}


def _tasks(spark, sf):
    orders = table(spark, sf, "orders")
    return M.complete_tasks(orders.selectExpr(*_PENDING),
                            orders.where("o_orderstatus = 'F'").selectExpr(*_DONE))


@query("mm3_pending_tasks", ctes(extra=_TASKS) + """SELECT project, line_no, line FROM pend p WHERE NOT EXISTS (
SELECT 1 FROM comp c WHERE c.project = p.project AND contains(p.line, c.task))""")
def mm3_pending(spark, sf):
    return _tasks(spark, sf)[0]


@query("mm3_done_tasks", ctes(extra=_TASKS) + """SELECT project, task, ts, '## ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || chr(10) || '- ' || task AS entry
FROM comp c WHERE EXISTS (SELECT 1 FROM pend p WHERE c.project = p.project AND contains(p.line, c.task))""")
def mm3_done(spark, sf):
    return _tasks(spark, sf)[1].select("project", "task", "ts", "entry")


@query("mm3_task_errors", ctes(extra=_TASKS) + """SELECT project, task, ts, 'Task not found: ' || task AS message
FROM comp c WHERE NOT EXISTS (SELECT 1 FROM pend p WHERE c.project = p.project AND contains(p.line, c.task))""")
def mm3_errors(spark, sf):
    return _tasks(spark, sf)[2].select("project", "task", "ts", "message")


@query("mm4_baseline", ctes("live") + """SELECT project, name, content AS baseline FROM live""")
def mm4(spark, sf):
    return M.baseline(bind(spark, sf, "live"))


@query("mm5_verdict_history", ctes("ledger", extra={"d": """SELECT key, CAST(ts AS date) AS day, count(*) AS n_audits,
count(*) FILTER (result = 'REJECT') AS n_rejects FROM ledger GROUP BY 1, 2"""}) + """SELECT *, CAST(sum(n_audits) OVER w AS bigint) AS audits_so_far,
CAST(sum(n_rejects) OVER w AS bigint) AS rejects_so_far FROM d WINDOW w AS (PARTITION BY key ORDER BY day)""")
def mm5(spark, sf):
    return M.verdict_history(bind(spark, sf, "ledger"))
