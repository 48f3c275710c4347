"""Audit tables derived from the driver's tables.

Each binding is a select list in the SQL subset that Spark and DuckDB share, so that both engines start
from the same rows.  Templates stand in for code, reviews and notes; every input row gives one (or a
fixed number of) output rows, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditloom import rules as R
from auditloom.functions.session import spread
from auditloom.functions.text import computed_once
from auditloom.sources.tables import table


def text(value: str) -> str:
    """SQL literal."""
    return "'" + value.replace("'", "''") + "'"


def case(column: str, options: dict[str, str], otherwise: str) -> str:
    whens = " ".join(f"WHEN {text(k)} THEN {v}" for k, v in options.items())
    return f"CASE {column} {whens} ELSE {otherwise} END"


def filled(template: str, **slots: str) -> str:
    """Template literal with ``{slot}`` replaced by SQL string expressions."""
    out = text(template)
    for name, expr in slots.items():
        out = f"replace({out}, '{{{name}}}', {expr})"
    return out


STR = "CAST({} AS string)".format
NL = "chr(10)"

# --- code ---------------------------------------------------------------------------------------------
PY_RUN = """import subprocess
# runs the report job (and waits
def run_{k}(request):
    name_{c} = request.args['user']
    tag_{c} = name_{c}
    full_{c} = tag_{c}
    last_{c} = full_{c}
    end_{c} = last_{c}
    far_{c} = end_{c}
    print(name_{c})
    body_{c} = request.get(
        'body (raw',
        default=far_{c})
    text_{c} = far_{c} + {b}
        body_{c}
    print('text',
          text_{c})
    text_{c} = redact(text_{c})
    print(text_{c})
    subprocess.run(name_{c}, shell=True)
"""
PY_SAFE = """import hashlib
from flask import request
def store_{k}(request):
    mail_{c} = request.form['mail']
    safe_{c} = redact(mail_{c})
    note_{c} = f"order {mail_{c}} done"
    print(safe_{c})
    copy_{c} = mail_{c}
    mail_{c} = redact(
        mail_{c}
    )
    print(mail_{c})
    logger.info(copy_{c})
    digest = hashlib.sha256(mail_{c})
    return 1
"""
PY_SECRET = """API_TOKEN = os.getenv('API_TOKEN')
password = "pw-{k}-secret"
def check_{k}(body):
    def inner_{c}(x):
        return x

    try:
        assert body.user == 'admin'
        data = pickle.loads(request.json)
        for item in data:
            if item:
                if item.ok:
                    if item.done:
                        result = eval(request.body)
        print('token', password)
    except:
        logger.info('failed {c}')
"""
JS_OPEN = """const cp = require('child_process');
const cmd{c} = req.query.cmd;
const opts{c} = { shell: true };
const arg{c} = cmd{c};
spawn(cmd{c}, [arg{c}]);
console.log(cmd{c});
"""
JS_SAFE = """import express from 'express';
const name{c} = req.body.name;
const safe{c} = sanitize(name{c});
res.send(safe{c});
let all{c} = [
  safe{c}, // kept (first
  req.query.id
];
res.json(all{c});
all{c} = safe{c};
res.json(all{c});
spawn('ls', ['-l']);
"""
JS_XSS = """const box{c} = document.cookie;
el.innerHTML = '<img onerror=alert({k})>';
document.write(box{c});
eval(req.body.code);
"""
JAVA = """String user{c} = request.getParameter("user");
String sql{c} = "SELECT name FROM users WHERE id = " + user{c};
System.out.println(user{c});
MessageDigest md = MessageDigest.getInstance("MD5");
String key = "ABCDEFGHIJ0123456789X";
"""
GO = """name{c} := r.FormValue("name")
clean{c} := sanitize(name{c})
fmt.Println(name{c})
log.Println(clean{c})
"""
CONFIG = """{
  "editor.fontSize": 12,
  "retries": {c},
  "workbench.colorTheme": "dark",
  "token": "order-{k}"
}
"""
_K, _C = STR("o_orderkey"), STR("o_custkey")


def _by_status(f: str, o: str, p: str) -> str:
    return case("o_orderstatus", {"F": f, "O": o}, p)


def _code(t: str) -> str:
    return filled(t, k=_K, c=_C, b="chr(92)")


_EXT = case("o_orderpriority", {"1-URGENT": "'.py'", "2-HIGH": "'.js'", "3-MEDIUM": "'.java'",
                                "4-NOT SPECIFIED": "'.go'"}, "'.json'")
_STEM = case("o_orderpriority", {"1-URGENT": "'job'", "2-HIGH": "'route'", "3-MEDIUM": "'Dao'",
                                 "4-NOT SPECIFIED": "'main'"}, "'settings'")
CODE_PATH = (f"'shop/' || {_by_status(text('src'), text('node_modules'), text('tests'))} || '/' || {_STEM} || "
             f"{_K} || {_EXT}")
CODE_TEXT = case("o_orderpriority", {
    "1-URGENT": _by_status(_code(PY_RUN), _code(PY_SAFE), _code(PY_SECRET)),
    "2-HIGH": _by_status(_code(JS_OPEN), _code(JS_SAFE), _code(JS_XSS)),
    "3-MEDIUM": _code(JAVA), "4-NOT SPECIFIED": _code(GO)}, _code(CONFIG))
PROJECT = f"'cust' || {_C}"

# --- notes, rules, reasoning (orders, customer) -----------------------------------------------------------
_TECH = case("o_orderpriority", {"1-URGENT": "'Subprocess'", "2-HIGH": "'express'", "3-MEDIUM": "'spring'",
                                 "4-NOT SPECIFIED": "'hashlib'"}, "'redis'")
NOTE = """# Log
## Problem #1: build fails with {t} on page
**Status**: {s}
## Problem #2: slow start of {t}kit
No status yet {k}
"""
RULES_LONG = """# Rules
Rule 1 : NO hardcoded secrets, API keys, or passwords
Rule 12 : NO `eval()` or `exec()` with user input
Rule #3: LAYERS stay apart
"""
RULES_SHORT = """# Rules
Rule 2 : Walkthrough is kept
"""
REASON_CITED = """Found two. [source:RULE #1 (NO_SECRETS)] — "password = pw-{k}"
and [source:RULE #3] - 'eval(req' also [source:RULE #1 (NO_SECRETS)] — "password = pw-{k}" """
REASON_NAMED = "Rule 12: EVAL and violates the layer contract {k}. Could potentially break."
REASON_NONE = "The change follows pattern; nearby code is fine. Order {k} has no issue."
REASON_LINE = "See [source:SYSTEM_RULES] — 2 | name_{c} = request"
ANALYSIS = """[RESOLVED_PATTERNS]
- Pattern 1: use parameters {k}
- Pattern 2: keep it small
[NEGATIVE_RULES]
{r}
[LESSONS_LEARNED]
- Lesson 1: test order {k}
"""
ACTIONS = """[THOUGHT] ok [ACTIONS]
APPEND_TO_FILE: notes/{k}.md
CONTENT: |
Order {k} was reviewed.
Second line.

APPEND_TO_FILE: done.md
CONTENT:
- {c}
"""

ANSWER = ('{"findings": [{"is_vulnerable": true, "severity": "HIGH", "line_number": {n}, "vulnerability_type": "XSS", '
          '"description": "order {k}"}, {"is_vulnerable": true, "severity": "LOW", "line_number": 2}]}')

# --- reviews (documents, labels) -----------------------------------------------------------------------------
# Quotes, backslash, newline, braces and tilde are blanked so that texts can sit inside JSON templates.
DESC = "translate(text, chr(34) || chr(92) || chr(10) || '{}~', '      ')"
F_ARRAY = ('{"findings": [{"is_vulnerable": true, "severity": "CRITICAL", "rule_id": "RULE_100", '
           '"vulnerability_type": "Hardcoded Secrets", "line_number": 1, "description": "{d}"}, '
           '{"is_vulnerable": true, "severity": "odd", "line_number": {n}, "description": "second {l}"}, "note"]}')
F_ROOT = ('[{"is_vulnerable": true, "severity": "high", "vulnerability_type": "XSS", "line_number": {n}, '
          '"description": "{d}"}, {"is_vulnerable": false, "severity": "LOW"}]')
F_SINGLE = '{"is_vulnerable": true, "severity": "medium", "line_number": {n}, "description": "{d}"}'
F_EMPTY = '{"findings": []}'
F_TEXT = '{"findings": "[{~"is_vulnerable~": true, ~"severity~": ~"low~", ~"description~": ~"{d}~"}]"}'
F_FENCED = ('```json\n{"action": "REJECT", "drift_score": 0.75, "severity": "HIGH", "exploitability": "real", '
            '"confidence": 0.9, "reasoning": "{d}", "findings": [{"severity": "HIGH", "line_number": {n}}]}\n```')
F_BROKEN = '{"findings": [{"is_vulnerable": true, "description": "{d}"'

FLOW_OK = ('Checked. {"data_flow_logic": {"step_1_source": {"line": {n}, "expression": "request.form"}}, '
           '"chain_complete": true, "verdict": "REJECT", "confidence": "HIGH", "rejection_reason": "Line {n}: {d}"}')
FLOW_LITERAL = ('{"data_flow_logic": {"step_1_source": [{"line": 2, "expression": "name = \'{l}\'"}]}, '
                '"chain_complete": true, "verdict": "reject", "confidence": "LOW", "rejection_reason": "line 2"}')
FLOW_NEAR = ('{"data_flow_logic": {"step_1_source": {"line": {n}, "expression": "req.body"}}, "chain_complete": true, '
             '"verdict": "REJECT", "confidence": "LOW", "rejection_reason": "line {n} is in proximity"}')
FLOW_OPEN = ('{"data_flow_logic": {"step_1_source": {"line": 1}}, "chain_complete": false, "verdict": "REJECT", '
             '"confidence": "LOW", "rejection_reason": "seems bad", "sinks_scanned": []}')
FLOW_NOLINE = ('{"data_flow_logic": {"step_1_source": null}, "chain_complete": true, "verdict": "REJECT", '
               '"confidence": "LOW", "rejection_reason": "no source"}')
FLOW_WORDS = ('{"data_flow_logic": {"step_1_source": {"line": "three", "expression": "\'{l}\'"}}, "chain_complete": true, '
              '"verdict": "REJECT", "confidence": "LOW", "rejection_reason": "line {n}"}')
FLOW_BEFORE = ('The sink is nearby. {"data_flow_logic": {"step_1_source": {"line": {n}, "expression": "req.body"}}, '
               '"chain_complete": 1, "verdict": "REJECT", "confidence": "LOW", "rejection_reason": ""}')
FLOW_TEXT_FLAG = ('{"data_flow_logic": {"step_1_source": {"line": 2, "expression": "req.body"}}, "chain_complete": "false", '
                  '"verdict": "REJECT", "confidence": "LOW", "rejection_reason": "seems bad"}')
FLOW_FIELDS = '{"verdict": "REJECT", "confidence": "HIGH", "rejection_reason": "{d}"}'
FLOW_ACCEPT = ('Fine here {"data_flow_logic": {"step_1_source": {"line": 1}}, "chain_complete": true, '
               '"verdict": "ACCEPT", "confidence": "HIGH"}')

EIGHT = ('{"pattern_detected": "{p}", "user_controlled_input": {u}, "uses_shell": {h}, "argument_type": "{a}", '
         '"exploitability": "{e}", "severity": "{s}", "confidence": {f}, "reasoning": "{d}"}')
EIGHT_SHORT = '{"pattern_detected": "eval", "severity": "HIGH", "reasoning": "{d}"}'
BROKEN = ('{"broken_rules": [{"rule_id": "Rule 5", "description": "{d}", "line_number": {n}}, '
          '"Breaks Rule 7 here", "No number", {"description": "", "line_number": 0}]}')

_N = STR("1 + n_chars % 9")
_DOCS = {"d": DESC, "n": _N, "l": "lang"}


def _review(t: str) -> str:
    return filled(t, **_DOCS)


_LABEL = "coalesce(CAST(toxic AS string), 'n') || coalesce(CAST(quality AS string), 'n')"
REVIEW_RAW = case(_LABEL, {
    "11": _review(F_ARRAY), "10": _review(F_ROOT), "00": _review(F_SINGLE),
    "01": case("lang", {"fr": f"replace({_review(F_TEXT)}, '~', chr(92))", "de": _review(F_FENCED),
                        "es": _review(F_BROKEN)}, text(F_EMPTY))},
    case("lang", {"fr": _review(F_ARRAY), "de": "'no verdict: ' || text"}, _review(F_ROOT)))
REVIEW_RAW = case("source", {
    "src17": text('{"findings": null}'), "src18": _review('{"findings": "in line {n}: {d}"}'),
    "src19": _review('{"findings": {"severity": "HIGH", "line_number": {n}}}')}, REVIEW_RAW)
FLOW_RAW = case("source", {
    "src8": _review(FLOW_WORDS), "src9": _review(FLOW_BEFORE), "src10": text(FLOW_TEXT_FLAG),
    "src0": _review(FLOW_LITERAL), "src1": _review(FLOW_NEAR), "src2": text(FLOW_OPEN), "src3": text(FLOW_NOLINE),
    "src4": _review(FLOW_FIELDS), "src5": "text", "src6": text(FLOW_ACCEPT), "src7": _review(F_BROKEN)},
    _review(FLOW_OK))
_EIGHT = filled(EIGHT, p=case("lang", {"de": "'No risk found'"}, "'shell call'"),
                u=case("lang", {"fr": "'true'", "es": text('"false"')}, "'false'"),
                h=case("source", {"src1": "'true'"}, "'false'"),
                a=case("source", {"src2": "'list'", "src3": "'list'"}, "'string'"),
                e=case("source", {"src4": "'none'", "src5": "'none'"}, "'real'"),
                s=case("source", {"src2": "'MEDIUM'", "src6": "'LOW'", "src7": "'NONE'", "src8": "'HIGH'"},
                       "'CRITICAL'"),
                f=case("source", {"src9": "'1.5'", "src8": "'0.6'", "src11": text('"0.9"'), "src12": "'true'"}, "'0.9'"), d=DESC)
EIGHT_RAW = case("source", {"src10": _review(EIGHT_SHORT)}, _EIGHT)

_CALLS = ["user_id AS key", "event_id AS call_id", "ts", "CAST(floor(value * 100) AS bigint) AS est_tokens",
          "CAST(floor(value * CASE event_type WHEN 'purchase' THEN 130 ELSE 80 END) AS bigint) AS actual_tokens",
          "event_type AS model",
          "CASE event_type WHEN 'error' THEN 429 WHEN 'signup' THEN 401 ELSE 200 END AS status",
          "value / 10 AS latency"]

# name -> (FROM clause for SQL, source tables, select list)
BINDINGS: dict[str, tuple[str, list[str]]] = {
    "doc_files": ("documents", ["doc_id", f"source || '/' || {STR('doc_id')} AS path", "'' AS ext",
                                "text AS code", "source AS project", "lang", "n_chars"]),
    "page_files": ("pages", ["page_id", "url AS path", "'.html' AS ext", "html AS code"]),
    "code_files": ("orders", ["o_orderkey", f"{CODE_PATH} AS path", f"{_EXT} AS ext", f"{CODE_TEXT} AS code",
                              f"{PROJECT} AS project"]),
    "diffs": ("orders", [f"{CODE_PATH} AS path", f"{PROJECT} AS project",
                         f"'--- a/file' || {NL} || '-' || replace({CODE_TEXT}, {NL}, {NL} || '-') AS diff"]),
    "live": ("documents WHERE lang <> 'es'", [
        f"'p' || {STR('CAST(floor(doc_id / 6) AS bigint)')} AS project",
        case(STR("doc_id % 6"), {str(i): text(n) for i, n in enumerate(R.DOCUMENT_NAMES)}, "''") + " AS name",
        "text AS content"]),
    "snapshot": ("documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0", [
        f"'p' || {STR('CAST(floor(doc_id / 6) AS bigint)')} AS project",
        case(STR("doc_id % 6"), {str(i): text(n) for i, n in enumerate(R.DOCUMENT_NAMES)}, "''") + " AS name",
        "CASE WHEN quality = 0 THEN text || ' (old)' ELSE text END AS content"]),
    "calls": ("events", _CALLS),
    "ledger": ("events", ["user_id AS key", "ts", "CASE event_type WHEN 'error' THEN 'REJECT' ELSE 'ACCEPT' END "
                          "AS result"]),
    "notes": ("orders", [f"{PROJECT} AS project", f"'order' || {_K} AS name", filled(
        NOTE, t=_TECH, s=_by_status(text("RESOLVED"), text("UNRESOLVED"), text("")), k=_K) + " AS content"]),
    "rule_docs": ("customer", [f"'cust' || {STR('c_custkey')} AS project", case("c_mktsegment", {
        "BUILDING": text(RULES_LONG), "MACHINERY": text(RULES_LONG), "FURNITURE": "''"}, text(RULES_SHORT))
        + " AS rules"]),
    "reasons": ("orders", ["o_orderkey AS response_id", f"{PROJECT} AS project", f"{CODE_PATH} AS path", case(
        "o_orderpriority", {"1-URGENT": _by_status(_code(REASON_LINE), _code(REASON_CITED), _code(REASON_CITED)),
                            "2-HIGH": _code(REASON_CITED), "3-MEDIUM": _code(REASON_NAMED)}, _code(REASON_NONE))
        + " AS reasoning", _by_status(text("REJECT"), text("ACCEPT"), text("ACCEPT")) + " AS verdict",
        "CASE o_orderstatus WHEN 'F' THEN 0.5 WHEN 'O' THEN 0.1 ELSE 0.2 END AS score"]),
    # Answers of a model on code files; two of three orders have one.
    "answers": ("orders WHERE o_orderkey % 3 < 2", [
        "o_orderkey AS response_id", f"{CODE_PATH} AS path", case("o_orderpriority", {
            "1-URGENT": text('{"findings": []}'), "5-LOW": text('{"findings": [{"is_vulnerable": true}]}')},
            filled(ANSWER, k=_K, n=STR("o_orderkey % 9"))) + " AS raw"]),
    "analyses": ("orders", ["o_orderkey AS response_id", case("o_orderpriority", {
        "5-LOW": _code(ACTIONS)}, filled(ANALYSIS, k=_K, r=_by_status(
            text("NONE"), text("- Rule 1: NEVER do it"), text("- Rule 1: NEVER\n- Rule 2: NEVER"))))
        + " AS analysis"]),
    "reviews": ("documents LEFT JOIN labels USING (doc_id)", [
        "doc_id AS response_id", f"source || '/' || {STR('doc_id')} AS path", f"{REVIEW_RAW} AS raw"]),
    "flow_reviews": ("documents", ["doc_id AS response_id", f"source || '/' || {STR('doc_id')} AS path",
                                   f"{FLOW_RAW} AS raw"]),
    "eight_reviews": ("documents", ["doc_id AS response_id", f"source || '/' || {STR('doc_id')} AS path",
                                    f"{EIGHT_RAW} AS raw"]),
    "rule_reviews": ("documents", ["doc_id AS response_id", f"source || '/' || {STR('doc_id')} AS path",
                                   f"{_review(BROKEN)} AS raw"]),
    "truth": ("documents LEFT JOIN labels USING (doc_id)", [
        "doc_id AS case_id", f"source || '/' || {STR('doc_id')} AS path",
        "coalesce(toxic = 1 OR quality = 0, false) AS vulnerable", "lang", "source", "n_chars"]),
    "sends": ("documents", [f"source || '/' || {STR('doc_id')} AS path", "text AS content"]),
}

# Spread keys of the scans whose per-row work is heavy.
_SPREAD = {"documents": "doc_id", "pages": "page_id", "orders": "o_orderkey"}
# Tasks for every 4 MB of tables whose narrow rows become long texts.
_PER_SPLIT = {"orders": 16}


# Columns made by templates: computed once per row, as a stored column would be, and not copied into
# every filter on them.
_STORED = {"code_files": "code", "diffs": "diff", "notes": "content", "reasons": "reasoning",
           "analyses": "analysis", "reviews": "raw", "flow_reviews": "raw", "eight_reviews": "raw",
           "rule_reviews": "raw", "answers": "raw"}


def bind(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A binding as a Spark DataFrame."""
    source, columns = BINDINGS[name]
    tables, _, where = source.partition(" WHERE ")
    first, _, second = tables.partition(" LEFT JOIN ")
    key = _SPREAD.get(first)
    df = table(spark, sf, first, *([key] if key else []), per_split=_PER_SPLIT.get(first, 1))
    if second:
        df = df.join(table(spark, sf, second.split(" ")[0]), "doc_id", "left")
    if where:
        df = df.where(where)
    stored = _STORED.get(name)
    if stored is None:
        return df.selectExpr(*columns)
    made = next(c for c in columns if c.endswith(f" AS {stored}")).removesuffix(f" AS {stored}")
    names = [stored if c.endswith(f" AS {stored}") else c for c in columns]
    return computed_once(df, stored, made).selectExpr(*names)


def marked_code_files(spark: SparkSession, sf: str, projects: DataFrame) -> DataFrame:
    """``code_files`` (project, path, ext, code) with ``own``: the project is one of ``projects``.

    Marked as narrow rows, before texts are made; a file that is marked gets none.
    """
    orders = table(spark, sf, "orders").selectExpr("*", f"{PROJECT} AS project")
    dealt = spread(orders, "project", per_split=_PER_SPLIT["orders"])
    marked = dealt.join(projects.select("project", F.lit(True).alias("own")), "project", "left")
    files = computed_once(marked, "code", f"CASE WHEN own IS NULL THEN {CODE_TEXT} END")
    return files.selectExpr("project", f"{CODE_PATH} AS path", f"{_EXT} AS ext", "code", "own IS NOT NULL AS own")


def ctes(*names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause for DuckDB holding the named bindings and further CTEs."""
    parts = []
    for name in names:
        source, columns = BINDINGS[name]
        parts.append(f"{name} AS (SELECT {', '.join(columns)} FROM {source})")
    parts += [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n"


VERSION_TEXT = ("CASE WHEN v <= 2 THEN text WHEN v = 3 THEN replace(text, chr(10), chr(10) || '  ') "
                "ELSE replace(replace(text, chr(10), chr(10) || '  '), ' the ', ' THE ') END")
VERSIONS_SQL = (f"SELECT source || '/' || {STR('doc_id')} AS path, TIMESTAMP '2024-01-01 00:00:00' "
                f"+ v * INTERVAL '1' DAY AS ts, {VERSION_TEXT} AS content FROM documents, range(1, 5) t(v)")


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """Four versions of each document: as it is, unchanged, re-indented, edited."""
    docs = table(spark, sf, "documents", "doc_id").selectExpr("*", "explode(sequence(1, 4)) AS v")
    return docs.selectExpr(f"source || '/' || {STR('doc_id')} AS path",
                           "TIMESTAMP '2024-01-01 00:00:00' + v * INTERVAL '1' DAY AS ts",
                           f"{VERSION_TEXT} AS content")


ATTEMPT_STATUS = ("CASE event_type WHEN 'error' THEN 429 WHEN 'view' THEN CASE attempt WHEN 1 THEN 504 ELSE 200 END "
                  "WHEN 'signup' THEN 401 ELSE 200 END")
ATTEMPTS = "CASE event_type WHEN 'error' THEN 4 WHEN 'view' THEN 2 ELSE 1 END"
ATTEMPTS_SQL = (f"SELECT event_id AS request_id, attempt, {ATTEMPT_STATUS} AS status FROM "
                f"(SELECT *, unnest(range(1, 1 + {ATTEMPTS})) AS attempt FROM events)")


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Call attempts: four for an error, two for a view, else one."""
    rows = table(spark, sf, "events").selectExpr("*", f"explode(sequence(1, {ATTEMPTS})) AS attempt")
    return rows.selectExpr("event_id AS request_id", "attempt", f"{ATTEMPT_STATUS} AS status")
