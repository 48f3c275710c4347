"""Queries: sources, screen, declared rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom import rules as R
from auditloom.functions import text as T
from auditloom.functions.session import materialise
from auditloom.operators import declared as D
from auditloom.operators import flow, screen as S
from auditloom.plans.bindings import STR, bind, case, ctes, marked_code_files, text
from auditloom.plans.registry import query
from auditloom.sources import config

def hits_sql(rule: R.Rule, column: str = "code") -> str:
    if rule.name not in R.LOOKAHEAD_RULES:
        return f"len(regexp_extract_all({column}, {text(rule.pattern)}))"
    # DuckDB's regex engine has no look-ahead.  A match counts if no validator stands after it in its line: of
    # the line's matches, those before the last validator go.
    wanted, validators = rule.pattern.removesuffix("))").split("(?!.*(")
    return (f"CAST(list_sum(list_transform(string_split({column}, chr(10)), lambda x: "
            f"len(regexp_extract_all(x, {text(wanted)})) - len(regexp_extract_all(regexp_extract(x, "
            f"{text(f'^(.*)(?:{validators})')}, 1), {text(wanted)})))) AS bigint)")


def score_sql(profile: R.Profile, column: str = "code") -> str:
    terms = " + ".join(f"{r.weight} * {hits_sql(r, column)}" for r in profile.rules)
    return f"CAST(greatest(0, {terms}) AS bigint)"


def lines_sql(source: str, keep: str = "path", column: str = "code") -> str:
    return (f"SELECT {keep}, unnest(string_split({column}, chr(10))) AS line, "
            f"CAST(unnest(range(1, len(string_split({column}, chr(10))) + 1)) AS integer) AS line_no FROM {source}")


NAME_SQL = "list_extract(string_split(path, '/'), -1)"
EXT_SQL = f"regexp_extract({NAME_SQL}, '^.+(\\.[^.]*[^.])$', 1)"


# --- sources ---------------------------------------------------------------------------------------

def has_part_sql(parts) -> str:
    return f"list_has_any(string_split(path, '/'), [{', '.join(text(p) for p in parts)}])"


@query("src1_corpus_table", ctes("code_files") + f"""
SELECT {EXT_SQL} AS ext, count(*) AS n_files, CAST(sum(length(code)) AS bigint) AS n_chars FROM code_files
WHERE NOT {has_part_sql(R.SKIP_DIRS_SCAN)} GROUP BY 1""")
def src1(spark, sf):
    files = S.drop_directories(bind(spark, sf, "code_files"))
    return files.groupBy(T.extension(F.col("path")).alias("ext")).agg(
        F.count("*").alias("n_files"), F.sum(F.length("code").cast("bigint")).alias("n_chars"))


@query("src2_dir_exclusion", ctes("code_files")
       + f"SELECT path FROM code_files WHERE NOT {has_part_sql(R.SKIP_DIRS_SCAN)}")
def src2(spark, sf):
    return S.drop_directories(bind(spark, sf, "code_files").select("path"))


@query("src3_size_filter", ctes("doc_files") + """
SELECT path, CASE WHEN strlen(code) / 1024.0 > 16 THEN 'File too large (' || printf('%.1f', strlen(code) / 1024.0)
  || 'KB)' END AS skip_reason FROM doc_files""")
def src3(spark, sf):
    # 16 KB here: the documents of the small scales stay below the default of 500 KB.
    return S.size_split(bind(spark, sf, "doc_files"), max_kb=16).select("path", "skip_reason")


@query("src4_extension_allow_list", ctes("code_files") + f"""
SELECT path FROM code_files WHERE ({' OR '.join(f"path LIKE '%{e}'" for e in R.AUDITABLE_EXTENSIONS)})
AND trim(code) <> ''""")
def src4(spark, sf):
    return S.auditable(bind(spark, sf, "code_files")).select("path")


@query("src5_glob_exclusion", ctes("code_files") + """
SELECT path FROM code_files WHERE NOT (path LIKE '%/node_modules/%' OR path LIKE '%/.git/%' OR path LIKE '%/%.md'
OR path LIKE '%/%.json' OR path LIKE '%/%.lock')""")
def src5(spark, sf):
    return S.drop_globs(bind(spark, sf, "code_files").select("path"))


@query("src6_protected_path", ctes("code_files") + """
SELECT path, list_contains(string_split(path, '/'), 'node_modules') AS protected FROM code_files""")
def src6(spark, sf):
    return S.protected(bind(spark, sf, "code_files").select("path"), state_dir="node_modules")


_CONFIG = case("c_mktsegment", {
    "BUILDING": text('{"middleware": ["seg_clean"], "decorators": ["@seg_safe"]}'),
    "MACHINERY": text('{"patterns": ["audit_log"], "decorators": ["plain"]}'),
    "FURNITURE": text("{not json")}, "'{\"middleware\": [\"cust' || " + STR("c_custkey") + " || '\"]}'")


@query("src10_sink_config", f"""
WITH cfg AS (SELECT {_CONFIG} AS config FROM customer),
ok AS (SELECT CAST(config AS json) AS j FROM cfg WHERE json_valid(config)),
rows AS (
  SELECT 'middleware' AS kind, unnest(CAST(j->'middleware' AS varchar[])) AS value FROM ok
  UNION ALL SELECT 'decorators', ltrim(unnest(CAST(j->'decorators' AS varchar[])), '@') FROM ok
  UNION ALL SELECT 'patterns', unnest(CAST(j->'patterns' AS varchar[])) FROM ok
  UNION ALL SELECT 'middleware', unnest([{', '.join(text(v) for v in R.SINK_MIDDLEWARE)}])
  UNION ALL SELECT 'decorators', unnest([{', '.join(text(v) for v in R.SINK_DECORATORS)}])
  UNION ALL SELECT 'patterns', unnest([{', '.join(text(v) for v in R.SINK_PATTERNS)}]))
SELECT DISTINCT kind, value FROM rows""")
def src10(spark, sf):
    from auditloom.sources.tables import table
    return config.sink_table(spark, table(spark, sf, "customer").selectExpr(f"{_CONFIG} AS config"))


# --- screen ------------------------------------------------------------------------------------------

@query("sc1_line_numbering", ctes("code_files", extra={"l": lines_sql("code_files")}) + """
SELECT path, string_agg(CAST(line_no AS varchar) || ' | ' || line, chr(10) ORDER BY line_no) AS piped,
string_agg(CAST(line_no AS varchar) || ': ' || line, chr(10) ORDER BY line_no) AS coloned,
string_agg('[' || path || ':L' || CAST(line_no AS varchar) || '] ' || line, chr(10) ORDER BY line_no) AS cited
FROM l GROUP BY path""")
def sc1(spark, sf):
    code = F.col("code")
    return bind(spark, sf, "code_files").select(
        "path", T.numbered(code).alias("piped"), T.numbered(code, after=": ").alias("coloned"),
        T.numbered(code, F.concat(F.lit("["), "path", F.lit(":L")), "] ").alias("cited"))


@query("sc1_lines", ctes("doc_files", extra={"l": lines_sql("doc_files")}) + """
SELECT path, count(*) AS n_lines, CAST(sum(length(line)) AS bigint) AS n_chars,
CAST(sum(line_no * length(line)) AS bigint) AS weighted FROM l GROUP BY path""")
def sc1_lines(spark, sf):
    lines = T.explode_lines(bind(spark, sf, "doc_files"), "path")
    return lines.groupBy("path").agg(
        F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"),
        F.sum(F.col("line_no") * F.length("line")).alias("weighted"))


@query("sc2_comment_blanking", ctes("code_files", extra={"l": lines_sql("code_files")}) + """
SELECT path, string_agg(CASE WHEN trim(line) LIKE '#%' THEN '' ELSE line END, chr(10) ORDER BY line_no) AS code
FROM l GROUP BY path""")
def sc2(spark, sf):
    return bind(spark, sf, "code_files").select("path", S.blank_comments(F.col("code")).alias("code"))


@query("sc3_excluded_keys", ctes("code_files", extra={"l": lines_sql("code_files")}) + """
SELECT path, string_agg(line, chr(10) ORDER BY line_no) AS code FROM l
WHERE NOT (line LIKE '%"editor.fontSize"%:%' OR line LIKE '%"editor.fontFamily"%:%'
OR line LIKE '%"workbench.colorTheme"%:%') GROUP BY path""")
def sc3(spark, sf):
    return bind(spark, sf, "code_files").select("path", S.strip_keys(F.col("code")).alias("code"))


def skip_sql(profile: R.Profile) -> str:
    where = f"lower({NAME_SQL if profile.path_skips_by_name_only else 'path'})"
    whens = [f"WHEN regexp_matches({where}, {text(p)}) THEN {text('Hard skip: ' + n)}" for n, p in R.SKIP_PATH.items()]
    whens += [f"WHEN regexp_matches(lower({NAME_SQL}), {text(p)}) THEN {text(f'Hard skip: {n} in filename')}"
              for n, p in R.SKIP_FILENAME.items()]
    whens += [f"WHEN regexp_matches(code, {text(p)}) THEN {text(f'Hard skip: {n} in content')}"
              for n, p in R.SKIP_CONTENT.items()]
    return f"CASE {' '.join(whens)} END"


def gate_sql(profile: R.Profile, source: str) -> str:
    non_code = ", ".join(text(e) for e in R.NON_CODE_EXTENSIONS)
    return f"""SELECT *, skip IS NULL AND score >= {profile.min_score} AS should_audit,
CASE WHEN skip IS NOT NULL THEN skip WHEN score >= {profile.min_score} THEN 'Exploitability score: ' || CAST(score AS varchar)
ELSE 'No exploitable attack paths detected' END AS reason,
CASE WHEN skip IS NULL AND score >= {profile.min_score} THEN score ELSE 0 END AS risk_score FROM (
SELECT *, {score_sql(profile)} AS score, CASE WHEN length(code) < {profile.min_chars}
THEN 'File too small (< {profile.min_chars} chars)' WHEN lower(ext) IN ({non_code}) THEN 'Non-executable file type'
ELSE {skip_sql(profile)} END AS skip FROM {source})"""


@query("sc4_hard_skip", ctes("page_files", "doc_files", "code_files", extra={
    "f": "SELECT path, code FROM page_files UNION ALL SELECT path, code FROM doc_files "
         "UNION ALL SELECT path, code FROM code_files"}) + f"SELECT path, {skip_sql(R.LOCAL)} AS reason FROM f")
def sc4(spark, sf):
    files = (bind(spark, sf, "page_files").select("path", "code")
             .unionByName(bind(spark, sf, "doc_files").select("path", "code"))
             .unionByName(bind(spark, sf, "code_files").select("path", "code")))
    return files.selectExpr("path", f"{S.hard_skip_sql('path', 'code')} AS reason")


def hits_rows_sql(source: str, rules, keep: str = "path") -> str:
    rows = ", ".join(f"{{'family': {text(r.family)}, 'rule': {text(r.name)}, 'hits': {hits_sql(r)}}}" for r in rules)
    return (f"SELECT {keep}, h.family AS family, h.rule AS rule, h.hits AS hits FROM "
            f"(SELECT {keep}, unnest([{rows}]) AS h FROM {source}) WHERE h.hits > 0")


@query("sc5_rule_hits_pages", ctes("page_files") + hits_rows_sql("page_files", R.LOCAL.rules))
def sc5_pages(spark, sf):
    return S.rule_hits(bind(spark, sf, "page_files"), R.LOCAL.rules)


@query("sc5_rule_hits_documents", ctes("doc_files") + hits_rows_sql("doc_files", R.LOCAL.rules))
def sc5_docs(spark, sf):
    return S.rule_hits(bind(spark, sf, "doc_files"), R.LOCAL.rules)


@query("sc5_rule_hits_code_all_rules", ctes("code_files") + hits_rows_sql("code_files", R.LOCAL.rules))
def sc5_code(spark, sf):
    return S.rule_hits(bind(spark, sf, "code_files"), R.LOCAL.rules)


@query("sc6_risk_score_pages", ctes("page_files")
       + f"SELECT page_id, path, {score_sql(R.LOCAL)} AS risk_score FROM page_files")
def sc6(spark, sf):
    return S.risk_score(bind(spark, sf, "page_files"), R.LOCAL).select("page_id", "path", "risk_score")


def _gate_query(number: str, profile: str, source: str) -> None:
    @query(f"{number}_gate_{profile}_{source}", ctes(source, extra={"g": gate_sql(R.PROFILES[profile], source)})
           + "SELECT path, should_audit, reason, risk_score FROM g")
    def run(spark, sf):
        return S.gate(bind(spark, sf, source), R.PROFILES[profile]).select(
            "path", "should_audit", "reason", "risk_score")


_gate_query("sc7", "local", "doc_files")
_gate_query("sc8", "cloud", "doc_files")
_gate_query("sc9", "batch", "doc_files")
_gate_query("sc10", "local", "code_files")
_gate_query("sc10", "cloud", "code_files")


@query("sc11_gate_bypass", ctes("code_files", "rule_docs", extra={"g": gate_sql(R.CLOUD, "code_files")}) + """
SELECT g.project, g.path, coalesce(r.rules, '') <> '' OR g.should_audit AS should_audit,
CASE WHEN coalesce(r.rules, '') <> '' THEN 'Context-Aware Override' ELSE g.reason END AS reason,
CASE WHEN coalesce(r.rules, '') <> '' THEN 1 ELSE g.risk_score END AS risk_score
FROM g LEFT JOIN rule_docs r ON g.project = r.project""")
def sc11(spark, sf):
    files = marked_code_files(spark, sf, S.projects_with_rules(bind(spark, sf, "rule_docs")))
    return S.gate(files, R.CLOUD, own="own").select("project", "path", "should_audit", "reason", "risk_score")


def line_rules_sql(source: str, rules, keep: str = "path", extra_where: str = "TRUE") -> str:
    def cond(r):
        hit = f"regexp_matches(line, {text(r.pattern)})"
        return hit if r.allow is None else f"({hit} AND NOT regexp_matches(line, {text(r.allow)}))"
    parts = [f"SELECT {keep}, {text(r.rule_id)} AS rule_id, {text(r.name)} AS rule_name, line_no AS line_number, "
             f"trim(line) AS matched_text, {text(r.severity)} AS severity FROM {source} "
             f"WHERE {extra_where} AND {cond(r)}" for r in rules]
    return "\nUNION ALL ".join(parts)


_SCREEN_RULES = R.exploit_line_rules(R.LOCAL) + R.SECRET_RULES


@query("sc12_line_findings", ctes("code_files", extra={
    "g": gate_sql(R.LOCAL, "code_files"), "l": lines_sql("g", "path, should_audit")})
    + line_rules_sql("l", _SCREEN_RULES, extra_where="should_audit"))
def sc12(spark, sf):
    return S.screen_findings(bind(spark, sf, "code_files"), R.LOCAL)


@query("sc13_hardcoded_secrets", ctes("doc_files", extra={"l": lines_sql("doc_files")})
       + line_rules_sql("l", R.SECRET_RULES))
def sc13(spark, sf):
    return S.line_findings(bind(spark, sf, "doc_files"), R.SECRET_RULES)


@query("sc14_screen_verdict", ctes("code_files", extra={
    "g": gate_sql(R.LOCAL, "code_files"), "l": lines_sql("g", "path, should_audit"),
    "f": line_rules_sql("l", _SCREEN_RULES, extra_where="should_audit"),
    "n": "SELECT path, count(*) AS n FROM f GROUP BY path"}) + """
SELECT g.path, CASE WHEN n > 0 THEN 'REJECT' ELSE 'ACCEPT' END AS verdict, coalesce(n, 0) AS n_violations, risk_score,
CASE WHEN NOT should_audit THEN 'Layer 1 ACCEPT: ' || reason
WHEN n > 0 THEN 'Layer 1 REJECT: ' || CAST(n AS varchar) || ' critical violation(s) found (Risk Score: ' || CAST(risk_score AS varchar) || ')'
ELSE 'Layer 1 ACCEPT: Risk surface detected but no critical violations (Risk Score: ' || CAST(risk_score AS varchar) || ')'
END AS details FROM g LEFT JOIN n ON g.path = n.path""")
def sc14(spark, sf):
    return S.screen_verdicts(bind(spark, sf, "code_files"), R.LOCAL)


@query("sc15_top_150", ctes("page_files") + f"""SELECT page_id, path, {score_sql(R.LOCAL)} AS risk_score
FROM page_files ORDER BY risk_score DESC, path LIMIT 150""")
def sc15(spark, sf):
    scored = S.risk_score(bind(spark, sf, "page_files"), R.LOCAL)
    return S.top_risk(scored.select("page_id", "path", "risk_score"))


@query("sc16_extension_histogram", ctes("code_files", "doc_files", extra={
    "f": "SELECT path FROM code_files UNION ALL SELECT path FROM doc_files"}) + f"""
SELECT CASE WHEN {EXT_SQL} = '' THEN '.no-ext' ELSE {EXT_SQL} END AS ext, count(*) AS n_files FROM f
GROUP BY 1 ORDER BY 2 DESC, 1""")
def sc16(spark, sf):
    files = bind(spark, sf, "code_files").select("path").unionByName(bind(spark, sf, "doc_files").select("path"))
    return S.extension_histogram(files)


@query("sc17_skip_report", ctes("doc_files", extra={"g": gate_sql(R.BATCH, "doc_files")}) + """
SELECT reason, count(*) AS n_files FROM g WHERE NOT should_audit GROUP BY reason""")
def sc17(spark, sf):
    return S.skip_report(S.gate(bind(spark, sf, "doc_files"), R.BATCH))


EXPLOITABILITY_SQL = f"""CASE
WHEN regexp_matches(code, {text(R.USER_INPUT)}) AND (regexp_matches(code, {text(R.USER_BINARY)})
  OR (regexp_extract(code, {text(R.USER_ASSIGNED)}, 1) <> '' AND list_contains(
      regexp_extract_all(code, 'spawn\\s*\\(\\s*(\\w+)\\s*[,)]', 1), regexp_extract(code, {text(R.USER_ASSIGNED)}, 1)))
  OR regexp_matches(code, 'eval\\s*\\(') OR regexp_matches(code, 'exec\\s*\\(')
  OR regexp_matches(code, {text(R.ENV_NAMES)}) OR regexp_matches(code, 'shell\\s*:\\s*true')) THEN 'CRITICAL'
WHEN regexp_matches(code, {text(R.USER_INPUT)}) AND regexp_matches(code, 'spawn\\s*\\(') THEN 'HIGH'
WHEN regexp_matches(code, 'shell\\s*:\\s*true') AND regexp_matches(code, '\\$\\{{.*\\}}') THEN 'CRITICAL'
ELSE 'SAFE' END"""


@query("sc18_exploitability", ctes("code_files") + f"SELECT path, {EXPLOITABILITY_SQL} AS severity FROM code_files")
def sc18(spark, sf):
    return bind(spark, sf, "code_files").select("path", S.exploitability(F.col("code")).alias("severity"))


@query("sc19_sensitive_words", ctes("doc_files") + "SELECT path, " + ", ".join(
    f"{hits_sql(r)} AS n_{r.name}" for r in R.table(R.SENSITIVE_WORDS, "sensitive")) + " FROM doc_files")
def sc19(spark, sf):
    return S.word_counts(bind(spark, sf, "doc_files"))


# --- declared rules -------------------------------------------------------------------------------------

def _declared(name: str, rules, source: str) -> None:
    @query(name, ctes(source, extra={"l": lines_sql(source)}) + line_rules_sql("l", rules))
    def run(spark, sf):
        return S.line_findings(bind(spark, sf, source), rules)


_declared("dr1_dangerous_content", R.DANGEROUS_CONTENT, "page_files")
_declared("dr2_sensitive_output", R.SENSITIVE_OUTPUT, "code_files")
_declared("dr3_dynamic_sql", R.DYNAMIC_SQL, "code_files")
_declared("dr4_key_literals", R.KEY_LITERAL, "code_files")
_declared("dr4_key_literals_documents", R.KEY_LITERAL, "doc_files")
_declared("dr5_hygiene", R.HYGIENE, "code_files")
_declared("dr7_unsafe_calls", R.UNSAFE_CALLS, "code_files")


@query("dr6_unvalidated_body", ctes("code_files", extra={"l": lines_sql("code_files", "path, code")}) + line_rules_sql(
    "l", (R.LineRule("RULE_110", "unvalidated_body", R.BODY_USE, "CRITICAL"),),
    extra_where="NOT (" + " OR ".join(f"contains(code, {text(v)})" for v in R.VALIDATORS) + ")"))
def dr6(spark, sf):
    return D.unvalidated_body(bind(spark, sf, "code_files"))


_TYPE = case("event_type", {"error": "'Code Injection'", "click": "'XSS'", "view": "'SQL Injection'"}, "'Odd thing'")


@query("dr8_rule_id_mapping", f"SELECT event_id, {_TYPE} AS finding_type, "
       + case(_TYPE, {k: text(v) for k, v in R.RULE_IDS.items()}, text(R.RULE_ID_DEFAULT)) + " AS rule_id FROM events")
def dr8(spark, sf):
    from auditloom.sources.tables import table
    rows = table(spark, sf, "events").selectExpr("event_id", f"{_TYPE} AS finding_type")
    return rows.withColumn("rule_id", D.canonical_rule_id("finding_type"))


@query("dr9_function_metrics", ctes("code_files", extra={"l": lines_sql("code_files"), "m": r"""
SELECT path, line_no, trim(line) <> '' AS said, length(regexp_extract(line, '^( *)', 1)) AS indent,
regexp_extract(line, '^\s*(?:async )?(?:def|function|func) +([A-Za-z_]\w*)', 1) AS name FROM l""", "d": """
SELECT d.path, d.name, d.line_no, d.indent, (SELECT min(e.line_no) FROM m e WHERE e.path = d.path AND e.line_no > d.line_no
AND e.said AND e.indent <= d.indent) AS stop FROM m d WHERE d.name <> ''"""}) + """
SELECT d.path, d.name AS function, d.line_no AS start_line, count(*) AS n_lines,
greatest(0, CAST(max(CASE WHEN said THEN floor((m.indent - d.indent) / 4.0) - 1 END) AS bigint)) AS max_depth,
count(*) > 50 AS too_long, greatest(0, max(CASE WHEN said THEN floor((m.indent - d.indent) / 4.0) - 1 END)) > 3 AS too_deep
FROM d JOIN m ON m.path = d.path AND m.line_no >= d.line_no AND (d.stop IS NULL OR m.line_no < d.stop) GROUP BY 1, 2, 3""")
def dr9(spark, sf):
    return D.function_metrics(bind(spark, sf, "code_files"))


def imports_sql(column: str) -> str:
    parts = ", ".join(f"regexp_extract({column}, {text(p)}, 1)" for p in T.IMPORT_PATTERNS)
    return f"list_distinct(list_filter([{parts}], lambda x: x <> ''))"


_FORBIDDEN = (("src", "subprocess"), ("node_modules", "flask"), ("node_modules", "express"), ("tests", "os"))


@query("dr10_layer_violations", ctes("code_files", extra={"l": lines_sql("code_files"), "i": f"""
SELECT path, line_no, lower(unnest({imports_sql('line')})) AS module FROM l""", "fb": "SELECT * FROM (VALUES "
    + ", ".join(f"({text(a)}, {text(b)})" for a, b in _FORBIDDEN) + ") t(layer, module)"}) + """
SELECT i.path, fb.layer, i.module, i.line_no AS line_number FROM i JOIN fb ON i.module = fb.module
AND list_contains(string_split(i.path, '/'), fb.layer)""")
def dr10(spark, sf):
    forbidden = spark.createDataFrame(list(_FORBIDDEN), "layer string, module string")
    return D.layer_violations(bind(spark, sf, "code_files"), forbidden)


def _words_sql(words) -> str:
    return "(" + " OR ".join(f"contains(lower(reasoning), {text(w)})" for w in words) + ")"


@query("dr11_reasoning_consistency", ctes("reasons") + f"""
SELECT verdict, {_words_sql(R.WEASEL_PHRASES)} AS hedging, {_words_sql(R.PROXIMITY_WORDS)} AS proximity,
count(*) AS n_reasons FROM reasons GROUP BY 1, 2, 3""")
def dr11(spark, sf):
    hedging, proximity = D.reasoning_flags("reasoning")
    return bind(spark, sf, "reasons").groupBy(
        "verdict", hedging.alias("hedging"), proximity.alias("proximity")).agg(F.count("*").alias("n_reasons"))


# --- flow -------------------------------------------------------------------------------------------------

# The twin reads code by patterns of its own and finds statements by running sums over lines.
_LANG = case("lower(ext)", {k: text(v) for k, v in R.LANGUAGE_OF.items()}, "NULL")
_MIDDLE = ", ".join(text(m) for m in R.SINK_MIDDLEWARE + R.SINK_DECORATORS)


def _contains(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(w)})" for w in words) + ")"


def _last(column: str) -> str:
    return f"list_extract(regexp_split_to_array({column}, '[.:]+'), -1)"


def _by_language(words: dict) -> str:
    return "(" + " OR ".join(f"(language = {text(lang)} AND {_contains('lower(line)', [w.lower() for w in ws])})"
                             for lang, ws in words.items()) + ")"


_PARTS = {
    "cl": lines_sql("(SELECT *, " + _LANG + " AS language FROM code_files) WHERE language IS NOT NULL",
                    "path, language"),
    "bare": r"""SELECT *, regexp_replace(regexp_replace(line, '"[^"]*"|\x27[^\x27]*\x27', 'S', 'g'),
CASE WHEN language = 'python' THEN '#.*' ELSE '//.*' END, '') AS b FROM cl""",
    "depth": r"""SELECT *, sum(len(regexp_extract_all(b, CASE WHEN language = 'python' THEN '[(\[{]' ELSE '[(\[]' END))
- len(regexp_extract_all(b, CASE WHEN language = 'python' THEN '[)\]}]' ELSE '[)\]]' END)))
OVER (PARTITION BY path ORDER BY line_no) AS open, ends_with(b, chr(92)) AS goes_on FROM bare""",
    "opens": """SELECT *, CASE WHEN coalesce(lag(open) OVER (PARTITION BY path ORDER BY line_no), 0) = 0
AND NOT coalesce(lag(goes_on) OVER (PARTITION BY path ORDER BY line_no), false) THEN line_no END AS first FROM depth""",
    "whole": """SELECT *, max(first) OVER (PARTITION BY path ORDER BY line_no) AS head FROM opens""",
    "st0": r"""SELECT path, language, line_no, line,
nullif(regexp_extract(line, '^(?:[A-Za-z_][\w<>,\[\]]* +)*([A-Za-z_]\w*) *:?= *[^= ].*$', 1), '') AS target,
regexp_replace(trim(regexp_extract(line, '^[^=]*=(.*)$', 1)), '[;\s]+$', '') AS rhs0,
CASE WHEN regexp_matches(line, '^(async )?(def|function|func|class) ') THEN []
ELSE list_filter(regexp_extract_all(line, '([A-Za-z_][\w.:]*)!? *\(', 1),
  lambda c: c NOT IN ('if', 'for', 'while', 'switch', 'return', 'catch', 'elif', 'with')) END AS calls
FROM (SELECT path, language, head AS line_no, string_agg(trim(CASE WHEN goes_on THEN left(trim(line), -1) ELSE line END), ' '
      ORDER BY line_no) AS line FROM whole GROUP BY ALL) WHERE line <> ''""",
    "st": f"""SELECT *, CASE WHEN target IS NOT NULL THEN rhs0 END AS rhs,
coalesce({_last(f"list_extract(list_filter(calls, lambda c: {_last('c')} IN ({_MIDDLE})), 1)")},
CASE WHEN {' OR '.join(f"regexp_matches(line, {text(p)})" for p in R.SINK_PATTERNS)} THEN {_last('calls[1]')} END,
CASE WHEN language <> 'python' AND {_contains('line', R.SINK_MIDDLEWARE)} THEN {_last('calls[1]')} END) AS sink
FROM st0""",
    "src0": r"""SELECT *, regexp_extract(rhs, '^([A-Za-z_][\w.]*)\(.*\)$', 1) AS callee FROM st
WHERE target IS NOT NULL""",
    "src1": rf"""SELECT *, CASE WHEN regexp_matches(rhs, '^[fF]["'']') THEN 'F_STRING_TEMPLATE'
WHEN regexp_matches(rhs, '^["''].*["''] *% ') THEN 'FORMAT_OPERATOR'
WHEN regexp_matches(rhs, '^["'']') THEN 'LITERAL_STRING'
WHEN regexp_matches(rhs, '^[A-Za-z_][\w.]*\[.*\]$') THEN 'EXTERNAL_INPUT'
WHEN callee <> '' AND ({' OR '.join(f"starts_with(callee, {text(p)})" for p in R.SAFE_CALL_PREFIXES)}) THEN 'SAFE'
WHEN callee <> '' AND sink IS NOT NULL THEN 'OTHER' WHEN callee <> '' THEN 'EXTERNAL_INPUT' ELSE 'OTHER' END AS node_type
FROM src0""",
    "marked": f"""SELECT path, language, target AS variable, line_no, line AS expression, node_type, sink FROM src1
WHERE language = 'python' AND node_type IN ('EXTERNAL_INPUT', 'F_STRING_TEMPLATE', 'FORMAT_OPERATOR')
UNION ALL SELECT path, language, target, line_no, line, 'EXTERNAL_INPUT', sink FROM src1
WHERE {_by_language(R.EXTERNAL_INPUT)}""",
    "sources": """SELECT path, variable, line_no, expression, node_type FROM marked WHERE language = 'python'
UNION ALL SELECT path, variable, min(line_no), arg_min(expression, line_no), 'EXTERNAL_INPUT' FROM marked
WHERE language <> 'python' GROUP BY path, variable""",
    "us0": """SELECT path, language, line_no, line, target, calls, sink, coalesce(rhs, line) AS t FROM st
WHERE target IS NOT NULL OR len(calls) > 0""",
    "uses": r"""SELECT path, language, line_no, line, target, calls, sink, unnest(list_distinct(regexp_extract_all(
regexp_replace(CASE WHEN regexp_matches(t, '(^|\W)[fF]["'']') THEN t
ELSE regexp_replace(t, '"[^"]*"|\x27[^\x27]*\x27', '""', 'g') END, '\. *[A-Za-z_]\w*', '', 'g'), '[A-Za-z_]\w*')))
AS variable FROM us0""",
    "longest": "SELECT path, count(DISTINCT target) AS n FROM st GROUP BY path",  # no shortest path is longer
    "walk": """SELECT path, variable AS root, variable, 0 AS depth FROM sources
UNION SELECT w.path, w.root, u.target, w.depth + 1 FROM walk w JOIN uses u ON u.path = w.path
AND u.variable = w.variable JOIN longest l ON l.path = w.path AND w.depth < l.n WHERE u.target IS NOT NULL AND u.sink IS NULL""",
    "reached": "SELECT path, root, variable, min(depth) AS depth FROM walk GROUP BY 1, 2, 3",
    "tracked": "SELECT path, variable, min(depth) AS depth FROM reached GROUP BY 1, 2",
    "edges0": f"""SELECT u.path, u.variable, t.depth, u.line_no, u.target AS "to", 'ASSIGNMENT' AS type FROM uses u
JOIN tracked t ON u.path = t.path AND u.variable = t.variable WHERE u.sink IS NULL AND u.target IS NOT NULL
UNION ALL SELECT path, variable, depth, line_no, {_last('c')}, 'CALL' FROM (
SELECT u.path, u.variable, t.depth, u.line_no, unnest(u.calls) AS c FROM uses u
JOIN tracked t ON u.path = t.path AND u.variable = t.variable WHERE u.sink IS NULL)""",
    "edges": """SELECT path, (min(row(depth, variable, type)))[2] AS variable, line_no, "to",
(min(row(depth, variable, type)))[3] AS type FROM edges0 GROUP BY path, line_no, "to" """,
    "hits": """SELECT u.path, u.variable, u.line_no, min(u.sink) AS sink_name FROM uses u
JOIN tracked t ON u.path = t.path AND u.variable = t.variable WHERE u.sink IS NOT NULL GROUP BY 1, 2, 3""",
    "outs": f"SELECT * FROM uses WHERE sink IS NULL AND len(calls) > 0 AND {_by_language(R.UNSAFE_OUTPUT)}",
    # A use reads the last assignment above it.
    "made": "SELECT path, target AS variable, line_no FROM st WHERE target IS NOT NULL",
    "read": """SELECT u.*, m.line_no AS def_line FROM uses u ASOF JOIN made m
ON u.path = m.path AND u.variable = m.variable AND u.line_no > m.line_no""",
    "held": """SELECT path, variable AS root, line_no AS root_line, variable, line_no FROM marked WHERE sink IS NULL
UNION SELECT h.path, h.root, h.root_line, r.target, r.line_no FROM held h JOIN read r ON r.path = h.path
AND r.variable = h.variable AND r.def_line = h.line_no WHERE r.target IS NOT NULL AND r.sink IS NULL""",
    "leaked": """SELECT h.path, h.root, h.root_line, min(o.line_no) AS sink_line FROM held h JOIN read o
ON o.path = h.path AND o.variable = h.variable AND o.def_line = h.line_no
JOIN outs x ON x.path = o.path AND x.line_no = o.line_no AND x.variable = o.variable GROUP BY 1, 2, 3""",
    "found": """SELECT l.path, 'L2-DATA-FLOW' AS rule_id, 'Insecure Data Flow' AS rule_name, l.root AS variable,
l.root_line AS line_number, l.sink_line, 'Source: ' || l.root || ' (line ' || CAST(l.root_line AS varchar)
|| ') -> Sink: ' || s.line || ' (line ' || CAST(l.sink_line AS varchar) || ')' AS data_flow, 'HIGH' AS severity
FROM leaked l JOIN st s ON s.path = l.path AND s.line_no = l.sink_line""",
}


def flow_sql(body: str) -> str:
    return ctes("code_files", extra=_PARTS).replace("WITH ", "WITH RECURSIVE ", 1) + body


def _flow(spark, sf) -> flow.Relations:
    """The flow relations of the code files, written once."""
    return flow.relations(bind(spark, sf, "code_files"))


def _reached(found: flow.Relations):
    return materialise(flow.reach(found), "reached")


@query("fl1_fl2_sources", flow_sql("SELECT path, variable, line_no, expression, node_type FROM sources"))
def fl1(spark, sf):
    return flow.sources(flow.statements(bind(spark, sf, "code_files")))


@query("fl1_statements", flow_sql("SELECT path, line_no, line, target FROM st"))
def fl1_statements(spark, sf):
    return flow.statements(bind(spark, sf, "code_files")).select("path", "line_no", "line", "target")


@query("fl3_propagation", flow_sql('SELECT path, variable, line_no, "to", type FROM edges'))
def fl3(spark, sf):
    found = _flow(spark, sf)
    return flow.propagation(found, _reached(found))


@query("fl4_sink_hits", flow_sql("SELECT path, variable, line_no, sink_name FROM hits"))
def fl4(spark, sf):
    return flow.trace_sink_hits(flow.traces(bind(spark, sf, "code_files"), met=True))


@query("fl5_reach", flow_sql("SELECT path, root, variable, depth FROM reached"))
def fl5(spark, sf):
    return flow.trace(flow.traces(bind(spark, sf, "code_files")))


@query("fl5_trace_boundary", flow_sql("SELECT path, max(depth) >= 3 AS trace_boundary_reached FROM reached GROUP BY 1"))
def fl5_boundary(spark, sf):
    return flow.trace_boundary(flow.traces(bind(spark, sf, "code_files")))


@query("fl6_output_edges", flow_sql("""SELECT o.path, o.variable, o.line_no, o.line AS "to" FROM outs o
WHERE EXISTS (SELECT 1 FROM sources s WHERE s.path = o.path AND s.variable = o.variable)"""))
def fl6(spark, sf):
    return flow.output_edges(_flow(spark, sf))


@query("fl7_unsanitised_flow", flow_sql("SELECT * FROM found"))
def fl7(spark, sf):
    return flow.unsanitised(_flow(spark, sf))


@query("fl7_reaching_definitions", flow_sql("SELECT path, line_no, variable, def_line FROM read"))
def fl7_reaching(spark, sf):
    return flow.reaching(_flow(spark, sf)).select("path", "line_no", "variable", "def_line")


@query("fl8_source_questions", flow_sql("""
SELECT s.path, s.variable, s.line_no, s.expression,
coalesce((SELECT string_agg('  Line ' || CAST(e.line_no AS varchar) || ': passes to ' || e."to", chr(10)
  ORDER BY e.line_no, e."to") FROM edges e WHERE e.path = s.path AND e.variable = s.variable),
  '  No propagation detected') AS propagation,
coalesce((SELECT string_agg('  Line ' || CAST(h.line_no AS varchar) || ': hits registered sink ' || h.sink_name
  || ' - SAFE', chr(10) ORDER BY h.line_no) FROM hits h WHERE h.path = s.path AND h.variable = s.variable),
  '  No registered sink reached') AS sink_status, c.code AS code_head
FROM sources s JOIN code_files c ON c.path = s.path"""))
def fl8(spark, sf):
    found = _flow(spark, sf)
    reached = _reached(found)
    return flow.source_questions(bind(spark, sf, "code_files"), found.sources, flow.propagation(found, reached),
                                 flow.sink_hits(found, reached))


@query("fl9_flow_verdicts", flow_sql("""
SELECT s.path, CASE WHEN coalesce(n, 0) > 0 THEN 'REJECT' ELSE 'ACCEPT' END AS verdict, n_sources,
coalesce(n, 0) AS n_violations, CASE WHEN coalesce(n, 0) > 0 THEN 'Layer 2 found ' || CAST(n AS varchar)
|| ' violation(s) across ' || CAST(n_sources AS varchar) || ' source(s).' ELSE 'Layer 2 cleared '
|| CAST(n_sources AS varchar) || ' source(s). No violations confirmed.' END AS details
FROM (SELECT path, count(*) AS n_sources FROM sources GROUP BY 1) s
LEFT JOIN (SELECT path, count(*) AS n FROM found GROUP BY 1) f ON f.path = s.path"""))
def fl9(spark, sf):
    found = _flow(spark, sf)
    return flow.file_verdicts(found.sources, flow.unsanitised(found))
