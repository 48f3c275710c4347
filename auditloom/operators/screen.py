"""Risk screen: scoring, gate, line findings, ranking and reports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from auditloom import rules as R
from auditloom.functions import text as T


# --- path and file filters -------------------------------------------------------------------

def drop_directories(files: DataFrame, skip: Iterable[str] = R.SKIP_DIRS_SCAN) -> DataFrame:
    """Files with no path component in the skip set."""
    return files.where(~T.has_part(F.col("path"), skip))


def size_split(files: DataFrame, max_kb: int = 500) -> DataFrame:
    """Mark files above the size limit with a skip reason (null: kept).  Size is in bytes of UTF-8."""
    kb = F.octet_length("code") / F.lit(1024)
    reason = F.when(kb > max_kb, F.concat(F.lit("File too large ("), T.one_decimal(kb), F.lit("KB)")))
    return files.withColumn("skip_reason", reason)


def auditable(files: DataFrame, extensions: Iterable[str] = R.AUDITABLE_EXTENSIONS) -> DataFrame:
    """Files with an allowed extension and a non-blank text."""
    ends = T.any_of(F.col("path").endswith(e) for e in extensions)
    return files.where(ends & (F.trim(F.regexp_replace("code", r"\s+", " ")) != ""))


def drop_globs(files: DataFrame, globs: Iterable[str] = R.EXCLUDED_GLOBS) -> DataFrame:
    """Files whose path matches none of the globs."""
    return files.where(~T.any_of(F.col("path").rlike(T.glob_regex(g)) for g in globs))


def protected(files: DataFrame, state_dir: str = R.STATE_DIR) -> DataFrame:
    """Add ``protected``: the path runs through the state folder."""
    return files.withColumn("protected", T.has_part(F.col("path"), [state_dir]))


# --- rule hits and scores --------------------------------------------------------------------

def rule_hits(files: DataFrame, rules: Sequence[R.Rule], *keep: str, text: str = "code") -> DataFrame:
    """One row per (file, rule) with a match: kept columns, family, rule, hits.  No shuffle."""
    keep = keep or ("path",)
    base = T.prepared(files.select(*keep, F.col(text).alias("_t")), "_t")
    rows = ", ".join(f"named_struct('family', {T.lit(r.family)}, 'rule', {T.lit(r.name)}, "
                     f"'hits', bigint({T.hit_count_sql('_t', r)}))" for r in rules)
    return base.select(*keep, F.expr(f"explode(array({rows}))").alias("h")).where("h.hits > 0").select(
        *keep, "h.*")


def score_sql(text: str, rules: Sequence[R.Rule]) -> str:
    """Weighted sum of rule hits, at least 0.  Summed as a balanced tree, which stays shallow."""
    terms = [f"{r.weight} * ({T.hit_count_sql(text, r)})" for r in rules]
    while len(terms) > 1:
        terms = ["(" + " + ".join(terms[i:i + 2]) + ")" for i in range(0, len(terms), 2)]
    return f"bigint(greatest(0, {terms[0]}))"


def risk_score(files: DataFrame, profile: R.Profile, text: str = "code") -> DataFrame:
    """Add ``risk_score``: weighted sum of rule hits, at least 0."""
    ready = T.prepared(files, text)
    return T.computed_once(ready, "risk_score", score_sql(text, profile.rules)).drop(*T.PREPARED)


def word_counts(files: DataFrame, words: dict[str, str] = R.SENSITIVE_WORDS, *keep: str,
                text: str = "code") -> DataFrame:
    """Add one ``n_<word>`` column per sensitive word."""
    base = T.prepared(files.select(*(keep or ("path",)), F.col(text).alias("_t")), "_t")
    return base.selectExpr(*(keep or ("path",)), *[
        f"bigint({T.hit_count_sql('_t', r)}) AS n_{r.name}" for r in R.table(words, "sensitive")])


# --- gate --------------------------------------------------------------------------------------

def hard_skip_sql(path: str, text: str, name_only: bool = False, scan_chars: int | None = None) -> str:
    """Reason of the first matching skip rule, else null.

    Path rules come first, then file-name rules, then content rules over the whole text, or its first
    ``scan_chars`` characters.
    """
    name = f"lower(element_at(split({path}, '/'), -1))"
    where = name if name_only else f"lower({path})"
    head = text if scan_chars is None else f"substring({text}, 1, {scan_chars})"
    steps = [(where, p, n) for n, p in R.SKIP_PATH.items()]
    steps += [(name, p, f"{n} in filename") for n, p in R.SKIP_FILENAME.items()]
    steps += [(head, p, f"{n} in content") for n, p in R.SKIP_CONTENT.items()]
    whens = " ".join(f"WHEN {of} RLIKE {T.lit(p)} THEN {T.lit('Hard skip: ' + n)}" for of, p, n in steps)
    return f"CASE WHEN {path} = '' THEN NULL {whens} END"


OVERRIDE = "Context-Aware Override"


NOT_ASKED = "Not asked"


def gate(files: DataFrame, profile: R.Profile, own: str | None = None, asked: str = "TRUE") -> DataFrame:
    """Add should_audit, reason, risk_score (0 where skipped).

    Cheap tests run first; the wide score expression is evaluated only for rows that pass them.  Files of a project
    with rules of its own, marked by the column ``own``, pass as in ``gate_with_project_rules``, and their texts are not
    read at all.  Files for which the condition ``asked`` does not hold are not looked at and do not pass.
    """
    at_once = F.lit(False) if own is None else F.col(own)
    code, ext = F.col("code"), F.lower("ext")
    small = F.lit(f"File too small (< {profile.min_chars} chars)")
    skip = (F.when(at_once, F.lit(OVERRIDE)).when(~F.expr(asked), F.lit(NOT_ASKED))
            .when(F.length(code) < profile.min_chars, small)
            .when(ext.isin(*R.NON_CODE_EXTENSIONS), F.lit("Non-executable file type"))
            .otherwise(F.expr(hard_skip_sql("path", "code", profile.path_skips_by_name_only))))
    staged = T.prepared(files.withColumn("_skip", skip), "code", "_skip IS NULL")
    staged = T.computed_once(staged, "_score", "CASE WHEN _skip IS NULL THEN "
                             f"{score_sql('code', profile.rules)} END")
    passed = F.coalesce(F.col("_score") >= profile.min_score, F.lit(False))
    return staged.select(
        *files.columns,
        (at_once | passed).alias("should_audit"),
        F.when(passed, F.concat(F.lit("Exploitability score: "), F.col("_score").cast("string")))
        .otherwise(F.coalesce("_skip", F.lit("No exploitable attack paths detected"))).alias("reason"),
        F.when(at_once, F.lit(1).cast("bigint")).when(passed, F.col("_score")).otherwise(F.lit(0).cast("bigint")).alias("risk_score"))


def projects_with_rules(project_rules: DataFrame) -> DataFrame:
    """Projects whose rules are not empty, of ``project_rules(project, rules)``."""
    return project_rules.where(F.length("rules") > 0).select("project")


def gate_with_project_rules(gated: DataFrame, project_rules: DataFrame) -> DataFrame:
    """Files of a project with its own rules always pass, with score 1.

    ``project_rules(project, rules)`` has one row per project.
    """
    own = projects_with_rules(project_rules).select("project", F.lit(True).alias("_own"))
    out = gated.join(own, "project", "left")
    has = F.col("_own").isNotNull()
    return out.select(
        *[c for c in gated.columns if c not in ("should_audit", "reason", "risk_score")],
        (has | F.col("should_audit")).alias("should_audit"),
        F.when(has, F.lit(OVERRIDE)).otherwise(F.col("reason")).alias("reason"),
        F.when(has, F.lit(1).cast("bigint")).otherwise(F.col("risk_score")).alias("risk_score"))


# --- line findings -------------------------------------------------------------------------------

def line_findings(files: DataFrame, rules: Sequence[R.LineRule], *keep: str,
                  text: str = "code") -> DataFrame:
    """One finding per (line, rule): kept columns, rule_id, rule_name, line_number, matched_text,
    severity.

    Narrow.  Whole texts are tested first; lines are made only for the rules a text can match, and each
    is tested by that one rule.
    """
    keep = keep or ("path",)
    possible = ", ".join(f"CASE WHEN {_possible_sql('_t', r)} THEN {i} END" for i, r in enumerate(rules))
    named = ", ".join(f"named_struct('rule_id', {T.lit(r.rule_id)}, 'rule_name', {T.lit(r.name)}, "
                      f"'severity', {T.lit(r.severity)})" for r in rules)
    matches = " ".join(f"WHEN {i} THEN {T.line_matches_sql('line', r)}" for i, r in enumerate(rules))
    ready = T.prepared(files.select(*keep, F.col(text).alias("_t")), "_t")
    tried = ready.selectExpr(*keep, "_t", f"explode(filter(array({possible}), x -> x IS NOT NULL)) AS _r")
    lines = T.explode_lines(tried, *keep, "_r", text="_t").where(f"CASE _r {matches} END")
    return lines.selectExpr(*keep, "line_no AS line_number", "trim(line) AS matched_text",
                            f"get(array({named}), _r) AS _h").select(
        *keep, "_h.rule_id", "_h.rule_name", "line_number", "matched_text", "_h.severity")


def _possible_sql(text: str, rule: R.LineRule) -> str:
    """Necessary condition for a line match, on a prepared text: literals first, then the pattern with
    line anchors matching at every line."""
    pattern = f"(?m){rule.pattern}" if ("^" in rule.pattern or "$" in rule.pattern) else rule.pattern
    tests = [T.SHARED_MARKS.get(w, f"contains({text}, {T.lit(w)})") for w in rule.must]
    if rule.needles:
        tests.append(T.contains_any_sql("_lowered", rule.needles))
    return "(" + " AND ".join([*tests, f"{text} RLIKE {T.lit(pattern)}"]) + ")"


def screen_findings(files: DataFrame, profile: R.Profile = R.LOCAL, *keep: str) -> DataFrame:
    """Exploit and secret findings of files that pass the gate."""
    audited = gate(files, profile).where("should_audit")
    return line_findings(audited, R.exploit_line_rules(profile) + R.SECRET_RULES, *keep)


def n_line_matches_sql(text: str, rules: Sequence[R.LineRule]) -> str:
    """Number of (line, rule) matches of a prepared text, without making rows of its lines."""
    counts = [f"CASE WHEN {_possible_sql(text, r)} THEN size(filter(split({text}, '\\n', -1), "
              f"x -> {T.line_matches_sql('x', r)})) ELSE 0 END" for r in rules]
    return "bigint(" + " + ".join(counts) + ")"


def _counted(files: DataFrame, profile: R.Profile) -> DataFrame:
    """Gated files with the number of their exploit and secret findings, told on the row."""
    rules = R.exploit_line_rules(profile) + R.SECRET_RULES
    return T.computed_once(
        T.prepared(gate(files.select("path", "ext", "code"), profile), "code", "should_audit"), "n_violations",
        f"CASE WHEN should_audit THEN {n_line_matches_sql('code', rules)} ELSE 0L END")


def _matches_sql(text: str, rules: Sequence[R.LineRule]) -> str:
    """(rule_id, rule_name, severity, line_number) of all (line, rule) matches of a prepared text, as one array."""
    def of(r: R.LineRule) -> str:
        match = (f"named_struct('rule_id', {T.lit(r.rule_id)}, 'rule_name', {T.lit(r.name)}, "
                 f"'severity', {T.lit(r.severity)}, 'line_number', n + 1)")
        return (f"CASE WHEN {_possible_sql(text, r)} THEN filter(transform(split({text}, '\\n', -1), (x, n) -> "
                f"CASE WHEN {T.line_matches_sql('x', r)} THEN {match} END), m -> m IS NOT NULL) ELSE array() END")
    return f"concat({', '.join(map(of, rules))})"


def with_findings(files: DataFrame, profile: R.Profile = R.LOCAL) -> DataFrame:
    """Add ``hits`` (rule_id, rule_name, severity, line_number): the findings of ``screen_findings``, told on the row.

    One narrow pass.  The gate is asked last, only for the files in which a line rule matches: the others have no
    finding, whatever their score.
    """
    rules = R.exploit_line_rules(profile) + R.SECRET_RULES
    matched = T.computed_once(T.prepared(files, "code"), "_hits", _matches_sql("code", rules)).drop(*T.PREPARED)
    gated = gate(matched, profile, asked="size(_hits) > 0")
    return gated.selectExpr(*files.columns, "CASE WHEN should_audit THEN _hits ELSE array() END AS hits")


def screen_verdicts(files: DataFrame, profile: R.Profile = R.LOCAL) -> DataFrame:
    """Per file: path, verdict, n_violations, risk_score, details.  One narrow pass, no shuffle."""
    counted = _counted(files, profile)
    n, score = F.col("n_violations"), F.col("risk_score").cast("string")
    return counted.select(
        "path", F.when(n > 0, "REJECT").otherwise("ACCEPT").alias("verdict"), "n_violations", "risk_score",
        F.when(~F.col("should_audit"), F.concat(F.lit("Layer 1 ACCEPT: "), "reason"))
        .when(n > 0, F.concat(F.lit("Layer 1 REJECT: "), n.cast("string"),
                              F.lit(" critical violation(s) found (Risk Score: "), score, F.lit(")")))
        .otherwise(F.concat(F.lit("Layer 1 ACCEPT: Risk surface detected but no critical violations "
                                  "(Risk Score: "), score, F.lit(")"))).alias("details"))


# --- ranking and reports -----------------------------------------------------------------------

def top_risk(scored: DataFrame, n: int = 150, tie: str = "path") -> DataFrame:
    """The ``n`` riskiest files (the cap is the report's definition)."""
    return scored.orderBy(F.desc("risk_score"), F.asc(tie)).limit(n)


def extension_histogram(files: DataFrame) -> DataFrame:
    ext = T.extension(F.col("path"))
    return (files.groupBy(F.when(ext == "", ".no-ext").otherwise(ext).alias("ext"))
            .agg(F.count("*").alias("n_files")).orderBy(F.desc("n_files"), "ext"))


def skip_report(gated: DataFrame) -> DataFrame:
    return gated.where("NOT should_audit").groupBy("reason").agg(F.count("*").alias("n_files"))


# --- text shaping ----------------------------------------------------------------------------------

def blank_comments(text: Column) -> Column:
    """Full-line ``#`` comments become empty lines; line numbers stay."""
    return F.array_join(F.transform(
        T.split_lines(text),
        lambda x: F.when(F.regexp_replace(x, r"^\s+", "").startswith("#"), "").otherwise(x)), "\n")


def strip_keys(text: Column, keys: Iterable[str] = R.EXCLUDED_KEYS) -> Column:
    """Drop lines that set one of the excluded keys."""
    names = "|".join("".join("\\" + c if not c.isalnum() and c != "_" else c for c in k) for k in keys)
    pattern = f'"(?:{names})"\\s*:'
    return F.array_join(F.filter(T.split_lines(text), lambda x: ~x.rlike(pattern)), "\n")


def exploitability(text: Column) -> Column:
    """SAFE / HIGH / CRITICAL from user-input and execution flags of a text."""
    user = text.rlike(R.USER_INPUT)
    variable = F.regexp_extract(text, R.USER_ASSIGNED, 1)
    spawned = (variable != "") & F.array_contains(
        F.regexp_extract_all(text, F.lit(r"spawn\s*\(\s*(\w+)\s*[,)]"), 1), variable)
    binary = text.rlike(R.USER_BINARY) | spawned
    shell = text.rlike(r"shell\s*:\s*true")
    severe = (binary | text.rlike(r"eval\s*\(") | text.rlike(r"exec\s*\(")
              | text.rlike(R.ENV_NAMES) | shell)
    return (F.when(user & severe, "CRITICAL")
            .when(user & text.rlike(r"spawn\s*\("), "HIGH")
            .when(shell & text.rlike(r"\$\{.*\}"), "CRITICAL")
            .otherwise("SAFE"))
