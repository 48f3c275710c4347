"""Normalising semi-structured model responses.

``responses(response_id, path, raw)``.  Raw text is parsed once to VARIANT; typed columns are taken
out by path, so a malformed answer yields nulls instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from auditloom import rules as R
from auditloom.functions import text as T

# Texts of the response contract.
DEFAULT_RULE_ID = "Built-in Taint Analysis"
DEFAULT_RULE_NAME = "Security Issue"
DEFAULT_VIOLATION = "Security vulnerability detected."
DEFAULT_DESCRIPTION = "Security issue"


# --- extraction and lenient parsing ------------------------------------------------------------

def json_block(raw: Column) -> Column:
    """From the first ``{`` to the last ``}``, or null."""
    start = F.instr(raw, "{")
    end = F.length(raw) - F.instr(F.reverse(raw), "}") + 1
    return F.when((start > 0) & raw.contains("}") & (end > start),
                  F.substring(raw, start, end - start + 1))


def strip_fences(raw: Column) -> Column:
    return F.trim(F.regexp_replace(raw, r"^\s*```(?:json)?\s*|\s*```\s*$", ""))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _holds(v: Column) -> Column:
    """Whether a JSON value counts as true: not null, false, zero or empty; null for an absent one."""
    kind = _kind(v)
    return (F.when(kind == "BOOLEAN", _get(v, "$", "boolean")).when(kind == "STRING", _get(v, "$", "string") != "")
            .when(kind.startswith("OBJECT"), kind != "OBJECT<>")
            .when(kind.startswith("ARRAY"), F.size(_get(v, "$", "array<variant>")) > 0)
            .when(kind == "VOID", F.lit(False)).otherwise(_get(v, "$", "double") != 0))


def whole_json(df: DataFrame, name: str, text: Column) -> DataFrame:
    """Add ``name``: the one JSON value a text consists of, as VARIANT, else null.

    The parser stops after a first value; inside brackets, text after it gives a second item or an error.
    """
    listed = T.computed_once(df, "_list", _get(F.try_parse_json(
        F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>"))
    return listed.withColumn(name, F.when(F.size("_list") == 1, F.get("_list", 0))).drop("_list")


def parsed(responses: DataFrame) -> DataFrame:
    """Add ``v``: the JSON object of the response as VARIANT, null if there is none or it is empty."""
    one = whole_json(responses, "_one", json_block(F.col("raw")))
    kind = _kind(F.col("_one"))
    return one.withColumn("v", F.when(kind.startswith("OBJECT<") & (kind != "OBJECT<>"),
                                      F.col("_one"))).drop("_one")


def lenient(responses: DataFrame) -> DataFrame:
    """Verdict record with safe defaults; ``parse_error`` marks rows that could not be read."""
    p = parsed(responses.withColumn("raw", strip_fences(F.col("raw"))))
    bad = F.col("v").isNull()
    v = F.col("v")
    return p.select(
        "response_id", "path", bad.alias("parse_error"),
        F.coalesce(_get(v, "$.action", "string"), F.lit("ACCEPT")).alias("action"),
        F.coalesce(_get(v, "$.drift_score", "double"), F.lit(0.0)).alias("drift_score"),
        F.coalesce(_get(v, "$.severity", "string"), F.lit("NONE")).alias("severity"),
        F.coalesce(_get(v, "$.exploitability", "string"), F.lit("none")).alias("exploitability"),
        F.coalesce(_get(v, "$.confidence", "double"), F.lit(0.0)).alias("confidence"),
        F.coalesce(_get(v, "$.pattern_detected", "string"),
                   F.when(bad, F.lit("parse_error"))).alias("pattern_detected"),
        F.coalesce(_get(v, "$.reasoning", "string"),
                   F.when(bad, F.lit("Failed to parse response"))).alias("reasoning"))


def quarantine(responses: DataFrame) -> DataFrame:
    """Unreadable responses, with their full text, for a later repair."""
    p = parsed(responses.withColumn("raw", strip_fences(F.col("raw"))))
    return p.where("v IS NULL").select("response_id", "path", "raw")


# --- findings shapes -------------------------------------------------------------------------------

def finding_items(responses: DataFrame) -> DataFrame:
    """Findings of any accepted shape as ``items array<variant>``, with the ``shape`` that held them.

    Root array; ``findings`` array; ``findings`` as a string holding an array; one object with
    ``is_vulnerable``.
    """
    p = whole_json(responses, "_v", F.trim("raw"))
    p = p.withColumn("_k", _kind(F.col("_v"))).withColumn(
        "_f", F.when(F.col("_k").startswith("OBJECT"), _get(F.col("_v"), "$.findings", "variant")))
    p = p.withColumn("_fk", _kind(F.col("_f")))
    text = F.when(F.col("_fk") == "STRING", _get(F.col("_v"), "$.findings", "string"))
    p = whole_json(p, "_s", F.when(F.trim(text).startswith("["), text))
    as_list = F.when(F.col("_fk").startswith("ARRAY"), _get(F.col("_f"), "$", "array<variant>"))
    from_text = F.when(_kind(F.col("_s")).startswith("ARRAY"), _get(F.col("_s"), "$", "array<variant>"))
    single = F.col("_k").startswith("OBJECT") & _get(
        F.col("_v"), "$.is_vulnerable", "variant").isNotNull()
    root = F.col("_k").startswith("ARRAY")
    listed = F.coalesce(as_list, from_text)
    filled = F.coalesce(F.size(listed) > 0, F.lit(False))
    shape = (F.when(F.col("_v").isNull(), "unreadable").when(root, "root_array")
             .when(filled & as_list.isNotNull(), "findings").when(filled, "findings_text")
             .when(single, "single").otherwise("empty"))
    items = (F.when(root, _get(F.col("_v"), "$", "array<variant>")).when(filled, listed)
             .when(single, F.array("_v")).otherwise(F.array().cast("array<variant>")))
    return T.computed_once(p.withColumn("shape", shape), "items", items).select(
        *responses.columns, "shape", "items")


def told_items(items: DataFrame, *keep: str) -> DataFrame:
    """One row per item, and one for a response without any, with ``confirmed``: it is an object with ``is_vulnerable``
    literally true.  ``keep`` are further columns of the responses."""
    rows = items.select("response_id", "path", *keep, F.posexplode_outer("items").alias("pos", "i"))
    i = F.col("i")
    truth = (_kind(_get(i, "$.is_vulnerable", "variant")) == "BOOLEAN") & _get(
        i, "$.is_vulnerable", "boolean")
    return rows.select(
        "response_id", "path", *keep, F.col("pos").alias("seq"),
        F.upper(F.coalesce(_get(i, "$.severity", "string"), F.lit("UNKNOWN"))).alias("severity"),
        F.coalesce(_get(i, "$.vulnerability_type", "string"),
                   F.lit("Unknown Vulnerability")).alias("vulnerability_type"),
        _get(i, "$.line_number", "int").alias("line_number"),
        F.coalesce(_get(i, "$.description", "string"),
                   F.lit("No description provided.")).alias("description"),
        F.coalesce(_kind(i).startswith("OBJECT") & truth, F.lit(False)).alias("confirmed"))


def confirmed_findings(items: DataFrame) -> DataFrame:
    """One row per item that is an object with ``is_vulnerable`` literally true."""
    return told_items(items).where("confirmed").drop("confirmed")


def actions(items: DataFrame) -> DataFrame:
    """Per response: REJECT with at least one confirmed finding, else ACCEPT."""
    confirmed = F.size(F.filter("items", lambda i: F.coalesce(
        _kind(i).startswith("OBJECT")
        & (_kind(_get(i, "$.is_vulnerable", "variant")) == "BOOLEAN")
        & _get(i, "$.is_vulnerable", "boolean"), F.lit(False))))
    return items.select("response_id", "path", "shape", confirmed.alias("n_findings")).withColumn(
        "action", F.when(F.col("n_findings") > 0, "REJECT").otherwise("ACCEPT"))


# --- findings schema -------------------------------------------------------------------------------

def with_findings(responses: DataFrame) -> DataFrame:
    """Responses whose object has ``findings``: ``findings array<variant>`` and ``claimed``, true if it is filled.

    A text or object in its place has no items, but claims findings if it is not empty.
    """
    given = _get(F.col("v"), "$.findings", "variant")
    return parsed(responses).where(given.isNotNull()).withColumns({
        "findings": F.coalesce(_get(F.col("v"), "$.findings", "array<variant>"), F.array().cast("array<variant>")),
        "claimed": F.coalesce(_holds(given), F.lit(False))})


def violations(responses: DataFrame) -> DataFrame:
    """Findings mapped to violation rows with the contract's defaults."""
    rows = with_findings(responses).select("response_id", "path", F.posexplode("findings").alias("seq", "i"))
    i = F.col("i")
    return rows.where(_kind(i).startswith("OBJECT")).select(
        "response_id", "path", "seq",
        F.coalesce(_get(i, "$.rule_id", "string"), F.lit(DEFAULT_RULE_ID)).alias("rule_id"),
        F.coalesce(_get(i, "$.vulnerability_type", "string"), F.lit(DEFAULT_RULE_NAME)).alias("rule_name"),
        F.when(_get(i, "$.line_number", "variant").isNull(), 0).otherwise(
            _get(i, "$.line_number", "int")).alias("line_number"),
        F.coalesce(_get(i, "$.description", "string"), F.lit(DEFAULT_VIOLATION)).alias("violation"),
        F.coalesce(_get(i, "$.severity", "string"), F.lit("MEDIUM")).alias("severity"),
        F.lit("HIGH").alias("confidence"))


def finding_score(findings: Column) -> Column:
    """Mean severity weight, at most 1.  Non-object items count in the divisor only."""
    objects = F.filter(findings, lambda i: _kind(i).startswith("OBJECT"))
    total = F.aggregate(objects, F.lit(0.0), lambda acc, i: acc + T.lookup(
        F.coalesce(_get(i, "$.severity", "string"), F.lit("MEDIUM")), R.SEVERITY_WEIGHT,
        R.SEVERITY_WEIGHT_OTHER))
    return F.when(F.size(findings) > 0, F.least(total / F.size(findings), F.lit(1.0))).otherwise(F.lit(0.0))


def finding_reasoning(findings: Column, claimed: Column) -> Column:
    """``[rule] Line n: description`` parts joined by ``; ``."""
    objects = F.filter(findings, lambda i: _kind(i).startswith("OBJECT"))

    def part(i: Column) -> Column:
        line = _get(i, "$.line_number", "int")
        where = F.when(line.isNotNull() & (line != 0),
                       F.concat(F.lit("Line "), line.cast("string"), F.lit(": "))).otherwise("")
        return F.concat(F.lit("["), F.coalesce(_get(i, "$.rule_id", "string"), F.lit(DEFAULT_RULE_ID)),
                        F.lit("] "), where,
                        F.coalesce(_get(i, "$.description", "string"), F.lit(DEFAULT_DESCRIPTION)))
    text = F.array_join(F.transform(objects, part), "; ")
    return (F.when(~claimed, "No security violations detected.")
            .when(text != "", text).otherwise("Security violations detected."))


def finding_verdicts(responses: DataFrame) -> DataFrame:
    """One verdict for every response in findings schema; ``override`` gives one for every other."""
    f, claimed = F.col("findings"), F.col("claimed")
    return with_findings(responses).select(
        "response_id", "path", F.when(claimed, "REJECT").otherwise("ACCEPT").alias("verdict"),
        finding_score(f).alias("score"), finding_reasoning(f, claimed).alias("reasoning"))


# --- override ladder (flow schema) --------------------------------------------------------------------

def literal_expression(expression: Column) -> Column:
    """The reported source expression is itself a quoted literal."""
    e = F.trim(expression)
    return (e.startswith('"') | e.startswith("'") | e.contains('= "') | e.contains("= '"))


LITERAL_LINE = r"^\s*(?:[A-Za-z_][A-Za-z0-9_]*\s*=|return)\s*(?:\"[^\"]*\"|'[^']*')\s*$"


def literal_lines(files: DataFrame) -> DataFrame:
    """(path, line_no) of the lines that assign or return a string literal; an index of places without texts."""
    able = files.where(F.col("code").rlike(f"(?m){LITERAL_LINE}"))
    return T.explode_lines(able, "path").where(F.col("line").rlike(LITERAL_LINE)).select("path", "line_no").distinct()


# Texts of forced verdicts by what was found, in the order they are tried.  The reason is the same
# word, but a missing source line counts as an incomplete chain.
FORCED_TEXT = {
    "malformed_json_schema": "Audit Truncated - Malformed JSON schema.",
    "malformed_cot_schema": "Audit Truncated - Missing mandatory CoT fields.",
    "incomplete_chain": "Violation rejected: Incomplete data flow chain.",
    "missing_source_line": "Violation rejected: Missing source line number.",
    "literal_string_source": "Violation rejected: Source at line {} is a literal string.",
    "proximity_argument_detected": "Violation rejected: Proximity/Co-location is not evidence of a violation.",
}


def override(responses: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Verdict of flow-schema responses: unsupported REJECTs are turned to ACCEPT, with the reason.

    ``files(path, code)`` adds the check of the reported line; without it only the reported
    expression is checked.  Responses in findings schema are left out (``finding_verdicts``).
    """
    p = parsed(responses).where(_get(F.col("v"), "$.findings", "variant").isNull())
    v = F.col("v")
    step = F.coalesce(_get(v, "$.data_flow_logic.step_1_source[0]", "variant"),
                      F.when(_kind(_get(v, "$.data_flow_logic.step_1_source", "variant"))
                             .startswith("OBJECT"),
                             _get(v, "$.data_flow_logic.step_1_source", "variant")))
    p = p.select(
        "response_id", "path", "raw", "v",
        F.upper(F.coalesce(_get(v, "$.verdict", "string"), F.lit("ACCEPT"))).alias("_verdict"),
        F.coalesce(_get(v, "$.rejection_reason", "string"), F.lit("")).alias("_why"),
        F.coalesce(_holds(_get(v, "$.chain_complete", "variant")), F.lit(False)).alias("_chain"),
        _get(v, "$.sinks_scanned", "array<variant>").alias("_sinks"),
        _get(step, "$.line", "int").alias("_line"), _get(step, "$.line", "string").alias("_told"),
        F.coalesce(_kind(_get(step, "$.line", "variant")) == "VOID", F.lit(True)).alias("_lineless"),
        F.coalesce(_get(step, "$.expression", "string"), F.lit("")).alias("_expr"))
    if files is None:
        p = p.withColumn("_literal", F.lit(False))
    else:
        places = literal_lines(files).select(F.col("path").alias("_path"), "line_no", F.lit(True).alias("_at"))
        p = p.join(places, (F.col("path") == F.col("_path")) & (F.col("_line") == F.col("line_no")), "left").withColumn(
            "_literal", F.coalesce("_at", F.lit(False)))
    v = F.col("v")
    missing = T.any_of([_get(v, f"$.{k}", "variant").isNull()
                        for k in ("data_flow_logic", "chain_complete", "verdict", "confidence")]
                       + [F.is_variant_null(_get(v, "$.data_flow_logic", "variant"))])
    reject = F.col("_verdict") == "REJECT"
    confirmed = F.coalesce(F.exists("_sinks", lambda s: F.coalesce(
        _get(s, "$.verdict", "string") == "VIOLATION", F.lit(False))), F.lit(False))
    cites_line = F.lower("_why").contains("line") | F.col("_why").contains("L")
    literal = literal_expression(F.col("_expr")) | F.col("_literal")
    own = F.when(F.col("_why") != "", F.col("_why")).otherwise(
        F.trim(F.substring_index("raw", "{", 1)))
    p = p.withColumn("_said", F.lower(F.concat(own, F.lit(" "),
                                               F.coalesce(json_block(F.col("raw")), F.lit("")))))
    reason = (F.when(v.isNull(), "malformed_json_schema").when(missing, "malformed_cot_schema")
              .when(reject & ~F.col("_chain") & ~confirmed & ~cites_line, "incomplete_chain")
              .when(reject & F.col("_lineless"), "missing_source_line")
              .when(reject & literal, "literal_string_source")
              .when(reject & T.contains_any("_said", R.PROXIMITY_WORDS), "proximity_argument_detected"))
    p = T.computed_once(p, "_found", reason)
    forced = T.lookup(F.col("_found"), FORCED_TEXT, "")
    p = p.withColumn("override_reason", F.when(F.col("_found") == "missing_source_line", "incomplete_chain")
                     .otherwise(F.col("_found")))
    verdict = F.when(F.col("override_reason").isNotNull(), "ACCEPT").otherwise(F.col("_verdict"))
    return p.select(
        "response_id", "path", verdict.alias("verdict"),
        F.when(verdict == "REJECT", 1.0).otherwise(0.0).alias("score"), "override_reason",
        F.when(F.col("override_reason").isNotNull(),
               F.replace(forced, F.lit("{}"), F.coalesce("_told", F.lit(""))))
        .otherwise(own).alias("reasoning"))


def override_log(overridden: DataFrame, at: Column) -> DataFrame:
    """Log rows of forced verdicts (timestamp, override_reason, response_id, triggered_verdict)."""
    return overridden.where("override_reason IS NOT NULL").select(
        at.alias("timestamp"), "override_reason", "response_id", F.col("verdict").alias("triggered_verdict"))


def override_frequency(log: DataFrame) -> DataFrame:
    """Forced verdicts per reason and day."""
    return log.groupBy("override_reason", F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("n_overrides"))


# --- line checks -----------------------------------------------------------------------------------

def check_lines(found: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``valid_line``: the reported line exists in the file (rows are kept, to count misses)."""
    sizes = files.select("path", T.line_count(F.col("code")).alias("n_lines"))
    ok = F.col("line_number").between(1, F.col("n_lines"))
    return found.join(sizes, "path", "left").withColumn("valid_line", F.coalesce(ok, F.lit(False)))


def repair_lines(found: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``fixed_line``: the reported line if it holds the snippet, else the snippet's first line,
    else the reported line.  ``found`` has line_number and snippet."""
    snippet = F.trim(F.regexp_replace("snippet", r"^[0-9]+\s*\|\s*", ""))
    j = found.join(files.select("path", F.col("code").alias("_code")), "path", "left").withColumn("_s", snippet)
    reported = F.get(T.split_lines(F.col("_code")), F.col("line_number") - 1)
    here = F.coalesce((F.col("line_number") >= 1) & F.trim(reported).contains(F.col("_s")), F.lit(False))
    at = F.expr("locate(_s, _code)")
    line = F.size(T.split_lines(F.substring(F.col("_code"), F.lit(1), at - 1)))
    fixed = (F.when((F.col("_s") == "") | F.col("snippet").isNull() | here, F.col("line_number"))
             .when(at > 0, line).otherwise(F.col("line_number")))
    return j.withColumn("fixed_line", fixed).select(*found.columns, "fixed_line")


# --- consistency of eight-field answers -----------------------------------------------------------

FIELDS = ("pattern_detected", "user_controlled_input", "uses_shell", "argument_type",
          "exploitability", "severity", "confidence", "reasoning")
SAFE_PATTERN_WORDS = ("none", "no pattern", "no risk", "safe", "no issues")


def _field(v: Column, name: str, kind: str) -> Column:
    """A field of an answer.  Flags are read by what counts as true, numbers only from JSON numbers."""
    raw = _get(v, f"$.{name}", "variant")
    if kind == "boolean":
        return _holds(raw)
    value = _get(v, f"$.{name}", kind)
    return F.when(~_kind(raw).isin("STRING", "BOOLEAN"), value) if kind == "double" else value


def checked(responses: DataFrame) -> DataFrame:
    """Consistency of eight-field answers: fields, ``errors array<string>``, corrected severity and
    confidence.  Rules are tested on the answer as given; a later rule's severity wins."""
    v = F.col("v")
    p = parsed(responses).where("v IS NOT NULL").select(
        "response_id", "path", "v", *[
            _field(v, k, t).alias(k) for k, t in zip(FIELDS, (
                "string", "boolean", "boolean", "string", "string", "string", "double", "string"))])
    absent = T.compact(F.array(*[
        F.when(_get(v, f"$.{k}", "variant").isNull(), F.lit(f"Missing required field: {k}"))
        for k in FIELDS]))
    sev = F.coalesce("severity", F.lit(""))
    no_input = ~F.coalesce("user_controlled_input", F.lit(False)) & (sev == "CRITICAL")
    listed = (~F.coalesce("uses_shell", F.lit(False)) & (F.coalesce("argument_type", F.lit("")) == "list")
              & sev.isin(*R.REJECT_SEVERITIES))
    harmless = (F.coalesce("exploitability", F.lit("")) == "none") & (sev != "NONE")
    quiet = T.contains_any(
        "lower(coalesce(pattern_detected, ''))", SAFE_PATTERN_WORDS) & (
        sev != "NONE")
    unsure = ~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False))
    logic = T.compact(F.array(
        F.when(no_input, "Logical error: No user input but CRITICAL severity"),
        F.when(listed, "Logical error: Safe subprocess usage but high severity"),
        F.when(harmless, "Logical error: No exploitability but non-zero severity"),
        F.when(quiet, "Logical error: No pattern detected but non-zero severity"),
        F.when(unsure, "Invalid confidence value (must be 0.0-1.0)")))
    complete = F.size(absent) == 0
    fixed = F.when(complete, F.when(quiet | harmless, "NONE").when(listed, "LOW").when(no_input, "HIGH"))
    p = T.computed_once(p, "errors", F.when(complete, logic).otherwise(absent))
    return p.select(
        "response_id", "path", *FIELDS, "errors",
        F.coalesce(fixed, F.col("severity")).alias("corrected_severity"),
        F.when(complete & unsure, 0.5).otherwise(F.col("confidence")).alias("corrected_confidence"))


def to_verdict(rows: DataFrame) -> DataFrame:
    """Eight-field answers as verdict records: action, score, number of violations, confidence."""
    sev = F.coalesce("severity", F.lit("NONE"))
    reject = sev.isin(*R.REJECT_SEVERITIES)
    return rows.select(
        "response_id", "path", F.when(reject, "REJECT").otherwise("ACCEPT").alias("action"),
        T.lookup(sev, R.SEVERITY_SCORE, 0.0).alias("drift_score"),
        F.when(reject, 1).otherwise(0).alias("n_violations"),
        F.when(reject, F.lit("V2_ANALYSIS")).alias("rule_id"), F.when(reject, 1).alias("line_number"),
        F.when(reject, F.coalesce("pattern_detected", F.lit("Security violation detected"))).alias("violation"),
        F.when(reject, F.when(F.coalesce("confidence", F.lit(0.0)) > 0.7, "HIGH").otherwise("LOW"))
        .alias("confidence"),
        F.coalesce("reasoning", F.lit("V2 analysis completed")).alias("reasoning"))


STRICT_REMINDER = "Your previous answer broke the constraints of the output schema. Answer again."


def retries(rows: DataFrame, reminder: str = STRICT_REMINDER) -> DataFrame:
    """Follow-up requests for inconsistent answers: the reminder and what was wrong."""
    return rows.where(F.size("errors") > 0).select(
        "response_id", "path", F.size("errors").alias("n_errors"),
        F.concat(F.lit(reminder + "\n\n"), F.array_join("errors", "\n")).alias("prompt"))


# --- broken rules -------------------------------------------------------------------------------------

def broken_rules(responses: DataFrame) -> DataFrame:
    """``broken_rules`` items, given as text or object, as finding rows."""
    v = F.col("v")
    rows = parsed(responses).select(
        "response_id", "path",
        F.posexplode(_get(v, "$.broken_rules", "array<variant>")).alias("pos", "i"))
    i = F.col("i")
    text = F.when(_kind(i) == "STRING", _get(i, "$", "string"))
    default = F.concat(F.lit("DRIFT-00"), (F.col("pos") + 1).cast("string"))
    said = F.regexp_extract(text, r"(?i)(Rule \d+)", 1)
    line = _get(i, "$.line_number", "int")
    return rows.select(
        "response_id", "path", F.col("pos").alias("seq"), F.lit("HIGH").alias("severity"),
        F.lit("Architectural Drift").alias("vulnerability_type"),
        F.when(text.isNotNull(), F.when(said != "", said).otherwise(default))
        .otherwise(F.coalesce(F.when(_get(i, "$.rule_id", "string") != "", _get(i, "$.rule_id", "string")),
                              default)).alias("rule_id"),
        F.when(text.isNull() & (line != 0), line).alias("line_number"),
        F.coalesce(text, F.when(_get(i, "$.description", "string") != "", _get(i, "$.description", "string")),
                   F.lit("Architectural rule violation detected")).alias("description"))


# --- citations in reasoning text --------------------------------------------------------------------

CITED = (r"(?i)\[source:(?:RULE\s*#?(\d+)\s*(?:\(([^)]+)\))?|SYSTEM_RULES?)\]\s*[—-]\s*"
         r"[\"']?([^\"'\n]+)[\"']?")
NAMED = r"(?i)(?:Rule\s*#?(\d+)[:\s]+([A-Z_]+)|violates?\s+[\"']?([^\"'\n.]+)[\"']?)"


def _groups(text: Column, pattern: str) -> Column:
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), g) for g in (1, 2, 3)])


def citations(notes: DataFrame) -> DataFrame:
    """Rule citations of a reasoning text: ``notes(response_id, project, path, reasoning)``.

    Bracketed citations; only where a text has none, named rules.
    """
    r = F.col("reasoning")
    both = notes.select("response_id", "project", "path", _groups(r, CITED).alias("_a"),
                        _groups(r, NAMED).alias("_b"))
    first = F.size("_a") > 0
    rows = both.select("response_id", "project", "path", first.alias("_cited"),
                       F.posexplode(F.when(first, F.col("_a")).otherwise(F.col("_b"))).alias("seq", "m"))
    num, name, what = (F.trim(F.col("m")[g]) for g in ("0", "1", "2"))
    rule_id = F.when(num != "", F.concat(F.lit("#"), num)).otherwise(
        F.when(F.col("_cited"), "SYSTEM_RULES").otherwise(""))
    return rows.select("response_id", "project", "path", "seq", rule_id.alias("rule_id"),
                       num.alias("rule_num"), name.alias("rule_name"), what.alias("violation")).where(
        (F.col("rule_id") != "") | (F.col("violation") != ""))


def rule_locations(rules_docs: DataFrame) -> DataFrame:
    """First line of a rules text that holds ``Rule n`` or ``Rule #n``: (project, rule_num, location_line).

    A line with "Rule 12" also holds "Rule 1", so every prefix of a rule's digits is a key.
    """
    lines = T.explode_lines(rules_docs, "project", text="rules")
    digits = F.regexp_extract_all("line", F.lit(r"Rule #?(\d+)"), 1)
    keys = F.flatten(F.transform(digits, lambda d: F.transform(
        F.sequence(F.lit(1), F.length(d)), lambda n: F.substring(d, F.lit(1), n))))
    return (lines.select("project", "line_no", F.explode(F.array_distinct(keys)).alias("rule_num"))
            .groupBy("project", "rule_num").agg(F.min("line_no").alias("location_line")))


def locate_rules(cited: DataFrame, rules_docs: DataFrame) -> DataFrame:
    """Citations with the line of their rule in the project's rules text."""
    return cited.join(rule_locations(rules_docs), ["project", "rule_num"], "left")


def locate_code(cited: DataFrame, files: DataFrame, chars: int = 30) -> DataFrame:
    """Add ``line_number``: a leading ``n |`` of the cited text, else the first line holding the whole cited
    text, else that holding its first ``chars`` characters, else 0."""
    said = F.regexp_extract("violation", r"^(\d+)\s*\|\s*", 1)
    piece = F.regexp_replace("violation", r"^\d+\s*\|\s*", "")
    j = (cited.withColumns({"_said": said, "_piece": piece})
         .join(files.select("path", F.col("code").alias("_code")), "path", "left"))
    at = F.when(F.col("_piece") != "", F.expr(
        f"coalesce(nullif(locate(_piece, _code), 0), locate(substring(_piece, 1, {chars}), _code))")).otherwise(0)
    found = F.size(T.split_lines(F.substring(F.col("_code"), F.lit(1), at - 1)))
    return j.withColumn("line_number", F.when(F.col("_said") != "", F.col("_said").cast("int"))
                        .when(at > 0, found).otherwise(0)).drop("_said", "_piece", "_code")


def unique_citations(cited: DataFrame, limit: int = 5) -> DataFrame:
    """First citation per (response, rule, text) with its ``rank``; ``within_limit`` marks the first ``limit``.

    Both steps work on the citations of one response, whose number its text bounds.
    """
    columns = [c for c in cited.columns if c != "response_id"]
    first = (cited.groupBy("response_id", "rule_id", F.col("violation").alias("_k"))
             .agg(F.min_by(F.struct(*columns), F.col("seq")).alias("r"), F.min("seq").alias("_s")))
    kept = first.groupBy("response_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_s"), F.col("r")))).alias("l"))
    return kept.select("response_id", F.posexplode("l").alias("rank", "x")).select(
        "response_id", (F.col("rank") + 1).alias("rank"), (F.col("rank") < limit).alias("within_limit"), "x.r.*")


# --- tagged sections, commands, tags --------------------------------------------------------------------

def tagged_sections(notes: DataFrame) -> DataFrame:
    """Three tagged sections of an analysis text: counts of ``-`` lines; NONE gives 0.

    ``notes(response_id, analysis)``.
    """
    a = F.col("analysis")

    def section(start: str, stop: str | None) -> Column:
        body = F.regexp_extract(a, rf"(?s)\[{start}\](.*)$", 1)
        if stop is not None:
            body = F.element_at(F.split(body, rf"\[{stop}\]"), 1)
        return F.trim(body)

    def count(body: Column) -> Column:
        bullets = F.filter(T.split_lines(body), lambda x: F.ltrim(x).startswith("-"))
        return F.when(body.isNotNull() & (body != "") & ~F.upper(body).contains("NONE"),
                      F.size(bullets)).otherwise(0)
    patterns = F.when(a.contains("[RESOLVED_PATTERNS]") & a.contains("[NEGATIVE_RULES]"),
                      section("RESOLVED_PATTERNS", "NEGATIVE_RULES"))
    rules = F.when(a.contains("[NEGATIVE_RULES]"), section("NEGATIVE_RULES", "LESSONS_LEARNED"))
    lessons = F.when(a.contains("[LESSONS_LEARNED]"), section("LESSONS_LEARNED", None))
    return notes.select("response_id", count(patterns).alias("patterns_added"),
                        count(rules).alias("rules_added"), count(lessons).alias("lessons_added"))


def append_commands(notes: DataFrame) -> DataFrame:
    """``APPEND_TO_FILE`` blocks of an actions section: (response_id, seq, file, content)."""
    section = F.regexp_extract("analysis", r"(?s)\[(?:AI_ASSISTANT_ACTIONS|ACTIONS)\](.*?)(?:\[|$)", 1)
    blocks = F.slice(F.split(section, r"APPEND_TO_FILE:[ \t]*"), 2, 2_000_000_000)
    rows = notes.select("response_id", F.posexplode(blocks).alias("seq", "b"))
    shape = r"(?s)^([^\n]+)\nCONTENT:[ \t]*\|?[ \t]*\n(.*)$"
    return rows.where(F.col("b").rlike(shape)).select(
        "response_id", (F.col("seq") + 1).alias("seq"), F.trim(F.regexp_extract("b", shape, 1)).alias("file"),
        F.regexp_replace(F.regexp_extract("b", shape, 2), r"^\s+|\s+$", "").alias("content"))


# Word lists and score limits of the event tags.
TAG_WORDS = {
    "rule_violation": ("violates", "breaks", "forbidden", "not allowed", "against rule"),
    "error": ("error", "failed", "doesn't work", "broken", "issue", "problem"),
    "pattern_followed": ("follows pattern", "correct approach", "good practice", "recommended",
                         "aligns with"),
}


def event_tags(verdicts: DataFrame) -> DataFrame:
    """Derived note rows: ``verdicts(response_id, verdict, score, reasoning)`` -> (response_id, tag, file)."""
    low = "lower(reasoning)"
    tags = F.array(
        F.when((F.col("verdict") == "REJECT") & (F.col("score") >= 0.40)
               & T.contains_any(low, TAG_WORDS["rule_violation"]),
               F.struct(F.lit("rule_violation").alias("tag"),
                        F.lit("problems_and_resolutions.md").alias("file"))),
        F.when(T.contains_any(low, TAG_WORDS["error"]),
               F.struct(F.lit("error").alias("tag"), F.lit("problems_and_resolutions.md").alias("file"))),
        F.when((F.col("verdict") == "ACCEPT") & (F.col("score") <= 0.15)
               & T.contains_any(low, TAG_WORDS["pattern_followed"]),
               F.struct(F.lit("pattern_followed").alias("tag"), F.lit("history_phases.md").alias("file"))))
    return verdicts.select("response_id", F.explode(T.compact(tags)).alias("t")).select("response_id", "t.*")
