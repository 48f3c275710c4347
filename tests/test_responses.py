import json

import pytest
from pyspark.sql import functions as F

from auditloom.operators import responses as P

RAW = "response_id bigint, path string, raw string"


def one(rows, raw):
    return rows(RAW, (1, "a.py", raw))


def flow_raw(**change):
    base = {"data_flow_logic": {"step_1_source": {"line": 1, "expression": "req.body"}}, "chain_complete": True,
            "verdict": "REJECT", "confidence": "HIGH", "rejection_reason": "line 1 leaks"}
    base.update(change)
    return "Thought. " + json.dumps({k: v for k, v in base.items() if v != "DROP"})


@pytest.mark.parametrize("raw,reason,verdict", [
    (flow_raw(), None, "REJECT"),
    ("no json here", "malformed_json_schema", "ACCEPT"),
    ('{"a": 1} trailing }', "malformed_json_schema", "ACCEPT"),
    ('[{"a": 1}, {"b": 2}]', "malformed_json_schema", "ACCEPT"),
    ("{}", "malformed_json_schema", "ACCEPT"),
    (flow_raw(confidence="DROP"), "malformed_cot_schema", "ACCEPT"),
    (flow_raw(data_flow_logic=None), "malformed_cot_schema", "ACCEPT"),
    (flow_raw(chain_complete=False, rejection_reason="bad"), "incomplete_chain", "ACCEPT"),
    (flow_raw(chain_complete=False), None, "REJECT"),
    (flow_raw(chain_complete=False, rejection_reason="bad", sinks_scanned=[{"verdict": "VIOLATION"}]), None, "REJECT"),
    (flow_raw(data_flow_logic={"step_1_source": {"expression": "x"}}), "incomplete_chain", "ACCEPT"),
    (flow_raw(data_flow_logic={"step_1_source": []}), "incomplete_chain", "ACCEPT"),
    (flow_raw(data_flow_logic={"step_1_source": {"line": "three"}}), None, "REJECT"),
    (flow_raw(rejection_reason="").replace("Thought.", "They are nearby."), "proximity_argument_detected", "ACCEPT"),
    (flow_raw(chain_complete="false", rejection_reason="bad"), None, "REJECT"),
    (flow_raw(data_flow_logic={"step_1_source": [{"line": 1, "expression": "n = 'x'"}]}), "literal_string_source", "ACCEPT"),
    (flow_raw(rejection_reason="line 1 is nearby"), "proximity_argument_detected", "ACCEPT"),
    (flow_raw(verdict="accept", rejection_reason="nearby"), None, "ACCEPT")])
def test_override_ladder(rows, raw, reason, verdict):
    row = P.override(one(rows, raw)).first()
    assert (row.override_reason, row.verdict) == (reason, verdict)
    assert row.score == (1.0 if verdict == "REJECT" else 0.0)


def test_literal_line(rows):
    files = rows("path string, code string", ("a.py", "name = 'John'\nname = req.body"))
    one_row = lambda n: P.override(one(rows, flow_raw(data_flow_logic={"step_1_source": {"line": n}})), files).first()
    assert one_row(1).override_reason == "literal_string_source"
    assert one_row(2).override_reason is None
    assert one_row(0).override_reason is None


@pytest.mark.parametrize("findings,verdict,score", [
    (None, "ACCEPT", 0.0), ("", "ACCEPT", 0.0), ([], "ACCEPT", 0.0), ({}, "ACCEPT", 0.0), ("eval in line 3", "REJECT", 0.0),
    ({"severity": "HIGH"}, "REJECT", 0.0), (["x"], "REJECT", 0.0), ([{"severity": "HIGH"}], "REJECT", 0.75)])
def test_every_response_has_one_verdict(rows, findings, verdict, score):
    given = one(rows, json.dumps({"findings": findings}))
    got = P.finding_verdicts(given).collect()
    assert [(r.verdict, r.score) for r in got] == [(verdict, score)]
    assert P.override(given).count() == 0


def test_types_of_eight_fields(rows):
    base = {"pattern_detected": "x", "user_controlled_input": "false", "uses_shell": True, "argument_type": "list",
            "exploitability": "real", "severity": "CRITICAL", "confidence": "0.9", "reasoning": "r"}
    row = P.checked(one(rows, json.dumps(base))).first()
    assert row.errors == ["Invalid confidence value (must be 0.0-1.0)"] and row.corrected_confidence == 0.5


SHAPES = [
    ('{"findings": [{"is_vulnerable": true}, {"is_vulnerable": "true"}, "x", {"is_vulnerable": false}]}', "findings", 1),
    ('{"findings": []}', "empty", 0), ('[{"is_vulnerable": true, "severity": "low"}, {"is_vulnerable": true}]', "root_array", 2),
    ('{"findings": "[{\\"is_vulnerable\\": true}]"}', "findings_text", 1),
    ('{"is_vulnerable": true, "findings": "none"}', "single", 1), ('{"is_vulnerable": false}', "single", 0),
    ('{"findings": 3}', "empty", 0), ("oops", "unreadable", 0), ('{"a": 1} {"b": 2}', "unreadable", 0)]


@pytest.mark.parametrize("raw,shape,n", SHAPES)
def test_shapes(rows, raw, shape, n):
    items = P.finding_items(one(rows, raw))
    row = P.actions(items).first()
    assert (row["shape"], row.n_findings, row.action) == (shape, n, "REJECT" if n else "ACCEPT")
    got = P.confirmed_findings(items).collect()
    assert len(got) == n
    if shape == "root_array":
        assert [r.severity for r in got] == ["LOW", "UNKNOWN"]
        assert got[0].description == "No description provided."


def test_score_and_reasoning(rows):
    raw = json.dumps({"findings": [{"severity": "CRITICAL", "rule_id": "R1", "line_number": 3, "description": "d"},
                                   {"severity": "odd"}, {"line_number": 0}, "text"]})
    row = P.finding_verdicts(one(rows, raw)).first()
    assert row.score == pytest.approx((1.0 + 0.5 + 0.5) / 4)
    assert row.reasoning == ("[R1] Line 3: d; [Built-in Taint Analysis] Security issue; "
                             "[Built-in Taint Analysis] Security issue")
    v = P.violations(one(rows, raw)).orderBy("seq").collect()
    assert [(r.rule_id, r.severity, r.line_number) for r in v] == [
        ("R1", "CRITICAL", 3), ("Built-in Taint Analysis", "odd", 0), ("Built-in Taint Analysis", "MEDIUM", 0)]
    empty = P.finding_verdicts(one(rows, '{"findings": []}')).first()
    assert (empty.verdict, empty.score) == ("ACCEPT", 0.0)


def test_lenient_and_quarantine(rows):
    df = rows(RAW, (1, "a", '```json\n{"action": "REJECT", "confidence": 0.5}\n```'), (2, "b", "garbage"))
    got = {r.response_id: r for r in P.lenient(df).collect()}
    assert (got[1].action, got[1].confidence, got[1].parse_error) == ("REJECT", 0.5, False)
    assert (got[2].action, got[2].pattern_detected, got[2].parse_error) == ("ACCEPT", "parse_error", True)
    assert [r.response_id for r in P.quarantine(df).collect()] == [2]


def eight(**change):
    base = dict(pattern_detected="shell call", user_controlled_input=True, uses_shell=True, argument_type="string",
                exploitability="real", severity="HIGH", confidence=0.9, reasoning="r")
    base.update(change)
    return json.dumps({k: v for k, v in base.items() if v != "DROP"})


@pytest.mark.parametrize("change,n,severity,confidence", [
    ({}, 0, "HIGH", 0.9), (dict(user_controlled_input=False, severity="CRITICAL"), 1, "HIGH", 0.9),
    (dict(uses_shell=False, argument_type="list"), 1, "LOW", 0.9), (dict(exploitability="none"), 1, "NONE", 0.9),
    (dict(pattern_detected="No issues"), 1, "NONE", 0.9), (dict(confidence=2), 1, "HIGH", 0.5),
    (dict(confidence="high"), 1, "HIGH", 0.5), (dict(severity="DROP", reasoning="DROP"), 2, None, 0.9),
    (dict(uses_shell=False, argument_type="list", severity="CRITICAL", user_controlled_input=False), 2, "LOW", 0.9)])
def test_consistency(rows, change, n, severity, confidence):
    checked = P.checked(one(rows, eight(**change)))
    row = checked.first()
    assert (len(row.errors), row.corrected_severity) == (n, severity)
    assert row.corrected_confidence == confidence
    assert P.retries(checked).count() == (1 if n else 0)


def test_to_verdict(rows):
    row = P.to_verdict(P.checked(one(rows, eight(confidence=0.6)))).first()
    assert (row.action, row.drift_score, row.n_violations, row.confidence) == ("REJECT", 0.8, 1, "LOW")


def test_line_checks(rows):
    files = rows("path string, code string", ("a", "one\n  two three\nfour\n"))
    found = rows("path string, line_number int, snippet string", ("a", 2, "two"), ("a", 1, "3 | four"), ("a", 9, "absent"),
                 ("a", 3, ""), ("a", 0, "one"))
    got = [(r.line_number, r.fixed_line) for r in P.repair_lines(found, files).collect()]
    assert sorted(got) == [(0, 1), (1, 3), (2, 2), (3, 3), (9, 9)]
    ok = {r.line_number: r.valid_line for r in P.check_lines(found, files).collect()}
    assert ok == {2: True, 1: True, 9: False, 3: True, 0: False}


def test_broken_rules(rows):
    raw = json.dumps({"broken_rules": ["rule 12 broken", "nothing", {"rule_id": "R", "line_number": 4}, {"description": "d"}]})
    got = [(r.rule_id, r.line_number, r.description) for r in P.broken_rules(one(rows, raw)).orderBy("seq").collect()]
    assert got == [("rule 12", None, "rule 12 broken"), ("DRIFT-002", None, "nothing"),
                   ("R", 4, "Architectural rule violation detected"), ("DRIFT-004", None, "d")]


def test_citations(rows):
    notes = rows("response_id bigint, project string, path string, reasoning string",
                 (1, "p", "a", '[source:RULE #2 (NAME)] — "x = 1" and [source:SYSTEM_RULES] - y'),
                 (2, "p", "a", "Rule 3: EVAL and violates the contract. Rule 3: EVAL"), (3, "p", "a", "fine"))
    cited = P.citations(notes)
    got = {(r.response_id, r.rule_id, r.rule_name, r.violation) for r in cited.collect()}
    assert got == {(1, "#2", "NAME", "x = 1"), (1, "SYSTEM_RULES", "", "y"), (2, "#3", "EVAL", ""),
                   (2, "", "", "the contract")}
    rules = rows("project string, rules string", ("p", "a\nRule 31: x\nRule #2: y\nRule 2: z"))
    placed = {(r.rule_id, r.location_line) for r in P.locate_rules(cited, rules).collect()}
    assert {("#2", 3), ("#3", 2), ("", None)} <= placed
    files = rows("path string, code string", ("a", "q\nx = 12\nz"))
    lines = {(r.violation, r.line_number) for r in P.locate_code(cited, files).collect()}
    assert {("x = 1", 2), ("y", 0), ("", 0)} <= lines
    assert P.unique_citations(cited).where("response_id = 2").count() == 2
    many = rows("response_id bigint, rule_id string, violation string, seq int",
                *[(1, f"#{i}", "v", i) for i in range(9)])
    ranked = P.unique_citations(many).orderBy("rank").collect()
    assert [(r.rule_id, r.within_limit) for r in ranked] == [(f"#{i}", i < 5) for i in range(9)]


def test_sections_and_commands(rows):
    text = "[RESOLVED_PATTERNS]\n- a\n - b\nx\n[NEGATIVE_RULES]\nNONE\n[LESSONS_LEARNED]\n- c"
    act = "[ACTIONS]\nAPPEND_TO_FILE: a.md\nCONTENT: |\nl1\nl2\n\nAPPEND_TO_FILE: b.md\nCONTENT:\nz\n[END]"
    notes = rows("response_id bigint, analysis string", (1, text), (2, act))
    got = {r.response_id: tuple(r)[1:] for r in P.tagged_sections(notes).collect()}
    assert got == {1: (2, 0, 1), 2: (0, 0, 0)}
    cmds = [(r.file, r.content) for r in P.append_commands(notes).orderBy("seq").collect()]
    assert cmds == [("a.md", "l1\nl2"), ("b.md", "z")]


def test_event_tags(rows):
    df = rows("response_id bigint, verdict string, score double, reasoning string", (1, "REJECT", 0.4, "It VIOLATES and failed"),
              (2, "REJECT", 0.39, "violates"), (3, "ACCEPT", 0.15, "good practice"), (4, "ACCEPT", 0.2, "good practice"))
    got = {(r.response_id, r.tag) for r in P.event_tags(df).collect()}
    assert got == {(1, "rule_violation"), (1, "error"), (3, "pattern_followed")}


def test_frequency(rows):
    done = P.override(rows(RAW, (1, "a", "x"), (2, "a", "y"), (3, "a", flow_raw())))
    log = P.override_log(done, F.lit("2024-01-01 10:00:00").cast("timestamp"))
    assert [(r.override_reason, r.n_overrides) for r in P.override_frequency(log).collect()] == [("malformed_json_schema", 2)]
