import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditloom import rules as R
from auditloom.functions import text as T
from auditloom.operators import declared as D
from auditloom.operators import screen as S
from auditloom.plans import bindings as B

FILES = "path string, ext string, code string"


@pytest.fixture(scope="module")
def files(rows):
    return rows(
        FILES,
        ("a.py", ".py", 'api_key = "sk-abc123secretkey999"'),
        ("b.py", ".py", "result = eval(request.body)"),
        ("c.py", ".py", "subprocess.run(cmd, shell=True)"),
        ("d.py", ".py", 'result = eval("2 + 2")'),
        ("e.py", ".py", 'name = "John Doe"'),
        ("f.py", ".py", 'password = "hunter2hunter2"\nsubprocess.run(c, shell=True)\nprint(1)'),
        ("x/tests/g.py", ".py", "x" * 30),
        ("theme.py", ".py", "x" * 30),
        ("h.json", ".json", "x" * 30))


def test_verdicts(files):
    got = {r.path: r for r in S.screen_verdicts(files).collect()}
    verdicts = {p: (r.verdict, r.n_violations) for p, r in got.items()}
    assert verdicts == {"a.py": ("REJECT", 1), "b.py": ("REJECT", 1), "c.py": ("REJECT", 1), "d.py": ("ACCEPT", 0),
                        "e.py": ("ACCEPT", 0), "f.py": ("REJECT", 2), "x/tests/g.py": ("ACCEPT", 0),
                        "theme.py": ("ACCEPT", 0), "h.json": ("ACCEPT", 0)}
    assert got["e.py"].details == "Layer 1 ACCEPT: File too small (< 20 chars)"
    assert got["x/tests/g.py"].details.endswith("Hard skip: test_dir")
    assert got["theme.py"].details.endswith("Hard skip: css in filename")
    assert got["h.json"].details.endswith("Non-executable file type")


def test_finding_lines(files):
    got = {(r.path, r.rule_id, r.line_number) for r in S.screen_findings(files).collect()}
    assert {x for x in got if x[0] == "f.py"} == {("f.py", "L1-SECRET", 1), ("f.py", "L1-EXPLOIT", 2)}
    assert ("b.py", "L1-EXPLOIT", 1) in got


def score_of(profile, code):
    return max(0, sum(r.weight * len(re.findall(r.pattern, code)) for r in profile.rules))


SNIPPETS = ["os.system(", "subprocess.run(x, shell=True)", "eval(req.body)", "http", "Request", "request.json",
            "req.body validate", "req.body ", "password = 'longenough'", "AWS_SECRET", "style", "innerHTML", "<H1", "html =",
            "yaml.load(", "pickle.loads(", "debug = True", "Debug=True", "mutex", "XMLParser", "cors", "window.location",
            "a\n", "f\"\"\"x<", "random.", "Math.random", "bearer ab-c", "execute (", "path.join", "token=\"12345678\"",
            "éopen(", "open (", "GraphQL", "__proto__", "RegExp", "stripe", "merge", "class=\"", "exec_command", " "]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(SNIPPETS), max_size=12).map(" ".join), min_size=1, max_size=30))
def test_scores_equal_plain_regex(spark, codes):
    """The literal prefilter never changes a count; look-ahead rules included."""
    df = spark.createDataFrame(list(enumerate(codes)), "i int, code string")
    for profile in R.PROFILES.values():
        got = {r.i: r.risk_score for r in S.risk_score(df, profile).collect()}
        assert got == {i: score_of(profile, c) for i, c in enumerate(codes)}


def test_needles_are_necessary():
    for profile in R.PROFILES.values():
        for rule in profile.rules:
            for s in SNIPPETS:
                if re.search(rule.pattern, s):
                    assert not rule.needles or any(n in s.lower() for n in rule.needles), (rule.name, s)
                    assert all(m in s for m in rule.must), (rule.name, s)


def test_lookahead_rules(rows):
    df = rows("path string, code string", ("1", "d = request.json"), ("2", "d = request.json; validate(d)"),
              ("3", "b = req.body\nvalidate(b)"), ("4", "joi.check(1) req.body joi"))
    hits = {(r.path, r.rule) for r in S.rule_hits(df, R.LOCAL.rules).collect() if r.rule in R.LOOKAHEAD_RULES}
    assert hits == {("1", "unvalidated_request_json"), ("3", "unvalidated_req_body")}


@pytest.mark.parametrize("glob,path,hit", [
    ("**/node_modules/**", "a/node_modules/b.js", True), ("**/node_modules/**", "node_modules/b.js", False),
    ("**/*.md", "a/b/c.md", True), ("**/*.md", "a/b/cxmd", False), ("*.py", "a.py", True), ("*.py", "a/b.py", False)])
def test_globs(spark, glob, path, hit):
    assert bool(re.match(T.glob_regex(glob), path)) is hit
    df = spark.createDataFrame([(path,)], "path string")
    assert S.drop_globs(df, [glob]).count() == (0 if hit else 1)


def test_text_shapes(rows):
    df = rows("code string", ("# a\n  # b\nx = 1  # c\n",))
    out = df.select(S.blank_comments(F.col("code")).alias("b"), T.numbered(F.col("code")).alias("n"),
                    T.line_count(F.col("code")).alias("c")).first()
    assert out.b == "\n\nx = 1  # c\n"
    assert out.n == "1 | # a\n2 |   # b\n3 | x = 1  # c\n4 | "
    assert out.c == 3
    crlf = rows("t string", ("a\r\nb\rc\n",)).select(T.unify_newlines(F.col("t"))).first()[0]
    assert crlf == "a\nb\nc\n"


def test_strip_keys(rows):
    text = '{\n  "editor.fontSize" : 3,\n  "editorXfontSize": 4,\n  "keep": 1\n}'
    got = rows("c string", (text,)).select(S.strip_keys(F.col("c"))).first()[0]
    assert got == '{\n  "editorXfontSize": 4,\n  "keep": 1\n}'


@pytest.mark.parametrize("code,want", [
    ("const x = req.query.c; spawn(x, [])", "CRITICAL"), ("const x = req.query.c; spawn('ls', [x])", "HIGH"),
    ("spawn('ls', ['-l'])", "SAFE"), ("exec(`ls ${dir}`, {shell: true})", "CRITICAL"), ("eval(userInput)", "CRITICAL"),
    ("eval('1+1')", "SAFE"), ("spawn(req.body.x)", "CRITICAL"), ("x = params.a; env = {LD_PRELOAD: x}", "CRITICAL")])
def test_exploitability(rows, code, want):
    assert rows("c string", (code,)).select(S.exploitability(F.col("c"))).first()[0] == want


def test_gate_bypass(rows, files):
    gated = S.gate(files.withColumn("project", F.when(F.col("path") == "e.py", "p1").otherwise("p2")), R.CLOUD)
    out = S.gate_with_project_rules(gated, rows("project string, rules string", ("p1", "no print"), ("p2", "")))
    got = {r.path: (r.should_audit, r.reason, r.risk_score) for r in out.collect()}
    assert got["e.py"] == (True, "Context-Aware Override", 1)
    assert got["a.py"] == (False, "File too small (< 100 chars)", 0)


def test_gate_of_marked_files(spark, rows, files, tmp_path):
    """Files of projects with their own rules pass before their texts are read or made; the rest as in two steps."""
    rules = rows("project string, rules string", ("p1", "no print"), ("p2", ""), ("p4", None))
    project = F.concat(F.lit("p"), (F.pmod(F.hash("path"), F.lit(4)) + 1).cast("string"))
    owned = files.withColumn("project", project).join(
        S.projects_with_rules(rules).withColumn("own", F.lit(True)), "project", "left").withColumn("own", F.col("own").isNotNull())
    columns = ("project", "path", "should_audit", "reason", "risk_score")
    want = S.gate_with_project_rules(S.gate(owned, R.CLOUD), rules).select(*columns)
    unread = owned.withColumn("code", F.when(~F.col("own"), F.col("code")))
    for got in (S.gate(owned, R.CLOUD, own="own"), S.gate(unread, R.CLOUD, own="own")):
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.collect()))
    rows("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string", *[
        (i, 7 + i % 3, "FOP"[i % 3], "1-URGENT") for i in range(6)]).write.parquet(f"{tmp_path}/orders.parquet")
    marked = B.marked_code_files(spark, str(tmp_path), rows("project string", ("cust7",))).collect()
    assert [(r.project == "cust7", r.own, r.code is None) for r in marked].count((True, True, True)) == 2
    plain = {r.path: r.code for r in B.bind(spark, str(tmp_path), "code_files").collect()}
    assert all(r.code == plain[r.path] for r in marked if not r.own) and len(marked) == len(plain) == 6


def test_function_metrics(rows):
    body = "def f(a):\n    if a:\n        if b:\n            if c:\n                if d:\n                    x\n"
    long = "def g():\n" + "    y = 1\n" * 60
    got = {r.function: r for r in D.function_metrics(rows(FILES, ("a.py", ".py", body + long))).collect()}
    assert (got["f"].max_depth, got["f"].too_deep, got["f"].too_long) == (4, True, False)
    assert (got["g"].n_lines, got["g"].too_long, got["g"].too_deep) == (62, True, False)


def test_nested_functions(rows):
    code = ("x = 1\ndef outer(a):\n    def inner(b):\n        return b\n\n    async def second():\n        if a:\n            pass\n"
            "    return inner\ny = 2\ndef last(): pass")
    got = sorted((r.start_line, r.function, r.n_lines, r.max_depth) for r in D.function_metrics(
        rows(FILES, ("a.py", ".py", code), ("none.py", ".py", "x = 1"), ("null.py", ".py", None))).collect())
    assert got == [(2, "outer", 8, 2), (3, "inner", 3, 0), (6, "second", 3, 1), (11, "last", 1, 0)]
    plan = D.function_metrics(rows(FILES, ("a.py", ".py", code)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_size_split(rows):
    out = S.size_split(rows("path string, code string", ("a", "x" * 2048), ("b", "é" * 600)), max_kb=1)
    assert {r.path: r.skip_reason for r in out.collect()} == {
        "a": "File too large (2.0KB)", "b": "File too large (1.2KB)"}


def test_size_ties_go_to_the_even_digit(rows):
    """17.25 KB and 17.75 KB, as Python and C print them; Java's format takes both up."""
    out = S.size_split(rows("path string, code string", ("a", "x" * 17664), ("b", "x" * 18176), ("c", "x" * 17665)), max_kb=16)
    assert {r.path: r.skip_reason for r in out.collect()} == {
        p: f"File too large ({n / 1024:.1f}KB)" for p, n in (("a", 17664), ("b", 18176), ("c", 17665))}


def test_score_is_computed_once(spark, rows, files):
    """A filter on the gate must not copy the score expression below the projection."""
    plan = S.gate(files, R.LOCAL).where("should_audit")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= len(R.LOCAL.rules)
