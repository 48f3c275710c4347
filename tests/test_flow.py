import random
import re

import pytest

from auditloom.functions import logical
from auditloom.operators import flow
from auditloom.sources import config

FILES = "path string, ext string, code string"


@pytest.fixture(scope="module")
def relations(rows):
    files = rows(
        FILES,
        ("source.py", ".py", "user_name = req.body['name']"),
        ("literal.py", ".py", "user_name = 'John Doe'"),
        ("chain.py", ".py", "v1 = request.args['x']\nv2 = v1\nv3 = v2\nv4 = v3\nv5 = v4"),
        ("sink.py", ".py", "v1 = request.args['x']\nv2 = redact(v1)\nlogger.info(v2)"),
        ("leak.js", ".js", "const name = req.body.name;\nconsole.log(name);"),
        ("safe.js", ".js", "const name = req.body.name;\nconst n = sanitize(name);\nconsole.log(n);"),
        ("twice.js", ".js", "const a = req.body.x;\nconst a = req.query.y;"),
        ("fstring.py", ".py", 'm = f"hi {name}"\np = "a %s" % b\nq = hashlib.md5(z)'),
        ("loop.py", ".py", "a = input[0]\nb = a\na = b"),
        ("query.sql", ".sql", "x = req.body"))
    found = flow.relations(files)
    return files, found, flow.reach(found)


def found(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_sources(relations):
    got = found(relations[1].sources, "path", "variable", "line_no", "node_type")
    assert ("source.py", "user_name", 1, "EXTERNAL_INPUT") in got
    assert ("fstring.py", "m", 1, "F_STRING_TEMPLATE") in got
    assert ("fstring.py", "p", 2, "FORMAT_OPERATOR") in got
    assert ("twice.js", "a", 1, "EXTERNAL_INPUT") in got
    assert not {x for x in got if x[0] in ("literal.py", "query.sql") or x[1] == "q"}
    assert ("sink.py", "v2", 2, "EXTERNAL_INPUT") not in got
    assert sum(x[0] == "twice.js" for x in got) == 1


def test_depth(relations):
    _, own, reached = relations
    got = found(flow.boundary_hits(reached), "path", "trace_boundary_reached")
    assert ("chain.py", True) in got and ("sink.py", False) in got
    bounded = flow.reach(own, 3)
    assert found(bounded.where("path = 'chain.py' AND root = 'v1'"), "variable", "depth") == {
        ("v1", 0), ("v2", 1), ("v3", 2), ("v4", 3)}
    assert found(reached.where("path = 'chain.py' AND root = 'v1'"), "variable", "depth") == {
        (f"v{i + 1}", i) for i in range(5)}
    assert found(reached.where("path = 'loop.py' AND root = 'a'"), "variable", "depth") == {("a", 0), ("b", 1)}


def test_chain_of_fifty(rows):
    chain = "v0 = request.args['x']\n" + "".join(f"v{i + 1} = v{i}\n" for i in range(50)) + "print(v50)\n"
    own = flow.relations(rows(FILES, ("long.py", ".py", chain)))
    assert found(flow.unsanitised(own), "variable", "line_number", "sink_line") == {("v0", 1, 52)}
    assert not found(flow.unsanitised(own, 4), "variable")
    assert found(flow.reach(own, 9), "variable", "depth") == {(f"v{i}", i) for i in range(10)}


def test_sink_ends_propagation(relations):
    _, own, reached = relations
    assert found(flow.sink_hits(own, reached).where("path = 'sink.py'"), "variable", "line_no", "sink_name") == {
        ("v1", 2, "redact")}
    assert not found(flow.propagation(own, reached).where("path = 'sink.py' AND variable = 'v1'"), "to")


def test_propagation(relations):
    _, own, reached = relations
    got = found(flow.propagation(own, flow.reach(own, 3), 3).where("path = 'chain.py'"), "variable", "line_no", "to")
    assert got == {("v1", 2, "v2"), ("v2", 3, "v3"), ("v3", 4, "v4")}
    assert found(flow.propagation(own, reached).where("path = 'chain.py'"), "variable", "line_no", "to") == got | {
        ("v4", 5, "v5")}


def test_unsafe_output(relations):
    own = relations[1]
    assert ("leak.js", "name", 2) in found(flow.output_edges(own), "path", "variable", "line_no")
    leaks = found(flow.unsanitised(own), "path", "variable", "line_number", "sink_line")
    assert leaks == {("leak.js", "name", 1, 2)}


def test_verdicts_and_questions(relations):
    files, own, reached = relations
    leaks = flow.unsanitised(own)
    got = found(flow.file_verdicts(own.sources, leaks), "path", "verdict", "details")
    assert ("leak.js", "REJECT", "Layer 2 found 1 violation(s) across 1 source(s).") in got
    assert ("safe.js", "ACCEPT", "Layer 2 cleared 1 source(s). No violations confirmed.") in got
    q = flow.source_questions(files, own.sources, flow.propagation(own, reached), flow.sink_hits(own, reached))
    row = q.where("path = 'safe.js'").first()
    assert row.sink_status == "  Line 2: hits registered sink sanitize - SAFE"
    assert row.propagation == "  No propagation detected"
    assert row.code_head.startswith("const name") and q.count() == own.sources.count()


def test_order_of_statements(rows):
    own = flow.relations(rows(
        FILES,
        ("before.py", ".py", "x = request.args['a']\nprint(x)\nx = redact(x)\nprint(x)"),
        ("after.py", ".py", "x = request.args['a']\nx = redact(x)\nprint(x)"),
        ("anew.py", ".py", "x = request.args['a']\nx = 1\nprint(x)"),
        ("copy.py", ".py", "x = request.args['a']\ny = x\nx = redact(x)\nprint(x)\nprint(y)"),
        ("again.js", ".js", "let a = 1;\nconsole.log(a);\na = req.query.b;\nlet c = sanitize(a);\na = req.body.d;\nres.send(a);"),
        ("same.py", ".py", "x = request.args['a']\nx = x + 1\nprint(x)")))
    got = found(flow.unsanitised(own), "path", "variable", "line_number", "sink_line")
    assert got == {("before.py", "x", 1, 2), ("copy.py", "x", 1, 5), ("again.js", "a", 5, 6), ("same.py", "x", 1, 3)}


def interpreted(program):
    """(root line, first line of output) of every source of a straight program, by running it line by line."""
    held, leaks = {}, {}
    for n, (kind, target, used) in enumerate(program, 1):
        own = set().union(*(held.get(v, set()) for v in used)) if used else set()
        if kind == "print":
            for root in own:
                leaks.setdefault(root, n)
        elif kind == "source":
            held[target] = {(target, n)}
        else:
            held[target] = own if kind == "copy" else set()
    return {(v, n, out) for (v, n), out in leaks.items()}


def test_flow_against_an_interpreter(rows):
    rng = random.Random(5)
    programs = {}
    for k in range(120):
        program = []
        for _ in range(rng.randint(3, 25)):
            kind = rng.choice(["source", "copy", "copy", "copy", "clean", "literal", "print"])
            names = rng.sample("abcdefg", rng.randint(1, 2))
            program.append((kind, rng.choice("abcdefg"), names if kind in ("copy", "clean", "print") else []))
        programs[f"p{k}.py"] = program
    shapes = {"source": "{t} = request.args['{t}']", "copy": "{t} = {u}", "clean": "{t} = redact({u})", "literal": "{t} = 3",
              "print": "print({u})"}
    files = rows(FILES, *[(path, ".py", "\n".join(
        shapes[kind].format(t=t, u=(", " if kind in ("clean", "print") else " + ").join(used)) for kind, t, used in program))
        for path, program in programs.items()])
    got = found(flow.unsanitised(flow.relations(files)), "path", "variable", "line_number", "sink_line")
    assert got == {(path, *leak) for path, program in programs.items() for leak in interpreted(program)} and len(got) > 30


STATEMENTS = [
    ("python", "a = f(\n    1,\n    [2,\n     3])\nb = 2", [(1, "a = f( 1, [2, 3])"), (5, "b = 2")]),
    ("python", "x = {\n 'a': '(',  # open (\n}\n\ny = 1 + \\\n  2\n", [(1, "x = { 'a': '(',  # open ( }"), (5, "y = 1 + 2")]),
    ("python", 's = """one (\ntwo"""\nt = 3', [(1, 's = """one ( two"""'), (3, "t = 3")]),
    ("javascript", "app.get('/x', (req, res) => {\n  const n = req.body.n;\n  res.send(n);\n});\nf(\n a)",
     [(1, "app.get('/x', (req, res) => {"), (2, "const n = req.body.n;"), (3, "res.send(n);"), (4, "});"), (5, "f( a)")]),
    ("javascript", "const q = `a (\n b`; // (\n/* ( \n [ */ let z = [\n1]", [(1, "const q = `a ( b`; // ("), (3, "/* ( [ */ let z = [ 1]")]),
    ("python", "print('never closed'\nx = 1\n)]\ny = (2", [(1, "print('never closed' x = 1 )]"), (4, "y = (2")]),
    ("go", "a := 1\n\n  b := 2  \n", [(1, "a := 1"), (3, "b := 2")]), ("python", "", []), ("python", "\n\n", [])]


@pytest.mark.parametrize("language, code, want", STATEMENTS)
def test_logical_statements(language, code, want):
    assert logical.statements(code, language) == want


def test_unpaired_brackets_join_nothing():
    code = "\n".join(f"x{i} = ({i}" for i in range(3000))
    assert logical.statements(code, "python") == [(i + 1, f"x{i} = ({i}") for i in range(3000)]


def test_statements_over_lines(rows):
    own = flow.relations(rows(
        FILES, ("wide.py", ".py", "name = request.get(\n    'a (b',\n    default=None)\nprint(\n    name\n)\n"
                                  "name = redact(\n    name)\nprint(name)"),
        ("wide.js", ".js", "const all = [\n  1,\n  req.query.id\n];\nres.json(\n  all\n);")))
    assert found(own.sources, "path", "variable", "line_no") == {("wide.py", "name", 1), ("wide.js", "all", 1)}
    assert found(flow.unsanitised(own), "path", "line_number", "sink_line") == {("wide.py", 1, 4), ("wide.js", 1, 5)}
    assert ("wide.py", "name", 7, "redact") in found(flow.sink_hits(own, flow.reach(own)), "path", "variable", "line_no", "sink_name")


def test_no_text_in_the_exchanges_of_flow(rows):
    own = flow.relations(rows(FILES, ("a.py", ".py", "x = request.args['a']\nprint(x)")))
    plan = flow.reaching(own)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not re.search(r"\b(line|code|expression)#", plan)


def test_sink_config(spark, rows):
    configs = rows("config string", ('{"middleware": ["myClean"], "decorators": ["@my_decorator"], "patterns": ["audit_log"]}',),
                   ("{broken",))
    table = config.sink_table(spark, configs)
    got = found(table, "kind", "value")
    assert {("middleware", "myClean"), ("decorators", "my_decorator"), ("patterns", "audit_log"),
            ("middleware", "redact")} <= got
    registry = flow.SinkRegistry.from_rows(table.collect())
    files = rows(FILES, ("a.py", ".py", "v = req.args['x']\nw = myClean(v)\nprint(v)"))
    stmts = flow.statements(files, registry)
    assert found(stmts, "line_no", "sink") == {(1, None), (2, "myClean"), (3, None)}
    assert config.sink_table(spark, rows("config string", ("nope",))).count() == config.default_sinks(spark).count()


def test_whole_audit(rows):
    from auditloom.plans import audits
    files = rows(FILES, ("secret.py", ".py", "password = 'longenough1' # in code"),
                 ("leak.js", ".js", "const name = req.body.name;\nconsole.log(name);"),
                 ("asked.py", ".py", "x = 1\ny = 2"), ("clean.py", ".py", "x = 1"))
    answers = rows("response_id bigint, path string, raw string",
                   (1, "asked.py", '{"findings": [{"is_vulnerable": true, "severity": "high", "line_number": 2},'
                                   ' {"is_vulnerable": true, "line_number": 9}]}'),
                   (2, "secret.py", '{"findings": [{"is_vulnerable": true, "line_number": 1}]}'))
    got = {r.path: (r.verdict, r.n_violations, r.reasoning.split("]")[0]) for r in audits.audit(files, answers).collect()}
    assert got == {"secret.py": ("REJECT", 1, "[Layer1"), "leak.js": ("REJECT", 1, "[Layer1 + Layer2"),
                   "asked.py": ("REJECT", 1, "[Layer1 + V1.0"), "clean.py": ("ACCEPT", 0, "[Layer1")}
    scan = audits.scan_folder(files.withColumn("code", files.code), "sys", profile=audits.R.LOCAL)
    assert {r.path for r in scan.queue.collect()} == {"secret.py", "leak.js"}
    assert scan.requests.count() == 2
    assert {r.reason for r in scan.skipped.collect()} == {"File too small (< 20 chars)"}


def test_calls_and_subscripts(rows):
    files = rows(FILES, ("r.py", ".py", "a = request.get_json()['b']\nc = foo(a) + bar(b)\nd = foo(bar(1), (2, 3))\n"
                         + "x" * 50 + " = read(a)"))
    got = found(flow.sources(flow.statements(files)), "variable", "node_type")
    assert got == {("a", "EXTERNAL_INPUT"), ("d", "EXTERNAL_INPUT"), ("x" * 50, "EXTERNAL_INPUT")}


@pytest.mark.parametrize("max_depth", [None, 2])
def test_closure_in_the_row_equals_joins(rows, monkeypatch, max_depth):
    """Short files are closed in their row, long ones by joins, mixed files by both: the same rows, no shuffled rounds."""
    rand = random.Random(5)
    name = lambda: f"v{rand.randrange(12)}"
    steps = rows("path string, variable string, next_variable string", *[
        (f"p{rand.randrange(4)}", name(), name()) for _ in range(60)], *[("long", f"v{i}", f"v{i + 1}") for i in range(30)])
    seeds = rows("path string, root string, variable string", *[(f"p{i}", v, v) for i in range(5) for v in ("v1", "v2")],
                 ("long", "v0", "v0"))
    made = []
    for closed in (10_000, 25, 0):
        monkeypatch.setattr(flow, "CLOSED", closed)
        out = flow.closure(seeds, steps, ["root"], ["variable"], max_depth)
        made.append(sorted(map(tuple, out.collect())))
    assert made[0] == made[1] == made[2] and (max_depth or ("long", "v0", "v30", 30) in made[0])
    by_joins = sorted(map(tuple, flow._closure_by_joins(seeds, steps, ["root"], ["variable"], max_depth).collect()))
    assert by_joins == made[0]


def test_sources_are_parsed_once(rows, monkeypatch):
    parsed = []
    real = flow.materialise
    monkeypatch.setattr(flow, "materialise", lambda df, purpose: parsed.append(
        df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")) or real(df, purpose))
    found = flow.sources(flow.statements(rows(FILES, ("a.py", ".py", "x = request.args['a']"), ("b.js", ".js", "let y = req.query.id;"))))
    assert parsed == [1] and "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 2


def test_closure_meets_seeds_and_steps_in_one_shuffle(rows):
    seeds = rows("path string, root string, variable string", ("p", "a", "a"), ("p", "a", "a"))
    steps = rows("path string, variable string, next_variable string", ("p", "a", "b"), ("p", "a", "b"), ("q", "a", "b"))
    out = flow.closure(seeds, steps, ["root"], ["variable"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    assert sorted(map(tuple, out.collect())) == [("p", "a", "a", 0), ("p", "a", "b", 1)]


def test_files_are_followed_in_their_row(rows, monkeypatch):
    """Nothing of a file is shuffled to be followed; long files and rows of one path meet in joins, with the same result."""
    chain = "v0 = request.args['x']\n" + "".join(f"v{i + 1} = v{i}\n" for i in range(9)) + "print(v9)\n"
    files = rows(FILES, *[(f"{k}.py", ".py", chain) for k in range(3)], ("a.js", ".js", "let b = req.query.id;\nlet c = b;\nres.send(c);"),
                 ("two.py", ".py", "x = request.args['a']"), ("two.py", ".py", "\ny = x\nprint(y)"))
    made = []
    for closed in (2_000, 12, 0):
        monkeypatch.setattr(flow, "CLOSED", closed)
        own = flow.relations(files)
        made.append([sorted(map(str, df.collect())) for df in (
            flow.reach(own), flow.unsanitised(own), flow.reaching(own), flow.sink_hits(own, flow.reach(own)))])
    assert made[0] == made[1] == made[2] and any("two.py" in r for r in made[0][1])
    monkeypatch.setattr(flow, "CLOSED", 2_000)
    once = flow.relations(files.where("path <> 'two.py'"))
    for followed in (flow.reach(once), flow.unsanitised(once)):
        assert "Exchange" not in followed._jdf.queryExecution().executedPlan().toString()
    plan = flow.statements(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1


def test_pairs_of_brackets_within_a_line():
    assert logical.statements('f(["""a\n(b"""])\nx = {"a": (1)}', "python") == [(1, 'f(["""a (b"""])'), (3, 'x = {"a": (1)}')]
    assert logical.statements("f(a // (\n)\ng('(')", "javascript") == [(1, "f(a // ( )"), (3, "g('(')")]


@pytest.mark.parametrize("max_depth", [None, 2])
def test_traces_equal_relations(rows, monkeypatch, max_depth):
    """What is followed is written without texts, and files are told in their row; the results are those of relations."""
    chain = "v0 = request.args['x']\n" + "".join(f"v{i + 1} = v{i} + v0\n" for i in range(9)) + "print(redact(v9))\nv2 = redact(v1)\n"
    files = rows(FILES, *[(f"{k}.py", ".py", chain) for k in range(3)], ("none.py", ".py", "print(1)"), ("null.py", ".py", None),
                 ("a.js", ".js", "let b = req.query.id;\nlet c = b;\nif (a == c) {\nsanitize(c);\n}\nlet s = \"c = d\";"),
                 ("loop.py", ".py", "a = input[0]\nb = a\na = b\nx = 1\nclean(f'{x} {b}')"), ("query.sql", ".sql", "x = req.body"),
                 ("two.py", ".py", "x = request.args['a']"), ("two.py", ".py", "\ny = x\nredact(y)"))
    listed = lambda *frames: [sorted(map(tuple, df.collect())) for df in frames]
    for closed in (2_000, 12, 0):
        monkeypatch.setattr(flow, "CLOSED", closed)
        own = flow.relations(files)
        reached = flow.reach(own, max_depth)
        want = listed(reached, flow.boundary_hits(reached), flow.sink_hits(own, reached, max_depth))
        assert all(want) and ("two.py", "y", 3, "redact") in want[2]
        found = flow.traces(files, met=True)
        assert listed(flow.trace(flow.traces(files), max_depth), flow.trace_boundary(found, max_depth=max_depth),
                      flow.trace_sink_hits(found, max_depth)) == want
    monkeypatch.setattr(flow, "CLOSED", 2_000)
    once = flow.traces(files.where("path <> 'two.py'"), met=True)
    assert {"st", "line", "code"}.isdisjoint(once.files.columns)
    for df in (flow.trace(once), flow.trace_boundary(once), flow.trace_sink_hits(once)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_audit_is_told_in_one_pass(rows, monkeypatch):
    """An audit parses and screens once, in one written table; nothing but its hashes of paths is shuffled, and files of one
    path or of many entries have the verdicts of files followed in their row."""
    from auditloom.plans import audits
    chain = "v0 = request.args['x']\n" + "".join(f"v{i + 1} = v{i}\n" for i in range(9)) + "print(v9)\nv9 = redact(v9)\nprint(v9)\n"
    files = rows(FILES, *[(f"{k}.py", ".py", chain) for k in range(3)], ("safe.js", ".js", "let a = req.query.id;\na = sanitize(a);\nres.send(a);"),
                 ("two.py", ".py", "x = request.args['a']"), ("two.py", ".py", "\ny = x\nprint(y)"), ("none.md", ".md", "x"),
                 ("null.py", ".py", None), ("secret.py", ".py", "password = 'longenough1' # in code"))
    answers = rows("response_id bigint, path string, raw string", *[
        (k, path, '{"findings": [{"is_vulnerable": true, "line_number": 1}, {"is_vulnerable": true, "line_number": 9}]}')
        for k, path in enumerate(("safe.js", "safe.js", "0.py", "none.md", "secret.py", "gone.py"))], (9, "null.py", "no json"))
    found, real = [], flow.materialise
    monkeypatch.setattr(flow, "materialise", lambda df, purpose: found.append(
        (purpose, df._jdf.queryExecution().executedPlan().toString())) or real(df, purpose))
    made = []
    for closed in (2_000, 12):
        monkeypatch.setattr(flow, "CLOSED", closed)
        made.append([sorted(map(tuple, audits.audit(files, told).collect())) for told in (None, answers)])
        want = sorted((r.path, r.line_number, r.rule_id) for r in flow.unsanitised(flow.relations(files.where("path <> 'secret.py'"))).collect())
        got = audits.layered_findings(files).where("source_layer = 'Layer 2'")
        assert sorted((r.path, r.line_number, r.rule_id) for r in got.collect()) == want
    assert made[0] == made[1]
    plain, answered = ({r[0]: (r[1], r[3], r[4]) for r in rows_} for rows_ in made[0])
    assert len(made[0][0]) == len(made[0][1]) == 9
    assert plain["0.py"] == ("REJECT", 1, "[Layer1 + Layer2] 1 violation(s) found. Most severe: L2-DATA-FLOW on line 1.")
    assert plain["two.py"][:2] == ("REJECT", 1) and plain["null.py"] == ("ACCEPT", 0, "[Layer1] All layers cleared. No violations found.")
    assert answered["safe.js"] == ("REJECT", 1, "[Layer1 + Layer2 + V1.0] 1 violation(s) found. Most severe: Unknown Vulnerability on line 1.")
    assert answered["none.md"][:2] == ("REJECT", 1) and answered["null.py"][2].startswith("[Layer1 + V1.0] All")
    assert answered["0.py"] == plain["0.py"] and answered["secret.py"] == plain["secret.py"]
    monkeypatch.setattr(flow, "CLOSED", 2_000)
    found.clear()
    verdicts = audits.audit(files.where("path <> 'two.py'"))
    assert [purpose for purpose, _ in found] == ["leaks", "flow-apart"] and found[0][1].count("MapInArrow") == 1
    for plan in (found[0][1], verdicts._jdf.queryExecution().executedPlan().toString()):
        assert "Exchange" not in plan
