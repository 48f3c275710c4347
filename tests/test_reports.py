import datetime as dt
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditloom.operators import evaluate as E
from auditloom.operators import memory as M
from auditloom.operators import merge as G
from auditloom.operators import snapshots as N
from auditloom.functions.containment import containing
from auditloom.functions.twolevel import range_sums, running_sums, with_previous

FOUND = "path string, line_number int, rule_id string, severity string, violation string, seq string"


def layers(rows):
    one = rows(FOUND, ("a", 1, "L1-SECRET", "CRITICAL", "s", "1"))
    two = rows(FOUND, ("a", 5, "L2-DATA-FLOW", "HIGH", "d", "1"))
    model = rows(FOUND, ("a", 5, "M", "HIGH", "same line", "1"), ("a", 7, "M", "LOW", "first", "1"),
                 ("a", 7, "M", "MEDIUM", "again", "2"), ("b", None, "M", "MEDIUM", "no line", "1"),
                 ("b", None, "M", "MEDIUM", "no line 2", "2"))
    return G.union_layers(("Layer 1", one), ("Layer 2", two), ("V1.0", model))


def test_merge(rows):
    kept = G.drop_repeated_model(layers(rows))
    got = [(r.path, r.line_number, r.rule_id, r.violation) for r in G.by_severity(kept).collect()]
    assert got == [("a", 1, "L1-SECRET", "s"), ("a", 5, "L2-DATA-FLOW", "d"), ("a", 7, "M", "first"),
                   ("b", None, "M", "no line")]
    again = G.drop_repeated_model(kept)
    assert again.exceptAll(kept).count() == 0 and kept.exceptAll(again).count() == 0
    verdicts = {r.path: r for r in G.file_verdicts(rows("path string", ("a",), ("b",), ("c",)), kept).collect()}
    assert verdicts["a"].reasoning == "[Layer 1 + Layer 2 + V1.0] 3 violation(s) found. Most severe: L1-SECRET on line 1."
    assert (verdicts["b"].drift_score, verdicts["c"].verdict, verdicts["c"].drift_score) == (1.0, "ACCEPT", 0.0)
    assert verdicts["b"].reasoning.endswith("on line None.")
    assert {r.path for r in G.next_stage(rows("path string", ("a",), ("c",)), kept).collect()} == {"c"}


def test_merge_of_many_copies(spark, rows):
    """A third of all model rows on one line: one is kept, whole result otherwise."""
    hot = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'p' || id END AS path", "1 AS line_number",
                                       "'M' AS rule_id", "'HIGH' AS severity", "'v' AS violation",
                                       "lpad(string(id), 8, '0') AS seq")
    none = spark.createDataFrame([], FOUND)
    kept = G.drop_repeated_model(G.union_layers(("Layer 1", none), ("Layer 2", none), ("V1.0", hot)))
    assert kept.count() == 2001
    assert kept.where("path = 'hot'").first().seq == "00000000"


def test_small_pieces(rows):
    df = rows("s string", ("CRITICAL",), ("HIGH",), ("MEDIUM",), ("LOW",), (None,))
    assert [r[0] for r in df.select(G.severity_rank(F.col("s"))).collect()] == [0, 1, 2, 1, 1]
    bands = rows("x double", (0.29,), (0.3,), (0.6,)).select(G.score_band(F.col("x"))).collect()
    assert [b[0] for b in bands] == ["healthy", "warning", "critical"]
    void = rows("v string, x double, a array<string>", ("ACCEPT", 0.05, ["q"]), ("ACCEPT", 0.1, ["q"]), ("REJECT", 0.0, ["q"]))
    assert [r[0] for r in void.select(G.strip_void(F.col("v"), F.col("x"), F.col("a"))).collect()] == [[], ["q"], ["q"]]


@pytest.fixture(scope="module")
def results(rows):
    cases = [("FP1", "ACCEPT", "REJECT", "ACCEPT", "ACCEPT"), ("TP1", "REJECT", "REJECT", "ACCEPT", "REJECT"),
             ("E1", "REJECT", "ACCEPT", "ACCEPT", "REJECT"), ("E2", "ACCEPT", "ACCEPT", "ACCEPT", "REJECT")]
    return rows("version string, case_id string, expected string, verdict string, elapsed double", *[
        (v, c[0], c[1], c[i + 2], [1.0, 2.0, 1.0][i]) for c in cases for i, v in enumerate(("V1", "V2", "V2F"))])


def test_accuracy(results):
    got = {r.version: r for r in E.accuracy_by_slice(results).collect()}
    assert (got["V1"].overall, got["V1"].false_positive_traps, got["V1"].violations, got["V1"].edge_cases) == (50, 50, 50, 50)
    assert (got["V2F"].overall, got["V2F"].edge_cases) == (75, 50)
    wins = E.version_wins(results).first()
    assert (wins.v1_wins, wins.v2_wins, wins.v3_wins) == (0, 1, 1)
    speed = E.version_speed(results).first()
    assert (speed.c1, speed.c2, speed.c3, speed.speedup_pct, speed.winner) == (2, 2, 3, 50.0, "V2_FAST")


def test_confusion(rows):
    truth = rows("case_id int, vulnerable boolean", (1, True), (2, True), (3, False))
    pred = rows("case_id int, flagged boolean", (1, True), (3, True), (4, False))
    r = E.confusion(truth, pred).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.recall, r.precision, r.f1) == (1, 1, 1, 1, 0.5, 0.5, 0.5)


def test_miss_causes(rows):
    truth = rows("path string, vulnerable boolean", *[(p, True) for p in "abcdef"], ("z", False))
    got = {r.path: r.cause for r in E.miss_causes(
        truth, rows("path string", ("a",)), rows("path string, reason string", ("b", "small")),
        rows("path string, status string", ("c", "safe"), ("d", "error"), ("e", "skipped"))).collect()}
    assert got == {"a": "Caught", "b": "Layer 1 Blindspot", "c": "Model False Negative", "d": "Model Error",
                   "e": "Token Limit Skip", "f": "Unknown Status: Unknown"}


def test_agreement(rows):
    df = rows("a string, m string, e string", ("CRITICAL", "CRITICAL", "CRITICAL"), ("CRITICAL", "SAFE", "SAFE"),
              ("SAFE", "HIGH", "SAFE"), ("SAFE", "SAFE", "HIGH"), ("HIGH", "HIGH", "SAFE"))
    c, _ = E.agreement(F.col("a"), F.col("m"), F.col("e"))
    assert [r[0] for r in df.select(c).collect()] == [100, 70, 30, 0, 50]


def test_release_gate(rows):
    cases = rows("tier int, case_id string, passed boolean, severity string", (1, "eval", True, "CRITICAL"), (2, "x", True, "SAFE"))
    hold = F.expr("CASE WHEN case_id = 'eval' THEN severity <> 'SAFE' END")
    assert E.release_gate(cases, hold).first().gate is True
    assert E.release_gate(cases.withColumn("severity", F.lit("SAFE")), hold).first().gate is False


# --- snapshots --------------------------------------------------------------------------------------
DOCS = "project string, name string, content string"


def test_snapshot_status_and_sync(rows):
    live = rows(DOCS, ("p", "done_tasks.md", "a"), ("p", "golden_state.md", "b"), ("p", "history_phases.md", "c"))
    snap = rows(DOCS, ("p", "done_tasks.md", "a"), ("p", "golden_state.md", "B"), ("p", "system_rules.md", "d"))
    got = {r.name: r.status for r in N.snapshot_status(live, snap).collect()}
    assert got == {"done_tasks.md": "IN SYNC", "golden_state.md": "OUT OF SYNC", "history_phases.md": "MISSING IN VAULT",
                   "system_rules.md": "MISSING IN LIVE", "pending_tasks.md": "N/A", "problems_and_resolutions.md": "N/A"}
    synced = N.sync(live, snap)
    after = {r.name: r.status for r in N.snapshot_status(live, synced).collect()}
    assert all(after[n] == "IN SYNC" for n in ("done_tasks.md", "golden_state.md", "history_phases.md"))
    assert N.changed_documents(live, synced).count() == 0 and synced.count() == 4


def test_signature(rows):
    import hashlib
    live = rows(DOCS, ("p", "golden_state.md", "b"), ("p", "done_tasks.md", "a"), ("q", "system_rules.md", "z"))
    sig = {r.project: r.signature for r in N.project_signature(live).collect()}
    assert sig["p"] == hashlib.sha256(b"ab").hexdigest()
    locks = rows("project string, signature string", ("p", "bad"))
    assert {r.project: r.valid for r in N.verify_signatures(live, locks).collect()} == {"p": False, "q": True}


def chunk(rows, now, before):
    return rows("n string, b string", (now, before)).select(N.audit_chunk(F.col("n"), F.col("b"))).first()[0]


def test_audit_chunk(rows):
    old = [f"l{i}" for i in range(1, 301)]
    new = old.copy()
    new[149] = "changed"
    lines = chunk(rows, "\n".join(new), "\n".join(old)).split("\n")
    assert len(lines) == 21 and lines[0] == "140 | l140" and lines[10] == "150 | changed"
    new = old.copy()
    new[1] = "x"
    assert len(chunk(rows, "\n".join(new), "\n".join(old)).split("\n")) == 12
    assert chunk(rows, "a\nb", "a\nb") == ""
    assert chunk(rows, "a\nb", "a\nb\nc") == "1 | a\n2 | b"


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=40),
                          st.lists(st.sampled_from("abc"), min_size=1, max_size=40)), min_size=1, max_size=15))
def test_chunk_holds_changed_lines(spark, pairs):
    df = spark.createDataFrame([(i, "\n".join(a), "\n".join(b)) for i, (a, b) in enumerate(pairs)], "i int, n string, b string")
    for r in df.select("i", N.audit_chunk(F.col("n"), F.col("b"), 2).alias("c")).collect():
        a, b = pairs[r.i]
        want = {j for k in range(max(len(a), len(b))) if (a[k:k + 1] != b[k:k + 1])
                for j in range(max(0, k - 2), min(len(a) - 1, k + 2) + 1)}
        assert r.c == "\n".join(f"{j + 1} | {a[j]}" for j in sorted(want))


def versions(rows, *contents):
    start = dt.datetime(2024, 1, 1)
    return rows("path string, ts timestamp, content string", *[
        ("f", start + dt.timedelta(hours=13 * i), c) for i, c in enumerate(contents)])


def test_version_modes(rows):
    big = "\n".join(f"l{i}" for i in range(250))
    edited = big.replace("l7\n", "L7\n")
    v = versions(rows, big, big, big.replace("l3\n", "  l3\n\n"), edited, "short")
    got = [r.mode for r in N.audit_mode(N.with_history(v)).orderBy("ts").collect()]
    assert got == ["index_only", "skip", "skip", "diff", "full"]
    flags = [(r.unchanged, r.cosmetic) for r in N.skip_flags(v).orderBy("ts").collect()]
    assert flags == [(False, False), (True, False), (False, True), (False, False), (False, False)]
    power = [r.mode for r in N.audit_mode(N.with_history(v), power_mode=True).orderBy("ts").collect()]
    assert power == ["full", "skip", "skip", "full", "full"]


def test_sent_texts_and_changed_lines(rows):
    big = "\n".join(f"l{i}" for i in range(250))
    v = versions(rows, big, big.replace("l7\n", "L7\n"), "short", "short\nand\nlong", "short")
    history, store = N.with_history(v), N.line_store(v)
    assert store.count() == store.dropDuplicates(["path", "hash"]).count() == 254
    sent = [r.sent for r in N.sent_texts(v, N.audit_mode(history), N.audit_chunks(history, store)).orderBy("ts").collect()]
    chunk = "\n".join(f"{i + 1} | {'L7' if i == 7 else f'l{i}'}" for i in range(18))
    assert sent == [None, chunk, "short", "short\nand\nlong", "short"]
    changed = [(r.line_no, r.line, r.prev_line) for r in N.changed_lines(history, store).orderBy("ts", "line_no").collect()]
    assert changed[:3] == [(8, "L7", "l7"), (1, "short", "l0"), (2, None, "l1")]
    assert changed[-4:] == [(2, "and", None), (3, "long", None), (2, None, "and"), (3, None, "long")]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=30), min_size=2, max_size=6))
def test_chunks_of_lists_equal_chunks_of_texts(spark, contents):
    start = dt.datetime(2024, 1, 1)
    data = [("f", start + dt.timedelta(hours=13 * i), "\n".join(c)) for i, c in enumerate(contents)]
    v = spark.createDataFrame(data, "path string, ts timestamp, content string")
    got = {r.ts: r.chunk for r in N.audit_chunks(N.with_history(v), N.line_store(v), 2).collect()}
    pairs = spark.createDataFrame([(data[i][1], data[i][2], data[i - 1][2]) for i in range(1, len(data))],
                                  "ts timestamp, n string, b string")
    want = {r.ts: r.c for r in pairs.select("ts", N.audit_chunk(F.col("n"), F.col("b"), 2).alias("c")).collect() if r.c}
    assert got == want


def exchanged(df):
    """Lines of the plan that tell what an exchange carries."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Scan" in line or "Exchange" in line]


def test_no_content_in_the_exchanges_of_histories(rows):
    v = versions(rows, "a\nb", "a\nc")
    for df in (N.with_history(v), N.audit_mode(N.with_history(v)), N.skip_flags(v)):
        lines = exchanged(df)
        assert lines and not any("content#" in line for line in lines)
    docs = rows(DOCS, ("p", "done_tasks.md", "a"))
    assert not any("content#" in line for line in exchanged(N.changed_keys(docs, docs)))


def test_changed_keys_by_projects(rows):
    live = rows(DOCS, ("p", "a", "1"), ("p", "b", "2"), ("q", "a", "1"), ("q", "b", "x"), ("r", "a", None), ("s", "n", "1"))
    snap = rows(DOCS, ("p", "a", "1"), ("p", "b", "2"), ("q", "a", "1"), ("q", "b", "y"), ("q", "c", "z"), ("s", "n", "1"), ("s", "m", "2"))
    assert {(r.project, r["name"]) for r in N.changed_keys(live, snap).collect()} == {("q", "b"), ("r", "a")}
    assert {(r.project, r["name"], r.content) for r in N.sync(live, snap).collect()} == {
        ("p", "a", "1"), ("p", "b", "2"), ("q", "a", "1"), ("q", "b", "x"), ("q", "c", "z"), ("r", "a", None), ("s", "n", "1"),
        ("s", "m", "2")}


def test_removed_imports(rows):
    diff = "--- a\n-import torch\n-from Cuda import x\n+import keep\n-const m = require('mongodb')\n- import 'redis'\n-import torch"
    got = {r.tech for r in N.removed_imports(rows("path string, diff string", ("a", diff))).collect()}
    # The first pattern is not anchored, so "from Cuda import x" gives both names.
    assert got == {"torch", "cuda", "x", "mongodb", "redis"}


def test_missing_rules(rows):
    df = rows("project string, rules string", ("p", "Rule 7 : a\nrule 9: NO hardcoded secrets, API keys, or passwords"),
              ("q", "## Mandatory Defaults\n"))
    got = [(r.rule_no, r.rule_text[:12]) for r in N.missing_rules(df).orderBy("rule_no").collect()]
    assert [n for n, _ in got] == list(range(10, 16)) and ("The AI must " not in [t for _, t in got])
    flag = rows("c string", ("# h\n\nNo problems yet",), ("# h\nentry",)).select(N.has_history(F.col("c"))).collect()
    assert [r[0] for r in flag] == [False, True]


# --- memory ------------------------------------------------------------------------------------------------

def test_problems_and_pivots(rows):
    text = "intro\n## Problem #1: pytorch fails\n**Status**: UNRESOLVED\n## Problem #2: x\nnone\n## Problem #3: y\n**Status**: RESOLVED"
    notes = rows(DOCS, ("p", "n", text), ("q", "n", text))
    problems = M.problem_blocks(notes)
    assert [(r.seq, r.status) for r in problems.where("project = 'p'").orderBy("seq").collect()] == [
        (1, "UNRESOLVED"), (2, "UNKNOWN"), (3, "RESOLVED")]
    got = M.pivots(rows("project string, tech string", ("p", "torch"), ("p", "redis"), ("z", "torch")), problems).collect()
    assert [(r.project, r.seq, r.tech) for r in got] == [("p", 1, "torch")]
    targets = {r.title: r.target for r in M.route_problems(problems.where("project = 'p'")).collect()}
    assert targets == {"pytorch fails": "negative_rule", "x": "none", "y": "pattern"}
    twice = M.route_problems(problems.withColumn("project", F.lit("p")))
    assert {r.title: r.target for r in twice.collect()}["pytorch fails"] == "urgent_rule"


def test_tasks(rows):
    pending = rows("project string, line_no bigint, line string", ("p", 1, "- fix login"), ("p", 2, "- fix login page"), ("p", 3, "- other"),
                   ("q", 1, "- fix login"))
    now = dt.datetime(2024, 1, 2, 3, 4, 5)
    still, done, errors = M.complete_tasks(pending, rows("project string, task string, ts timestamp", ("p", "fix login", now), ("p", "nope", now)))
    assert {(r.project, r.line_no) for r in still.collect()} == {("p", 3), ("q", 1)}
    assert [r.entry for r in done.collect()] == ["## 2024-01-02 03:04:05\n- fix login"]
    assert [r.message for r in errors.collect()] == ["Task not found: nope"]


def test_containment_of_long_needles(rows):
    line = "the quick brown fox jumps over the lazy dog " * 20
    t = rows("g string, i int, t string", *[("p", i, line + str(i)) for i in range(30)], ("p", 99, "the quick fox"), ("q", 1, line))
    n = rows("g string, n string", ("p", "dog 7"), ("p", "lazy dog the quick"), ("p", "the slow"), ("p", "x"), ("p", "q"), ("q", "fox"),
             ("p", "ck fox"), ("p", None), ("p", ""))
    got = {tuple(r) for r in containing(t, n, ["g"], ["i"], "t", "n").collect()}
    want = {("p", 7, "dog 7"), ("q", 1, "fox"), ("p", 99, "ck fox")} | {
        ("p", i, x) for i in range(30) for x in ("lazy dog the quick", "x", "q")} | {("p", 99, "x"), ("p", 99, "q")}
    assert got == want


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("pq"), st.text("ab", max_size=8)), min_size=1, max_size=12),
       st.lists(st.tuples(st.sampled_from("pq"), st.text("ab", max_size=4)), min_size=1, max_size=8))
def test_containment_equals_brute_force(spark, texts, needles):
    t = spark.createDataFrame([(g, i, x) for i, (g, x) in enumerate(texts)], "g string, i int, t string")
    n = spark.createDataFrame(needles, "g string, n string")
    got = {tuple(r) for r in containing(t, n, ["g"], ["i"], "t", "n").collect()}
    assert got == {(g, i, y) for i, (g, x) in enumerate(texts) for h, y in needles if g == h and y and y in x}


# --- two-level windows ---------------------------------------------------------------------------------------

@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["hot", "hot", "a"]), st.integers(0, 60), st.integers(0, 9)), min_size=1, max_size=40))
def test_two_level_equals_plain_window(spark, data):
    df = spark.createDataFrame([(k, o, i, v) for i, (k, o, v) in enumerate(data)], "k string, o int, i int, v int")
    rank = lambda r: (r[1], r[2])
    ordered = sorted(((k, o, i, v) for i, (k, o, v) in enumerate(data)), key=rank)
    want_sum, want_prev, total, last = {}, {}, {}, {}
    for k, o, i, v in ordered:
        want_prev[i] = last.get(k)
        total[k] = total.get(k, 0) + v
        want_sum[i], last[k] = total[k], v
    bucket = F.floor(F.col("o") / 7)
    sums = running_sums(df, ["k"], [bucket], [F.col("o"), F.col("i")], {"s": F.col("v")})
    assert {r.i: r.s for r in sums.collect()} == want_sum
    ranges = range_sums(df, ["k"], [F.col("o"), F.col("i")], {"s": F.col("v")})
    assert {r.i: r.s for r in ranges.collect()} == want_sum
    prev = with_previous(df, ["k"], bucket, F.struct("o", "i"), ["v"])
    assert {r.i: r.prev_v for r in prev.collect()} == want_prev


def test_range_sums_of_one_key_are_spread(spark):
    """All rows under one key and most under one score: ranges stay even, totals are right."""
    df = spark.range(20_000).selectExpr("'p' AS k", "id AS i", "CASE WHEN id % 5 = 0 THEN id ELSE 7 END AS score", "id % 3 AS v")
    out = range_sums(df, ["k"], [F.desc("score"), F.asc("i")], {"s": F.col("v")})
    rows = sorted(out.collect(), key=lambda r: (-r.score, r.i))
    total = 0
    for r in rows:
        total += r.v
        assert r.s == total
    dealt = df.repartitionByRange(8, "k", F.desc("score"), F.asc("i")).groupBy(F.spark_partition_id()).count().collect()
    sizes = sorted(r["count"] for r in dealt)
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]


def test_grams_are_not_sent_to_the_driver(spark, tmp_path):
    """A small scan makes many grams: no table of them is broadcast, whatever the planner takes it for."""
    spark.range(300).selectExpr("id % 20 AS project", "id AS line_no", "'ship order ' || id AS line").write.parquet(f"{tmp_path}/lines")
    lines = spark.read.parquet(f"{tmp_path}/lines")
    done = lines.where("line_no % 2 = 0").selectExpr("project", "line AS task", "current_timestamp() AS ts")
    still, ready, errors = M.complete_tasks(lines, done)
    for df in (still, ready, errors):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert (ready.count(), errors.count()) == (150, 0)
    assert {r.line_no for r in still.collect()} == {i for i in range(300) if i % 2 and not any(
        str(i).startswith(str(j)) for j in range(i % 20, 300, 20) if j % 2 == 0)}


def test_lines_without_imports_are_not_cut(rows):
    """Texts that can name no import are dropped before they are cut into lines."""
    diffs = rows("path string, diff string", ("a", "-import os\n-x = 1\n-const a = require('fs')"), ("b", "-x = 1\n-y = 2"))
    out = N.removed_imports(diffs)
    assert {tuple(r) for r in out.collect()} == {("a", "os"), ("a", "fs")}
    assert re.search(r"Filter \(+Contains\(diff", out._jdf.queryExecution().optimizedPlan().toString())


@pytest.mark.parametrize("together", [1_000, 3])
def test_pairs_equal_histories(rows, monkeypatch, together):
    """Versions that meet their predecessor in one move, also of busy paths, give what histories and stores give."""
    monkeypatch.setattr(N, "TOGETHER", together)
    big = "\n".join(f"l{i}" for i in range(250))
    v = versions(rows, big, big, big.replace("l7\n", "  l7\n"), big.replace("l9\n", "L9\n"), "short", "short\nand", "", None, "x").unionByName(
        rows("path string, ts timestamp, content string", ("g", dt.datetime(2024, 1, 1), "a"), ("g", dt.datetime(2024, 1, 1, 0, 0, 1), "b")))
    history, store, pairs = N.with_history(v), N.line_store(v), N.version_pairs(v)
    listed = lambda df: sorted(map(str, df.collect()))
    assert listed(N.changed_pairs(pairs)) == listed(N.changed_lines(history, store))
    assert listed(N.audit_pairs(pairs)) == listed(N.audit_chunks(history, store))
    want = N.sent_texts(v, N.audit_mode(history, 200, 1), N.audit_chunks(history, store))
    assert listed(N.sent_pairs(pairs, 200, 1)) == listed(want)
    if together == 1_000:
        for df in (N.changed_pairs(pairs), N.audit_pairs(pairs), N.sent_pairs(pairs)):
            assert df._jdf.queryExecution().optimizedPlan().toString().count("Window") == 1
            assert sum("Exchange" in line for line in exchanged(df)) == 1
