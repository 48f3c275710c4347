import datetime as dt
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditloom.operators import budget as U

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab é_.\n1", max_size=60), min_size=1, max_size=20))
def test_estimates(spark, codes):
    df = spark.createDataFrame(list(enumerate(codes)), "i int, c string")
    code = F.col("c")
    got = df.select("i", U.estimate_numbered(code).alias("a"), U.estimate_words(code, 100).alias("b"),
                    U.estimate_rules(code, 50).alias("r"), U.estimate_chars(code).alias("k")).collect()
    for row in got:
        c = codes[row.i]
        numbered = "\n".join(f"{i + 1}: {x}" for i, x in enumerate(c.split("\n")[:-1] if c.endswith("\n") or not c else c.split("\n")))
        assert row.a == len(numbered) // 4 + 500
        assert row.b == len(re.findall(r"\w+|[^\w\s]", c)) + 600
        assert row.r == ((len(c) + 50) // 4 + 800) * 115 // 100
        assert row.k == -(-len(c) * 10 // 37)


def test_long_numbering(rows):
    code = "x\n" * 1234
    got = rows("c string", (code,)).select(U.numbered_length(F.col("c"))).first()[0]
    assert got == len("\n".join(f"{i + 1}: x" for i in range(1234)))


@pytest.mark.parametrize("tpm,cap", [(12_000, 2_400), (30_000, 6_000), (500_000, 100_000), (900_000, 100_000)])
def test_cap(tpm, cap):
    assert U.file_cap(tpm) == cap


def test_minute_slots(spark):
    data = [("hot" if i % 3 else f"p{i % 7}", f"f{i}", i % 5, 500 + (i * 7919) % 1500) for i in range(600)]
    df = spark.createDataFrame(data, "project string, path string, risk_score bigint, tokens bigint")
    rows = U.minute_slots(df, tpm=12_000, rpm=5).collect()
    assert len(rows) == 600
    score = {p: s for _, p, s, _ in data}
    slots, order = {}, {}
    for r in rows:
        slots.setdefault((r.project, r.minute_slot), []).append(r)
        order.setdefault(r.project, []).append(r)
    assert all(sum(r.tokens for r in rs) <= 12_000 and len(rs) <= 5 for rs in slots.values())
    for project, rs in order.items():
        rs.sort(key=lambda r: r.cum_tokens)
        got = [r.minute_slot for r in rs]
        assert got == sorted(got) and set(got) == set(range(max(got) + 1))
        scores = [score[r.path] for r in rs]
        assert scores == sorted(scores, reverse=True)


def test_trailing_usage(spark):
    data = [(1 if i % 3 else 2, i, at((i * i) % 500), 10 + i) for i in range(200)]
    got = U.trailing_usage(spark.createDataFrame(data, "key bigint, call_id bigint, ts timestamp, actual_tokens bigint")).collect()
    for r in got:
        near = [d for d in data if d[0] == r.key and 0 <= (r.ts - d[2]).total_seconds() < 60]
        assert (r.tokens_60s, r.calls_60s) == (sum(d[3] for d in near), len(near))


def test_outcomes_and_limits(rows):
    tries = rows("request_id bigint, attempt int, status int", (1, 1, 429), (1, 2, 200), (2, 1, 504), (2, 2, 504), (2, 3, 504),
                 (2, 4, 504), (3, 1, 500))
    got = {r.request_id: (r.n_retries, r.outcome, r.waited_seconds) for r in U.outcomes(tries).collect()}
    assert got == {1: (1, "ok", 30), 2: (3, "timeout", 45), 3: (0, "failed", 0)}
    probes = rows("key int, headers map<string,string>", (1, {"X-RateLimit-Limit-Requests-Minute": "1000", "x-ratelimit-limit-tokens": "300000"}),
                  (2, {"x-ratelimit-limit-requests": "14400"}), (3, {"x-ratelimit-limit-requests-minute": "n/a", "server": "x"}))
    got = {r.key: (r.found_rpm, r.found_tpm, r.rpm, r.tpm) for r in U.detected_limits(probes, 30, 30_000).collect()}
    assert got == {1: (1000, 300000, 1000, 300000), 2: (10, None, 30, 30000), 3: (None, None, 30, 30000)}


def test_request_table(rows):
    files = rows("path string, code string", ("a", "x\ny\n"), ("big", "z" * 40_000))
    got = U.request_table(files, "sys", tpm=30_000).collect()
    assert [(r.path, r.user and r.user.split("\n\n", 1)[1], r.skip_reason) for r in got] == [
        ("a", "1: x\n2: y", None), ("big", None, "File too large (10,500 tokens)")]
