"""Queries: token budgets, call logs, streams, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom import rules as R
from auditloom.functions.session import materialise, scratch_path
from auditloom.operators import budget as U
from auditloom.operators import responses as P
from auditloom.operators import screen as S
from auditloom.plans import bindings as B
from auditloom.plans.bindings import STR, bind, ctes, text
from auditloom.plans.q_reports import _FORM, _HIST
from auditloom.plans.q_responses import _LADDER
from auditloom.plans.q_screen import gate_sql, line_rules_sql, lines_sql
from auditloom.plans.registry import query
from auditloom.sources import logs
from auditloom.sources.tables import table
from auditloom.streaming import jobs

# --- estimates ---------------------------------------------------------------------------------------------
_BODY = "CASE WHEN code LIKE '%' || chr(10) THEN left(code, length(code) - 1) ELSE code END"
_LINES = f"string_split({_BODY}, chr(10))"
_NUMBERED_LEN = (f"CASE WHEN code = '' THEN 0 ELSE length({_BODY}) + list_sum(list_transform(range(1, len({_LINES}) + 1), "
                 f"lambda i: length(CAST(i AS varchar)) + 2)) END")
_EST = {
    "by_numbered": f"CAST(({_NUMBERED_LEN}) // 4 + 500 AS bigint)",
    "by_words": f"CAST(len(regexp_extract_all(code, {text(U.TOKEN_PATTERN)})) + 620 AS bigint)",
    "by_rules": "CAST((((length(code) + 400) // 4) + 800) * 115 // 100 AS bigint)",
    "by_chars": "CAST(ceil(length(code) / 3.7) AS bigint)",
}


@query("bg1_token_estimates", ctes("doc_files") + "SELECT path, " + ", ".join(f"{v} AS {k}" for k, v in _EST.items())
       + " FROM doc_files")
def bg1(spark, sf):
    code = F.col("code")
    return bind(spark, sf, "doc_files").select(
        "path", U.estimate_numbered(code).alias("by_numbered"), U.estimate_words(code, 120).alias("by_words"),
        U.estimate_rules(code, 400).alias("by_rules"), U.estimate_chars(code).alias("by_chars"))


@query("bg1_corpus_estimate", ctes("code_files") + """SELECT count(*) AS n_files,
CAST(sum(length(code)) // 4 + count(*) * 500 AS bigint) AS tokens FROM code_files""")
def bg1_corpus(spark, sf):
    return U.estimate_corpus(bind(spark, sf, "code_files"))


@query("bg2_file_cap", ctes("doc_files", extra={"t": f"SELECT path, {_EST['by_numbered']} AS tokens FROM doc_files"}) + """
SELECT path, tokens, CASE WHEN tokens > 1000 THEN 'File too large (' || format('{:,}', tokens) || ' tokens)' END AS skip_reason FROM t""")
def bg2(spark, sf):
    sized = bind(spark, sf, "doc_files").select("path", U.estimate_numbered(F.col("code")).alias("tokens"))
    return U.cap_split(sized, tpm=5000)


_SYSTEM = "You are a code auditor. Answer in JSON."


@query("bg3_request_table", ctes("doc_files", extra={
    "t": f"SELECT path, code, {_EST['by_numbered']} AS tokens FROM doc_files",
    "l": f"SELECT path, unnest({_LINES}) AS line, unnest(range(1, len({_LINES}) + 1)) AS n FROM t WHERE tokens <= 6000"}) + f"""
SELECT t.path, t.tokens, {text(_SYSTEM)} AS system, 'Audit this code (each line prefixed with its line number):' || chr(10) || chr(10)
|| b.body AS user, CASE WHEN t.tokens > 6000 THEN 'File too large (' || format('{{:,}}', t.tokens) || ' tokens)' END AS skip_reason
FROM t LEFT JOIN (SELECT path, string_agg(CAST(n AS varchar) || ': ' || line, chr(10) ORDER BY n) AS body FROM l GROUP BY path) b ON b.path = t.path""")
def bg3(spark, sf):
    return U.request_table(bind(spark, sf, "doc_files"), _SYSTEM, tpm=30_000)


_REQ = ["project", "path", "CAST(floor(n_chars / 1000) AS bigint) AS risk_score"]


@query("bg4_minute_slots", ctes("doc_files", extra={
    "r": f"SELECT {', '.join(_REQ)}, {_EST['by_chars']} AS tokens, md5(path) AS h FROM doc_files",
    "c": "SELECT *, CAST(sum(tokens) OVER (PARTITION BY project ORDER BY risk_score DESC, h, path ROWS UNBOUNDED PRECEDING) AS bigint) AS cum_tokens FROM r WHERE tokens <= 6000",
    "s": "SELECT *, (cum_tokens - 1) // 24000 AS ts FROM c",
    "k": "SELECT *, (row_number() OVER (PARTITION BY project, ts ORDER BY cum_tokens, h, path) - 1) // 10 AS cs FROM s"}) + """
SELECT project, path, tokens, cum_tokens, CAST(dense_rank() OVER (PARTITION BY project ORDER BY ts, cs) - 1 AS bigint) AS minute_slot FROM k
UNION ALL SELECT project, path, tokens, CAST(NULL AS bigint), CAST(NULL AS bigint) FROM r WHERE tokens > 6000""")
def bg4(spark, sf):
    files = bind(spark, sf, "doc_files")
    requests = files.selectExpr(*_REQ, "code").withColumn("tokens", U.estimate_chars(F.col("code"))).drop("code")
    sized = U.cap_split(requests, tpm=30_000)
    slots = U.minute_slots(sized.where("skip_reason IS NULL").drop("skip_reason"), tpm=30_000, rpm=10)
    over = sized.where("skip_reason IS NOT NULL")  # no minute can hold them: rows without a slot
    return slots.unionByName(over.select("project", "path", "tokens"), allowMissingColumns=True)


# --- call logs ------------------------------------------------------------------------------------------------

@query("bg5_minute_usage", ctes("calls") + """SELECT key, date_trunc('minute', ts) AS minute, CAST(sum(actual_tokens) AS bigint) AS tokens,
count(*) AS n_calls, round(sum(actual_tokens) / 3000.0, 6) AS share, sum(actual_tokens) > 3000 OR count(*) > 2 AS over_limit FROM calls GROUP BY 1, 2""")
def bg5(spark, sf):
    return U.minute_usage(bind(spark, sf, "calls"), tpm=3000, rpm=2)


@query("bg6_trailing_usage", ctes("calls", extra={"c": "SELECT model AS key, call_id, ts, epoch_us(ts) AS us, actual_tokens FROM calls"}) + """
SELECT key, call_id, CAST(sum(actual_tokens) OVER w AS bigint) AS tokens_60s, count(*) OVER w AS calls_60s FROM c
WINDOW w AS (PARTITION BY key ORDER BY us RANGE BETWEEN 1799999999 PRECEDING AND CURRENT ROW)""")
def bg6(spark, sf):
    # A trailing half hour over five busy keys: the users of the small scales rarely call twice a minute.
    calls = bind(spark, sf, "calls").selectExpr("model AS key", "call_id", "ts", "actual_tokens")
    return U.trailing_usage(calls, seconds=1800).select("key", "call_id", "tokens_60s", "calls_60s")


@query("bg7_estimate_error", ctes("calls") + """SELECT model, count(*) AS n_calls, CAST(sum(greatest(est_tokens - actual_tokens, 0)) AS bigint) AS refund,
round(avg(est_tokens - actual_tokens), 6) AS bias FROM calls GROUP BY model""")
def bg7(spark, sf):
    return U.estimate_error(bind(spark, sf, "calls"))


@query("bg8_outcomes", ctes(extra={"a": B.ATTEMPTS_SQL, "g": """SELECT request_id, count(*) AS n_attempts, arg_max(status, attempt) AS final_status,
coalesce(sum(CASE WHEN attempt > 3 THEN NULL WHEN status = 429 THEN 30 WHEN status IN (408, 504) THEN 15 END), 0) AS waited FROM a GROUP BY 1"""}) + """
SELECT request_id, n_attempts, n_attempts - 1 AS n_retries, final_status, CASE WHEN final_status = 200 THEN 'ok' WHEN final_status = 429 THEN 'rate_limited'
WHEN final_status IN (408, 504) THEN 'timeout' ELSE 'failed' END AS outcome, CAST(waited AS bigint) AS waited_seconds FROM g""")
def bg8(spark, sf):
    return U.outcomes(B.attempts(spark, sf))


def _probe_maps(make) -> str:
    k = f"CAST(10 + user_id AS {'string'})"
    return ("CASE event_type WHEN 'click' THEN " + make([("x-ratelimit-limit-requests-minute", k), ("x-ratelimit-limit-tokens", "'90000'")])
            + " WHEN 'view' THEN " + make([("x-ratelimit-limit-requests", f"{k} || '000'"), ("x-ratelimit-limit-tokens", "'20000'")])
            + " WHEN 'purchase' THEN " + make([("x-ratelimit-limit-requests-minute", "'abc'"), ("X-RateLimit-Limit-Requests", "'144000'")])
            + " WHEN 'signup' THEN " + make([("X-RateLimit-Limit-Tokens", f"{k} || '0000'"), ("server", "'x'")])
            + " ELSE " + make([("server", "'x'"), ("via", "'y'")]) + " END AS headers")


_SPARK_MAP = _probe_maps(lambda kv: "map(" + ", ".join(f"{text(k)}, {v}" for k, v in kv) + ")")
_DUCK_MAP = _probe_maps(lambda kv: "[" + ", ".join(f"{{'key': {text(k)}, 'value': {v}}}" for k, v in kv) + "]")


def _first_header(*words: str) -> str:
    cond = " AND ".join(f"contains(lower(e.key), {text(w)})" for w in words)
    return (f"list_filter(list_transform(list_filter(headers, lambda e: {cond}), lambda e: TRY_CAST(trim(e.value) AS bigint)), "
            f"lambda n: n IS NOT NULL)[1]")


@query("bg9_detected_limits", f"""WITH p AS (SELECT event_id AS key, {_DUCK_MAP} FROM events), q AS (SELECT key,
{_first_header('ratelimit', 'request', 'limit', 'minute')} AS m, {_first_header('ratelimit', 'request', 'limit')} AS d,
{_first_header('ratelimit', 'token', 'limit')} AS tpm FROM p), r AS (SELECT key, coalesce(nullif(m, 0), d // 1440) AS rpm, tpm FROM q)
SELECT key, rpm AS found_rpm, tpm AS found_tpm, greatest(30, rpm) AS rpm, greatest(30000, tpm) AS tpm FROM r""")
def bg9(spark, sf):
    return U.detected_limits(table(spark, sf, "events").selectExpr("event_id AS key", _SPARK_MAP), 30, 30_000)


@query("bg10_thin_log", ctes("calls") + """SELECT model AS key, date_trunc('minute', ts) AS minute, min(ts) AS ts, arg_min(call_id, (ts, call_id)) AS call_id
FROM calls GROUP BY 1, 2""")
def bg10(spark, sf):
    return U.thin_log(bind(spark, sf, "calls").selectExpr("model AS key", "ts", "call_id"), "call_id")


def _stream(spark, sf, name):
    """A table as a stream, be it one file or a folder of part files: streams refuse a plain path of a file, not a glob."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _bound_stream(spark, sf, name):
    source, columns = B.BINDINGS[name]
    return _stream(spark, sf, source).selectExpr(*columns)


# --- streams -----------------------------------------------------------------------------------------------------

@query("st1_continuous_screen", ctes("doc_files", extra={
    "g": gate_sql(R.LOCAL, "doc_files"), "l": lines_sql("g", "path, should_audit")})
    + line_rules_sql("l", R.exploit_line_rules(R.LOCAL) + R.SECRET_RULES, extra_where="should_audit"))
def st1(spark, sf):
    return jobs.run_to_table(jobs.continuous_screen(_bound_stream(spark, sf, "doc_files"), R.LOCAL), "screen")


@query("st2_reaudit_state", ctes(extra=_HIST) + f"""SELECT path, ts, CAST(len(string_split(content, chr(10))) AS integer) AS n_lines,
CASE WHEN coalesce(content = prev, false) OR coalesce({_FORM('content')} = {_FORM('prev')}, false) THEN 'skip'
WHEN prev IS NULL AND len(string_split(content, chr(10))) > 20 THEN 'index_only'
WHEN prev IS NULL OR len(string_split(content, chr(10))) <= 5 THEN 'full' ELSE 'diff' END AS mode FROM h""")
def st2(spark, sf):
    saves = _stream(spark, sf, "documents").selectExpr("*", "explode(sequence(1, 4)) AS v").selectExpr(
        f"source || '/' || {STR('doc_id')} AS path", "TIMESTAMP '2024-01-01 00:00:00' + v * INTERVAL '1' DAY AS ts",
        f"{B.VERSION_TEXT} AS content")
    return jobs.run_to_table(jobs.reaudit(saves, first_limit=20, full_limit=5), "reaudit")


# Rows arrive in the four quarters of their time span; of the first one, some come as late as the last.
_QUARTERS = 4


def _arriving(rows, at: str, late: str):
    """Parts in which ``rows`` arrive, and a last row far behind that closes what is open."""
    held = materialise(rows.withColumn(at, F.col(at).cast("timestamp")), "arrivals")  # watermarks need instants
    micros = F.unix_micros(at)
    low, high = held.select(F.min(micros), F.max(micros)).first()
    quarter = F.floor((micros - low) * _QUARTERS / (high - low + 1))
    placed = held.withColumn("_q", F.when((quarter == 0) & F.expr(late), _QUARTERS - 1).otherwise(quarter))
    end = held.agg((F.max(at) + F.expr("INTERVAL '60' DAY")).alias(at))
    closing = end.select(*[F.col(c) if c == at else F.lit(None).cast(t).alias(c) for c, t in held.dtypes])
    return [placed.where(F.col("_q") == q).drop("_q") for q in range(_QUARTERS)] + [closing]


def _in_time(source: str, at: str, late: str) -> str:
    """SQL: rows of ``source`` that are not late."""
    return (f"SELECT * FROM {source} WHERE NOT (({late}) AND (epoch_us({at}) - (SELECT min(epoch_us({at})) FROM {source})) * {_QUARTERS}"
            f" < (SELECT max(epoch_us({at})) - min(epoch_us({at})) + 1 FROM {source}))")


_LATE = "key % 13 = 0"
_ON_TIME = {"in_time": _in_time("ledger", "ts", _LATE)}


def _local(table_, *times: str):
    """Times as they are in the tables, without a zone."""
    return table_.withColumns({t: F.col(t).cast("timestamp_ntz") for t in times})


def _saves(spark, sf):
    return _arriving(bind(spark, sf, "ledger"), "ts", _LATE)


@query("st4_verdict_rates_tumbling", ctes("ledger", extra=_ON_TIME) + """SELECT date_trunc('hour', ts) AS window_start,
date_trunc('hour', ts) + INTERVAL '1' HOUR AS window_end, result AS action, count(*) AS n FROM in_time GROUP BY 1, 2, 3""")
def st4(spark, sf):
    return _local(jobs.run_in_parts(_saves(spark, sf), lambda s: jobs.windowed_verdicts(
        s.selectExpr("ts", "result AS action")), "rates"), "window_start", "window_end")


@query("st4_verdict_rates_sliding", ctes("ledger", extra=_ON_TIME | {
    "w": "SELECT date_trunc('hour', ts) - k * INTERVAL '1' HOUR AS s, result FROM in_time, range(0, 3) t(k)"}) + """
SELECT s AS window_start, s + INTERVAL '3' HOUR AS window_end, result AS action, count(*) AS n FROM w GROUP BY 1, 2, 3""")
def st4_sliding(spark, sf):
    return _local(jobs.run_in_parts(_saves(spark, sf), lambda s: jobs.windowed_verdicts(
        s.selectExpr("ts", "result AS action"), "3 hours", "1 hour"), "rates"), "window_start", "window_end")


@query("st5_repeat_sends", ctes("calls") + "SELECT DISTINCT key AS path, model AS hash FROM calls")
def st5(spark, sf):
    """Sends of which none with the same path and hash was seen within more than a year, over several runs."""
    sends = bind(spark, sf, "calls").selectExpr("key AS path", "model AS hash", "ts")
    return jobs.run_in_parts(_arriving(sends, "ts", "path % 13 = 0")[:-1], lambda s: jobs.suppress_repeats(s, "400 days"),
                             "sends").select("path", "hash")


@query("st6_save_bursts", ctes("ledger", extra=_ON_TIME | {
    "g": "SELECT key, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY key ORDER BY ts) < INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS fresh FROM in_time",
    "s": "SELECT key, ts, sum(fresh) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g"}) + """
SELECT key, min(ts) AS session_start, max(ts) + INTERVAL '30' MINUTE AS session_end, count(*) AS n_saves FROM s GROUP BY key, sid""")
def st6(spark, sf):
    return _local(jobs.run_in_parts(_saves(spark, sf), lambda s: jobs.save_bursts(s.select("key", "ts")), "bursts"),
                  "session_start", "session_end")


_LOG_TS = "TIMESTAMP '2024-01-01 00:00:00' + (response_id % 5) * INTERVAL '20' MINUTE"
_SPREAD_TS = "TIMESTAMP '2024-01-01 00:00:00' + (response_id % 8) * INTERVAL '12' HOUR"
_FORCED_LATE = "response_id % 13 = 0"


@query("st7_override_alerts", ctes("flow_reviews", "doc_files", extra=_LADDER | {
    "forced": f"SELECT {_SPREAD_TS} AS timestamp, response_id, override_reason FROM final WHERE override_reason IS NOT NULL",
    "in_time": _in_time("forced", "timestamp", _FORCED_LATE)}) + """
SELECT date_trunc('hour', timestamp) AS window_start, override_reason, count(*) AS n FROM in_time GROUP BY 1, 2 HAVING count(*) > 2""")
def st7(spark, sf):
    done = P.override(bind(spark, sf, "flow_reviews"), bind(spark, sf, "doc_files"))
    log = P.override_log(done, F.expr(_SPREAD_TS))
    return jobs.run_in_parts(_arriving(log, "timestamp", _FORCED_LATE), lambda s: jobs.override_alerts(s, threshold=2), "alerts")


# --- sinks ----------------------------------------------------------------------------------------------------------

@query("src7_override_log", ctes("flow_reviews", "doc_files", extra=_LADDER) + f"""SELECT {_LOG_TS} AS timestamp, override_reason,
'ACCEPT' AS triggered_verdict, count(*) AS n FROM final WHERE override_reason IS NOT NULL GROUP BY 1, 2, 3""")
def src7(spark, sf):
    """Forced verdicts appended to a JSON-lines log and read back."""
    path = scratch_path(spark, "overrides")
    done = P.override(bind(spark, sf, "flow_reviews"), bind(spark, sf, "doc_files"))
    logs.append_overrides(P.override_log(done, F.expr(_LOG_TS)), path)
    return logs.read_overrides(spark, path).groupBy("timestamp", "override_reason", "triggered_verdict").agg(
        F.count("*").alias("n"))


@query("src8_ledger", ctes("ledger") + """SELECT date_trunc('second', ts) AS ts, result, 'key ' || CAST(key AS varchar) || ' checked' AS reasoning
FROM ledger""")
def src8(spark, sf):
    """Verdicts written as ledger markdown and parsed back from whole files."""
    path = scratch_path(spark, "ledger")
    rows = bind(spark, sf, "ledger").selectExpr("ts", "result", "'key ' || CAST(key AS string) || ' checked' AS reasoning")
    logs.ledger_text(rows).write.mode("append").text(path)
    return logs.read_ledger(spark, path).select("ts", "result", "reasoning")


@query("src9_findings_sink", ctes("code_files", extra={"l": lines_sql("code_files")}) + "SELECT severity, rule_id, count(*) AS n FROM ("
       + line_rules_sql("l", R.UNSAFE_CALLS) + ") GROUP BY 1, 2")
def src9(spark, sf):
    """Findings appended to a table partitioned by severity and read back."""
    path = scratch_path(spark, "findings")
    logs.append_findings(S.line_findings(bind(spark, sf, "code_files"), R.UNSAFE_CALLS), path, "severity")
    return spark.read.parquet(path).groupBy("severity", "rule_id").agg(F.count("*").alias("n"))
