"""Token estimates, request tables, batch budgets and rate accounting on call logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from auditloom.functions import text as T
from auditloom.functions.session import materialise
from auditloom.functions.twolevel import range_sums

# Words and punctuation marks; spelt as Unicode classes so that engines agree on accented text.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"


# --- estimates ---------------------------------------------------------------------------------------

def numbered_length(code: Column) -> Column:
    """Length of the text with ``n: `` before each line, from the line count alone."""
    n = T.line_count(code)
    digits = sum((F.greatest(F.lit(0), n - F.lit(10 ** k - 1)) for k in range(1, 10)), n)  # a line count is an int
    newline = F.when(code.endswith("\n"), 1).otherwise(0)
    return F.length(code) - newline + n * 2 + digits


def estimate_numbered(code: Column, reserve: int = 500) -> Column:
    return (F.floor(numbered_length(code) / 4) + reserve).cast("bigint")


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN_PATTERN)).cast("bigint")


def estimate_words(code: Column, prompt_tokens: int, reserve: int = 500) -> Column:
    return count_tokens(code) + prompt_tokens + reserve


def estimate_rules(code: Column, prompt_chars: int, reserve: int = 800) -> Column:
    """Characters over 4 plus reserve, plus 15 percent (integer arithmetic: exact)."""
    base = F.floor((F.length(code) + prompt_chars) / 4).cast("bigint") + reserve
    return F.floor(base * 115 / 100).cast("bigint")


def estimate_chars(code: Column) -> Column:
    """Characters over 3.7, rounded up (integer arithmetic: exact)."""
    return F.ceil(F.length(code).cast("bigint") * 10 / 37).cast("bigint")


def estimate_corpus(files: DataFrame, overhead: int = 500) -> DataFrame:
    """One row: total characters over 4, plus an overhead per file."""
    return files.agg(F.count("*").alias("n_files"), F.sum(F.length("code").cast("bigint")).alias("n_chars")
                     ).select("n_files", (F.floor(F.coalesce("n_chars", F.lit(0)) / 4).cast("bigint")
                                          + F.col("n_files") * overhead).alias("tokens"))


def file_cap(tpm: int, ceiling: int | None = 100_000) -> int:
    """Largest request: a fifth of the minute budget, at most ``ceiling``."""
    fifth = int(tpm * 0.2)
    return fifth if ceiling is None else min(fifth, ceiling)


def cap_split(requests: DataFrame, tpm: int, ceiling: int | None = 100_000) -> DataFrame:
    """Add ``skip_reason`` for requests above the cap (null: kept)."""
    too_big = F.col("tokens") > file_cap(tpm, ceiling)
    return requests.withColumn("skip_reason", F.when(too_big, F.concat(
        F.lit("File too large ("), F.format_number("tokens", 0), F.lit(" tokens)"))))


def request_table(files: DataFrame, system_text: str, tpm: int, reserve: int = 500) -> DataFrame:
    """Input of a batch inference job: one row per file.  Files above the cap have a ``skip_reason`` and no
    ``user`` text."""
    code = F.col("code")
    sized = cap_split(files.withColumn("tokens", estimate_numbered(code, reserve)), tpm)
    body = F.when(code.endswith("\n"), F.substring(code, F.lit(1), F.length(code) - 1)).otherwise(code)
    return sized.select(
        "path", "tokens", F.lit(system_text).alias("system"), F.when(F.col("skip_reason").isNull(), F.concat(
            F.lit("Audit this code (each line prefixed with its line number):\n\n"),
            T.numbered(body, after=": "))).alias("user"), "skip_reason")


# --- batch plan -----------------------------------------------------------------------------------------

def minute_slots(requests: DataFrame, tpm: int, rpm: int) -> DataFrame:
    """Assign each request of a project to a minute so that none exceeds ``tpm`` tokens or ``rpm`` calls.

    ``requests(project, path, risk_score, tokens)`` with every request within the cap.  Requests are
    taken by falling score; within a score by md5 of the path.  Rows are dealt by ranges of that order, so a project
    of any size is spread evenly.
    """
    # Written once: ranges are told from a sample first, and tokens may be estimated from texts.
    keyed = materialise(requests.select("project", "path", "risk_score", "tokens")
                        .withColumn("_h", F.md5("path")), "requests")
    summed = range_sums(keyed, ["project"], [F.desc("risk_score"), F.asc("_h"), F.asc("path")],
                        {"cum_tokens": F.col("tokens")})
    width = tpm - file_cap(tpm)
    slotted = summed.withColumn("_token_slot", F.floor((F.col("cum_tokens") - 1) / width).cast("bigint"))
    # A token slot holds few requests (each costs tokens), so these windows stay small.
    inside = Window.partitionBy("project", "_token_slot").orderBy("cum_tokens", "_h", "path")
    called = materialise(slotted.withColumn(
        "_call_slot", F.floor((F.row_number().over(inside) - 1) / rpm).cast("bigint")), "slots")
    per_slot = called.groupBy("project", "_token_slot").agg((F.max("_call_slot") + 1).alias("_n"))
    placed = range_sums(per_slot, ["project"], [F.asc("_token_slot")], {"_upto": F.col("_n")})
    start = placed.select("project", "_token_slot", (F.col("_upto") - F.col("_n")).alias("_start"))
    return called.join(start, ["project", "_token_slot"]).select(
        "project", "path", "tokens", "cum_tokens",
        (F.col("_start") + F.col("_call_slot")).cast("bigint").alias("minute_slot"))


# --- call logs --------------------------------------------------------------------------------------------

def minute_usage(calls: DataFrame, tpm: int, rpm: int) -> DataFrame:
    """Tokens and calls per key and minute with share of limit: ``calls(key, ts, actual_tokens)``."""
    used = calls.groupBy("key", F.date_trunc("minute", "ts").alias("minute")).agg(
        F.sum("actual_tokens").alias("tokens"), F.count("*").alias("n_calls"))
    return used.select("*", F.round(F.col("tokens") / tpm, 6).alias("share"),
                       ((F.col("tokens") > tpm) | (F.col("n_calls") > rpm)).alias("over_limit"))


def trailing_usage(calls: DataFrame, seconds: int = 60) -> DataFrame:
    """Tokens and calls of the key in the last ``seconds`` at each call (itself included).

    Every call is also copied into the next time bucket, so the window runs per (key, bucket) and a busy
    key is split over many tasks.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    width = seconds * 1_000_000
    bucket = F.floor(us / width).cast("bigint")
    copied = calls.withColumns({"_us": us, "_b": F.explode(F.array(bucket, bucket + 1))}).withColumn(
        "_own", F.floor(F.col("_us") / width).cast("bigint") == F.col("_b"))
    near = Window.partitionBy("key", "_b").orderBy("_us").rangeBetween(-(width - 1), 0)
    return (copied.withColumns({"tokens_60s": F.sum("actual_tokens").over(near),
                                "calls_60s": F.count("*").over(near)})
            .where("_own").select(*calls.columns, "tokens_60s", "calls_60s"))


def estimate_error(calls: DataFrame) -> DataFrame:
    """Refunded tokens and bias of the estimates per model."""
    gap = F.col("est_tokens") - F.col("actual_tokens")
    return calls.groupBy("model").agg(F.count("*").alias("n_calls"),
                                      F.sum(F.greatest(gap, F.lit(0))).alias("refund"),
                                      F.round(F.avg(gap), 6).alias("bias"))


def outcomes(attempts: DataFrame, max_retries: int = 3, pause_seconds: int = 30,
             timeout_seconds: int = 15) -> DataFrame:
    """Outcome of each request from its attempts: ``attempts(request_id, attempt, status)``."""
    status = F.col("status")
    limited, timeout = status == 429, status.isin(408, 504)
    retried = F.col("attempt") <= max_retries
    last = F.max_by("status", "attempt")
    return attempts.groupBy("request_id").agg(
        F.count("*").alias("n_attempts"), (F.count("*") - 1).alias("n_retries"), last.alias("final_status"),
        F.when(last == 200, "ok").when(last == 429, "rate_limited").when(last.isin(408, 504), "timeout")
        .otherwise("failed").alias("outcome"),
        F.coalesce(F.sum(F.when(limited & retried, pause_seconds)
                         .when(timeout & retried, timeout_seconds)), F.lit(0)).alias("waited_seconds"))


def detected_limits(probes: DataFrame, current_rpm: int, current_tpm: int) -> DataFrame:
    """Limits read from response headers: ``probes(key, headers map<string,string>)``.

    The per-minute request header, else the daily one over 1440; the token header.  A limit only ever
    goes up from the current one.
    """
    def first(*words: str) -> Column:
        named = " AND ".join(f"contains(lower(e.key), {T.lit(w)})" for w in words)
        return F.expr(f"get(filter(transform(filter(map_entries(headers), e -> {named}), "
                      "e -> try_cast(trim(e.value) AS bigint)), n -> n IS NOT NULL), 0)")
    minute = first("ratelimit", "request", "limit", "minute")
    daily = first("ratelimit", "request", "limit")
    rpm = F.coalesce(F.when(minute != 0, minute), F.floor(daily / 1440).cast("bigint"))
    tpm = first("ratelimit", "token", "limit")
    return probes.select("key", rpm.alias("found_rpm"), tpm.alias("found_tpm"),
                         F.greatest(F.lit(current_rpm).cast("bigint"), rpm).alias("rpm"),
                         F.greatest(F.lit(current_tpm).cast("bigint"), tpm).alias("tpm"))


def thin_log(events: DataFrame, *columns: str) -> DataFrame:
    """The first event of each key and minute: ``events(key, ts, ...)``; ties by the listed columns."""
    return events.groupBy("key", F.date_trunc("minute", "ts").alias("minute")).agg(
        F.min(F.struct("ts", *columns)).alias("e")).select("key", "minute", "e.*")
