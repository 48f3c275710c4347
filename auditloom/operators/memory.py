"""Mining project notes: problems, tasks, ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from auditloom.functions import text as T
from auditloom.functions.containment import containing


def problem_blocks(notes: DataFrame) -> DataFrame:
    """Blocks after ``## Problem #n:`` headers: project, name, seq, description, status."""
    blocks = F.slice(F.split("content", r"##\s+Problem\s+#\d+:", -1), 2, 2_000_000_000)
    rows = notes.select("project", "name", F.posexplode(blocks).alias("seq", "description"))
    status = F.regexp_extract("description", r"\*\*Status\*\*:\s*(\w+)", 1)
    return rows.select("project", "name", (F.col("seq") + 1).alias("seq"), "description",
                       F.when(status != "", status).otherwise("UNKNOWN").alias("status"))


def problem_title(problems: DataFrame) -> DataFrame:
    """Add ``title``: the first line of the description."""
    return problems.withColumn("title", F.trim(F.element_at(F.split("description", "\n", 2), 1)))


def route_problems(problems: DataFrame) -> DataFrame:
    """Destination of each problem: pattern, rule, urgent rule (seen more than once) or none.

    Counts are aggregated partially per (project, title).
    """
    titled = problem_title(problems)
    seen = titled.groupBy("project", "title").agg(
        F.count("*").alias("n_seen"), F.max(F.when(F.col("status") == "RESOLVED", 1).otherwise(0)).alias("ok"),
        F.max(F.when(F.col("status") == "UNRESOLVED", 1).otherwise(0)).alias("open"))
    target = (F.when((F.col("open") == 1) & (F.col("n_seen") > 1), "urgent_rule")
              .when(F.col("open") == 1, "negative_rule").when(F.col("ok") == 1, "pattern")
              .otherwise("none"))
    return seen.select("project", "title", "n_seen", target.alias("target"))


def pivots(removed: DataFrame, problems: DataFrame) -> DataFrame:
    """Unresolved problems whose text names a removed technology, within a project.

    ``removed(project, tech)``.  Technologies are word strings, so a text can only hold one inside a
    single run of word characters: the distinct runs are matched, not whole texts.
    """
    words = (problems.where("status = 'UNRESOLVED'").select(
        "project", "name", "seq",
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower("description"), F.lit(r"([A-Za-z0-9_]+)"), 1)))
        .alias("word")))
    hits = containing(words.select("project", "word").distinct(), removed, ["project"], ["word"],
                      "word", "tech")
    return words.join(hits.hint("merge"), ["project", "word"]).select("project", "name", "seq", "tech").distinct()


def complete_tasks(pending: DataFrame, completions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(still pending, done, errors).

    ``pending(project, line_no, line)``; ``completions(project, task, ts)``.  A pending line holding a
    completed task's text goes; a task found on no line is an error row.
    """
    hits = containing(pending.where(F.col("line") != ""), completions, ["project"], ["line_no"], "line", "task")
    still = pending.join(hits.select("project", "line_no").distinct().hint("merge"), ["project", "line_no"], "left_anti")
    matched = hits.select("project", "task").distinct().hint("merge")
    done = completions.join(matched, ["project", "task"], "left_semi").withColumn(
        "entry", F.concat(F.lit("## "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("\n- "), "task"))
    errors = completions.join(matched, ["project", "task"], "left_anti").withColumn(
        "message", F.concat(F.lit("Task not found: "), "task"))
    return still, done, errors


def baseline(notes: DataFrame, n_lines: int | None = None) -> DataFrame:
    """The reference text a ledger is audited against: all of it, or its first ``n_lines`` lines."""
    text = F.col("content")
    if n_lines is not None:
        text = F.array_join(F.slice(T.split_lines(text), 1, n_lines), "\n")
    return notes.select("project", "name", text.alias("baseline"))


def verdict_history(ledger: DataFrame) -> DataFrame:
    """Verdicts per key and day with running totals.  The window sees one row per key and day."""
    daily = ledger.groupBy("key", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n_audits"), F.count_if(F.col("result") == "REJECT").alias("n_rejects"))
    upto = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("*", F.sum("n_audits").over(upto).alias("audits_so_far"),
                        F.sum("n_rejects").over(upto).alias("rejects_so_far"))
