"""Scoring verdicts against truth; comparing versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from auditloom import rules as R
from auditloom.functions import text as T


def verdict_of(severity: Column) -> Column:
    return F.when(severity.isin(*R.REJECT_SEVERITIES), "REJECT").otherwise("ACCEPT")


def accuracy_by_slice(results: DataFrame) -> DataFrame:
    """Per version: accuracy in percent overall, on safe, on vulnerable and on edge cases.

    ``results(version, case_id, expected, verdict)``; slices overlap, so they are columns.
    """
    right = F.when(F.col("verdict") == F.col("expected"), 100.0).otherwise(0.0)

    def acc(cond: Column, name: str) -> Column:
        return F.round(F.coalesce(F.avg(F.when(cond, right)), F.lit(0.0)), 6).alias(name)
    return results.groupBy("version").agg(
        acc(F.lit(True), "overall"), acc(F.col("expected") == "ACCEPT", "false_positive_traps"),
        acc(F.col("expected") == "REJECT", "violations"),
        acc(F.col("case_id").startswith("E"), "edge_cases"), F.count("*").alias("n_cases"))


def confusion(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """TP, FP, FN, TN, recall, precision, F1.  Cases missing on one side count as not flagged there."""
    both = truth.select("case_id", F.col("vulnerable").alias("t")).join(
        predictions.select("case_id", F.col("flagged").alias("p")), "case_id", "full")
    t, p = F.coalesce("t", F.lit(False)), F.coalesce("p", F.lit(False))
    counts = both.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
                      F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    recall = F.try_divide("tp", F.col("tp") + F.col("fn"))
    precision = F.try_divide("tp", F.col("tp") + F.col("fp"))
    f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return counts.select("*", F.round(recall, 6).alias("recall"),
                         F.round(precision, 6).alias("precision"), F.round(f1, 6).alias("f1"))


def miss_causes(truth: DataFrame, caught: DataFrame, skipped: DataFrame, results: DataFrame) -> DataFrame:
    """Why each vulnerable file was or was not caught.

    ``caught(path)``; ``skipped(path, reason)``; ``results(path, status)``; one row per path in each.
    """
    status = F.col("status")
    cause = (F.when(F.col("_caught"), "Caught")
             .when(F.col("reason").isNotNull(), "Layer 1 Blindspot")
             .when(status == "safe", "Model False Negative").when(status == "error", "Model Error")
             .when(status == "skipped", "Token Limit Skip")
             .otherwise(F.concat(F.lit("Unknown Status: "), F.coalesce(status, F.lit("Unknown")))))
    return (truth.where("vulnerable").select("path")
            .join(caught.select("path").distinct().withColumn("_caught", F.lit(True)), "path", "left")
            .join(skipped.select("path", "reason"), "path", "left")
            .join(results.select("path", "status"), "path", "left")
            .select("path", cause.alias("cause"), "reason"))


def version_wins(results: DataFrame, versions: Sequence[str] = ("V1", "V2", "V2F")) -> DataFrame:
    """Cases only V1 got right; V2 right while V1 wrong; V2F right while both others wrong."""
    wide = results.groupBy("case_id").agg(*[
        F.bool_or(F.when(F.col("version") == v, F.col("verdict") == F.col("expected"))).alias(f"r{i}")
        for i, v in enumerate(versions, 1)])
    return wide.agg(F.count_if(F.expr("r1 AND NOT r2 AND NOT r3")).alias("v1_wins"),
                    F.count_if(F.expr("r2 AND NOT r1")).alias("v2_wins"),
                    F.count_if(F.expr("r3 AND NOT r1 AND NOT r2")).alias("v3_wins"))


def version_speed(results: DataFrame, versions: Sequence[str] = ("V1", "V2", "V2F")) -> DataFrame:
    """Correct counts and mean seconds of the three versions, speed-up and winner."""
    def of(i: int) -> Column:
        return F.col("version") == versions[i]
    right = F.col("verdict") == F.col("expected")
    wide = results.agg(*[F.count_if(of(i) & right).alias(f"c{i + 1}") for i in range(3)],
                       *[F.avg(F.when(of(i), F.col("elapsed"))).alias(f"e{i + 1}") for i in range(3)])
    winner = F.expr("""CASE WHEN c3 >= c2 AND e3 < e2 THEN 'V2_FAST' WHEN c2 > c1 THEN 'V2_FULL'
                            WHEN c1 > c2 THEN 'V1' ELSE 'TIE' END""")
    return wide.select("c1", "c2", "c3", *[F.round(f"e{i}", 6).alias(f"e{i}") for i in (1, 2, 3)],
                       F.round(F.expr("try_divide(e2 - e3, e2) * 100"), 6).alias("speedup_pct"),
                       winner.alias("winner"))


def compare_versions(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Pairwise change between two verdict versions of the same case.

    ``v1(case_id, action, drift_score, n_violations)``; ``v2`` also has severity, exploitability and
    user_controlled_input.
    """
    a, b = v1.alias("a"), v2.alias("b")
    changed = F.col("a.action") != F.col("b.action")
    delta = F.round(F.col("b.drift_score") - F.col("a.drift_score"), 6)
    notes = T.compact(F.array(
        F.when(changed & (F.col("a.action") == "REJECT") & (F.col("b.action") == "ACCEPT"),
               "Reduced false positive"),
        F.when(delta < -0.2, "Significantly lower risk score"),
        F.when(F.col("b.exploitability") == "none", "Correctly identified no exploitability"),
        F.when(~F.col("b.user_controlled_input"), "Correctly identified no user input")))
    return a.join(b, F.col("a.case_id") == F.col("b.case_id")).select(
        F.col("a.case_id").alias("case_id"), F.col("a.action").alias("v1_action"),
        F.col("b.action").alias("v2_action"), changed.alias("action_changed"),
        delta.alias("score_delta"), F.col("a.n_violations").alias("v1_violations"),
        F.col("b.n_violations").alias("v2_violations"), notes.alias("indicators"))


def agreement(ast: Column, model: Column, expected: Column) -> tuple[Column, Column]:
    """(confidence, reason) from the agreement of two classifiers and the expected severity."""
    both = (ast == expected) & (model == expected)
    steps = ((both, 100, "AST and LLM both confirm"),
             ((ast == "CRITICAL") & (model == "SAFE"), 70,
              "AST confirms exploit but LLM says safe (possible LLM miss)"),
             ((model != "SAFE") & (ast == "SAFE"), 30,
              "LLM flags issue but AST finds no user-controlled path"),
             ((ast == "SAFE") & (model == "SAFE"), 0, "Both agree it's safe"))
    confidence, reason = F.lit(50), F.lit("Partial agreement")
    for cond, value, text in reversed(steps):
        confidence = F.when(cond, value).otherwise(confidence)
        reason = F.when(cond, text).otherwise(reason)
    return confidence, reason


def tier_report(cases: DataFrame) -> DataFrame:
    """Pass rate per tier: ``cases(tier, case_id, passed)``."""
    return cases.groupBy("tier").agg(
        F.count("*").alias("n_cases"), F.count_if("passed").alias("n_passed"),
        F.round(F.avg(F.when(F.col("passed"), 1.0).otherwise(0.0)), 6).alias("pass_rate"))


def release_gate(cases: DataFrame, must_hold: Column) -> DataFrame:
    """One row: all passed, and the must-hold condition on critical cases."""
    return cases.agg(F.count("*").alias("n_cases"), F.count_if("passed").alias("n_passed"),
                     F.coalesce(F.bool_and(must_hold), F.lit(True)).alias("critical_ok"),
                     (F.bool_and("passed") & F.coalesce(F.bool_and(must_hold), F.lit(True))).alias("gate"))


def categorise(missed: DataFrame, categories: DataFrame) -> DataFrame:
    """Missed files with their category, or Unknown."""
    return missed.join(categories, "path", "left").withColumn(
        "category", F.coalesce("category", F.lit("Unknown")))


def first_reason(false_positives: DataFrame) -> DataFrame:
    """First recorded reason of each false positive: rows (path, seq, reason)."""
    return false_positives.groupBy("path").agg(F.min_by("reason", "seq").alias("reason"),
                                               F.count("*").alias("n_reasons"))
