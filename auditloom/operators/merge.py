"""Merging findings of several layers into per-file verdicts, and audit reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from auditloom import rules as R
from auditloom.functions import text as T


def severity_rank(severity: Column) -> Column:
    return T.lookup(F.coalesce(severity, F.lit("HIGH")), R.SEVERITY_RANK, R.SEVERITY_RANK_OTHER)


def union_layers(*layers: tuple[str, DataFrame]) -> DataFrame:
    """Union of layer findings with a ``source_layer`` and a ``layer_order`` column."""
    out = None
    for order, (name, rows) in enumerate(layers, 1):
        tagged = rows.withColumns({"source_layer": F.lit(name), "layer_order": F.lit(order)})
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def drop_repeated_model(findings: DataFrame, model_order: int = 3) -> DataFrame:
    """Drop model rows whose (path, line) an earlier layer or an earlier model row already has.

    Rows carry ``seq``, unique within (path, layer).  The first model row per line is found by a
    partially aggregated minimum, so many copies of one line never meet in one sort.
    """
    early = findings.where(F.col("layer_order") < model_order)
    first = first_of_lines(findings.where(F.col("layer_order") == model_order))
    taken = early.select(F.col("path").alias("_p"), F.col("line_number").alias("_n")).distinct()
    kept = first.join(taken, (F.col("path") == F.col("_p")) & F.col("line_number").eqNullSafe(F.col("_n")),
                      "left_anti")
    return early.unionByName(kept)


def first_of_lines(findings: DataFrame, *keep: str) -> DataFrame:
    """The first finding by ``seq`` of each (path, line); ``keep`` are columns that are the same for all rows of a path."""
    columns = [c for c in findings.columns if c not in ("path", "line_number", *keep)]
    return (findings.groupBy("path", "line_number", *keep)
            .agg(F.min_by(F.struct(*columns), F.col("seq")).alias("r"))
            .select("path", "line_number", *keep, "r.*"))


def by_severity(findings: DataFrame) -> DataFrame:
    """Findings in report order: file, severity, layer, line."""
    return findings.withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy(
        "path", "severity_rank", "layer_order", "seq")


def file_verdicts(files: DataFrame, findings: DataFrame, ran: DataFrame | None = None) -> DataFrame:
    """Per file: verdict, drift score, count, reasoning.  Partial aggregation by path, one join.

    The reasoning names the layers that ran: ``ran`` has (path, layer) rows, named and ordered as they shall read; a
    file without any reads ``unknown``.  Without ``ran`` only the layers that found something are known.
    """
    rank = F.struct(severity_rank(F.col("severity")).alias("rank"), "layer_order", "seq")
    top = findings.groupBy("path").agg(
        F.count("*").alias("n"),
        F.min_by(F.struct("rule_id", "line_number"), rank).alias("top"),
        F.array_join(F.array_sort(F.collect_set("source_layer")), " + ").alias("found_in"))
    if ran is None:
        rows = files.select("path").withColumn("ran_", F.lit(None).cast("string"))
    else:
        used = ran.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("layer")), " + ").alias("ran_"))
        rows = files.select("path").join(used, "path", "left").fillna({"ran_": "unknown"})
    return told_verdicts(rows.join(top, "path", "left"))


def told_verdicts(rows: DataFrame) -> DataFrame:
    """``file_verdicts`` of rows (path, ran_, n, top, found_in) that hold what is known of a file: the layers that ran, the
    number of findings, the most severe one (rule_id, line_number) and the layers that found something; null if none."""
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    layers = F.coalesce("ran_", "found_in")
    return rows.select(
        "path", F.when(n > 0, "REJECT").otherwise("ACCEPT").alias("verdict"),
        F.when(n > 0, 1.0).otherwise(0.0).alias("drift_score"), n.alias("n_violations"),
        F.when(n > 0, F.concat(F.lit("["), layers, F.lit("] "), n.cast("string"),
                               F.lit(" violation(s) found. Most severe: "), "top.rule_id",
                               F.lit(" on line "),
                               F.coalesce(F.col("top.line_number").cast("string"), F.lit("None")),
                               F.lit(".")))
        .otherwise(F.concat(F.coalesce(F.concat(F.lit("["), "ran_", F.lit("] ")), F.lit("")),
                            F.lit("All layers cleared. No violations found."))).alias("reasoning"))


def next_stage(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Files without a finding so far: only these go to the next layer."""
    return files.join(findings.select("path").distinct(), "path", "left_anti")


def route(files: DataFrame, findings: DataFrame, power_mode: bool = True) -> DataFrame:
    """Add ``action`` and ``layer``: REJECT at layer 1, else passed through or sent on."""
    hit = findings.select("path").distinct().withColumn("_hit", F.lit(True))
    passed = "L1_PASS" if power_mode else "NEXT_LAYER"
    return files.join(hit, "path", "left").select(
        *files.columns, F.when(F.col("_hit"), "REJECT").otherwise(passed).alias("action"),
        F.when(F.col("_hit"), "layer1").otherwise("layer2").alias("layer"))


def findings_by_file(findings: DataFrame) -> DataFrame:
    """Each finding with its file's totals, for a report grouped by file.

    Totals are aggregated partially and joined back, so a file with very many findings is never
    gathered into one row.
    """
    totals = findings.groupBy("path").agg(
        F.count("*").alias("n_in_file"),
        F.min(severity_rank(F.col("severity"))).alias("top_rank"))
    return findings.join(totals, "path").select(
        "path", "n_in_file", "top_rank", "line_number", "rule_id", "severity", "violation")


def status_summary(results: DataFrame) -> DataFrame:
    """Counts per layer: safe, vulnerable, error, skipped; tokens."""
    def n(s: str) -> Column:
        return F.count_if(F.col("status") == s).alias(f"n_{s}")
    return results.groupBy("layer").agg(n("safe"), n("vulnerable"), n("error"), n("skipped"),
                                        F.sum("tokens_used").alias("tokens_used"))


def severity_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("source_layer", "severity", "rule_id").agg(
        F.count("*").alias("n_findings"), F.countDistinct("path").alias("n_files"))


def latency_stats(results: DataFrame) -> DataFrame:
    """Mean and maximum latency of calls that ran (non-zero, not skipped)."""
    ran = results.where("latency > 0 AND status <> 'skipped'")
    return ran.groupBy("layer").agg(F.round(F.avg("latency"), 6).alias("avg_latency"),
                                    F.max("latency").alias("max_latency"), F.count("*").alias("n_calls"))


def strip_void(verdict: Column, score: Column, violations: Column) -> Column:
    """An ACCEPT with a negligible score carries no violations."""
    return F.when((verdict == "ACCEPT") & (score < 0.1), F.slice(violations, 1, 0)).otherwise(violations)


def score_band(score: Column) -> Column:
    return F.when(score < 0.3, "healthy").when(score < 0.6, "warning").otherwise("critical")
