"""Whole audits composed from the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from auditloom import rules as R
from auditloom.functions import text as T
from auditloom.functions.session import materialise
from auditloom.operators import budget, flow, merge, responses, screen, snapshots


@dataclass
class FolderScan:
    """First half of a folder audit: what would be sent, and what is left out and why."""

    queue: DataFrame
    histogram: DataFrame
    skipped: DataFrame
    requests: DataFrame


def scan_folder(files: DataFrame, system_text: str, profile: R.Profile = R.BATCH, tpm: int = 30_000,
                top: int | None = None) -> FolderScan:
    """Gate ``files(path, ext, code)``, rank, and build the request table of all that pass, or the riskiest
    ``top``.  Files above the token cap stay in it with a ``skip_reason``.

    The gate result is written without texts; the texts of the ranked files are joined back.
    """
    gated = materialise(screen.gate(files.select("path", "ext", "code"), profile).drop("code"), "gate")
    passed = gated.where("should_audit").select("path", "ext", "risk_score")
    queue = passed if top is None else screen.top_risk(passed, top)
    chosen = files.select("path", "code").join(queue, "path")
    return FolderScan(queue, screen.extension_histogram(queue), screen.skip_report(gated),
                      budget.request_table(chosen, system_text, tpm))


_LINE_SEQ = "lpad(CAST(line_number AS string), 8, '0')"
_MODEL_SEQ = "lpad(CAST(response_id AS string), 20, '0') || lpad(CAST(seq AS string), 8, '0')"


def _told(files: DataFrame, profile: R.Profile) -> flow.Leaks:
    """Layers 1 and 2 of ``files(path, ext, code)`` in one pass and one written table with a row per file.

    Files with a screen finding go no further, which is told on their row: their texts are not parsed.
    """
    screened = screen.with_findings(files.select("path", "ext", "code"), profile).withColumn("n_lines", T.line_count(F.col("code")))
    return flow.leaks(screened.withColumn("code", F.when(F.size("hits") == 0, F.col("code"))), "hits", "n_lines")


def layered_findings(files: DataFrame, answers: DataFrame | None = None,
                     profile: R.Profile = R.LOCAL) -> DataFrame:
    """Findings of all layers of ``files(path, ext, code)``.

    Files with a screen finding go no further.  The others are followed and, where ``answers`` (response_id, path, raw)
    has one and nothing was found so far, get the confirmed findings of the model on existing lines.
    """
    told = _told(files, profile)
    first = told.files.selectExpr("path", "inline(hits)").selectExpr(
        "path", "line_number", "rule_id", "severity", "rule_name AS violation", f"{_LINE_SEQ} || rule_name AS seq")
    second = materialise(told.findings.selectExpr(
        "path", "line_number", "rule_id", "severity", "data_flow AS violation", f"{_LINE_SEQ} || variable AS seq"), "flow")
    layers = [("Layer 1", first), ("Layer 2", second)]
    if answers is not None:
        seen = first.select("path").unionByName(second.select("path")).distinct()
        asked = answers.join(seen, "path", "left_anti").join(files.select("path").distinct(), "path", "left_semi")
        model = responses.check_lines(responses.confirmed_findings(responses.finding_items(asked)), files)
        layers.append(("V1.0", model.where("valid_line").selectExpr(
            "path", "line_number", "vulnerability_type AS rule_id", "severity", "description AS violation",
            f"{_MODEL_SEQ} AS seq")))
    return merge.drop_repeated_model(merge.union_layers(*layers))


def _ranked(severity: Column, layer: int, *columns: Column | str) -> Column:
    """What findings of a file are ordered by: severity, layer and ``columns`` (seq, rule_id, line_number)."""
    return F.struct(merge.severity_rank(severity).alias("rank"), F.lit(layer).alias("layer_order"), *columns)


def _of_rows(rows: DataFrame, leaks: Column) -> DataFrame:
    """What layers 1 and 2 tell of each row of ``Leaks``: path, sourced, n_lines, n findings, top (the first of them)."""
    def ranked(findings: Column, rule, severity, line: str, name: str, layer: int) -> Column:
        return F.transform(findings, lambda f: _ranked(
            severity(f), layer, F.concat(F.lpad(f[line].cast("string"), 8, "0"), f[name]).alias("seq"),
            rule(f).alias("rule_id"), f[line].alias("line_number")))
    found = F.concat(
        ranked(F.col("hits"), lambda f: f["rule_id"], lambda f: f["severity"], "line_number", "rule_name", 1),
        ranked(leaks, lambda f: F.lit(flow.RULE), lambda f: F.lit(flow.SEVERITY), "root_line", "root", 2))
    return rows.select("path", "sourced", "n_lines", found.alias("found")).select(
        "path", "sourced", "n_lines", F.size("found").cast("bigint").alias("n"), F.array_min("found").alias("top"))


def _of_files(told: flow.Leaks) -> DataFrame:
    """``_of_rows`` of all files, with ``n_files`` that are alike (rows of one path are one file).

    Only files that were not followed in their row are grouped.
    """
    rows = _of_rows(told.in_row, F.col("leaks")).withColumn("n_files", F.lit(1).cast("bigint"))
    if not told.has_apart:
        return rows
    apart = _of_rows(told.by_joins, F.slice("leaks", 1, 0)).withColumn("n_files", F.lit(1))
    leaked = flow.joined_leaks(told).groupBy("path", "root", "root_line").agg(F.count("*").alias("n")).select(
        "path", F.lit(True).alias("sourced"), F.lit(None).cast("int").alias("n_lines"), "n",
        _ranked(F.lit(flow.SEVERITY), 2, F.concat(F.lpad(F.col("root_line").cast("string"), 8, "0"), "root").alias("seq"),
                F.lit(flow.RULE).alias("rule_id"), F.col("root_line").alias("line_number")).alias("top"),
        F.lit(0).alias("n_files"))
    return rows.unionByName(apart.unionByName(leaked).groupBy("path").agg(
        F.max("sourced").alias("sourced"), F.max("n_lines").alias("n_lines"), F.sum("n").alias("n"), F.min("top").alias("top"),
        F.sum("n_files").alias("n_files")))


def _asked(clean: DataFrame, answers: DataFrame) -> DataFrame:
    """``_of_files`` of files without a finding with the confirmed findings of the model on existing lines, one a line.

    Files meet their answers in one join; items and their counts stay where the join has put them.
    """
    kept = ("sourced", "n_files", "n_lines", "asked")
    met = clean.drop("n", "top").join(answers.withColumn("asked", F.lit(True)), "path", "left").fillna({"asked": False})
    items = responses.told_items(responses.finding_items(met), *kept)
    exists = F.coalesce(F.col("confirmed") & F.col("line_number").between(1, F.col("n_lines")), F.lit(False))
    model = items.withColumns({"line_number": F.when(exists, F.col("line_number")), "seq": F.expr(_MODEL_SEQ)}).select(
        "path", *kept, "line_number", "severity", "vulnerability_type", "seq")
    first = merge.first_of_lines(model, *kept)
    top = F.when(F.col("line_number").isNotNull(), _ranked(
        F.col("severity"), 3, "seq", F.col("vulnerability_type").alias("rule_id"), "line_number"))
    return first.groupBy("path", *kept).agg(F.count("line_number").alias("n"), F.min(top).alias("top"))


def audit(files: DataFrame, answers: DataFrame | None = None, profile: R.Profile = R.LOCAL) -> DataFrame:
    """Per-file verdicts over all layers, naming the layers that ran: layer 2 on files with a source, the model's layer on
    files with an answer and no finding so far.

    Without answers nothing is shuffled but hashes of paths; with them, only files without a finding meet their answers.
    """
    of_files = _of_files(_told(files, profile))
    if answers is None:
        rows = of_files.withColumn("asked", F.lit(False))
    else:
        found = of_files.where("n > 0").withColumn("asked", F.lit(False))
        rows = found.unionByName(_asked(of_files.where("n = 0"), answers))
    ran = F.concat(F.lit("Layer1"), F.when(F.col("sourced"), " + Layer2").otherwise(""), F.when(F.col("asked"), " + V1.0").otherwise(""))
    each = rows.withColumn("_file", F.explode(F.sequence(F.lit(1).cast("bigint"), "n_files")))
    return merge.told_verdicts(each.select("path", ran.alias("ran_"), "n", "top", F.lit(None).cast("string").alias("found_in")))


def guard_documents(live: DataFrame, snapshot: DataFrame, reviews: DataFrame) -> DataFrame:
    """Accepted document changes of many projects.

    ``reviews(project, name, action, drift_score)`` holds the verdict of each proposed change; a change
    that is accepted (or was not reviewed as rejected) enters the new snapshot, a rejected one does not.
    """
    changed = snapshots.changed_documents(live, snapshot)
    rejected = reviews.where("action = 'REJECT'").select("project", "name")
    accepted = changed.join(rejected, ["project", "name"], "left_anti")
    return snapshots.sync(accepted, snapshot)
