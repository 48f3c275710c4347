"""Rules that project templates declare as text, re-aimed as line and file screens."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from auditloom import rules as R
from auditloom.functions import text as T
from auditloom.operators.screen import line_findings


def unvalidated_body(files: DataFrame, *keep: str) -> DataFrame:
    """Lines using a request body in files that name no validator."""
    unchecked = files.where(~T.contains_any("code", R.VALIDATORS))
    rule = R.LineRule("RULE_110", "unvalidated_body", R.BODY_USE, "CRITICAL")
    return line_findings(unchecked, (rule,), *keep)


def canonical_rule_id(finding_type: str) -> Column:
    """Canonical rule id of a finding type (column name); types without one get the taint-analysis id."""
    return T.lookup_sql(finding_type, R.RULE_IDS, T.lit(R.RULE_ID_DEFAULT))


DEFINITION = r"^\s*(?:async\s+)?(?:def|function|func)\s+([A-Za-z_][A-Za-z0-9_]*)"
_DEFINED = re.compile(DEFINITION, re.ASCII)


def function_spans(code: str) -> list[tuple[str, int, int, int]]:
    """(name, first line, number of lines, nesting depth) of each function of a text.

    A stack of open functions by indent: a line with words closes those that are not indented less; all others that
    are open hold it.  Blank lines belong to what is open.  Depth is the greatest indent inside, in steps of 4.
    """
    open_: list[list] = []
    out = []

    def close(own: list, end: int) -> None:
        name, start, _, depth = own
        out.append((name, start, end - start, max(0, depth)))

    n = 0
    for n, line in enumerate(code.split("\n"), 1):
        indent = len(line) - len(line.lstrip(" "))
        if line.strip(" "):
            while open_ and open_[-1][2] >= indent:
                close(open_.pop(), n)
            for own in open_:
                own[3] = max(own[3], (indent - own[2]) // 4 - 1)
            found = _DEFINED.match(line)
            if found:
                open_.append([found[1], n, indent, 0])
    while open_:
        close(open_.pop(), n + 1)
    return sorted(out, key=lambda f: f[1])


def _spanned(batches):
    for batch in batches:
        rows = [(path, *f) for path, code in zip(*(c.to_pylist() for c in batch.columns)) for f in function_spans(code)]
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                         ["path", "function", "start_line", "n_lines", "max_depth"])


def function_metrics(files: DataFrame, max_lines: int = 50, max_depth: int = 3) -> DataFrame:
    """Lines per function and nesting depth (indent width 4 inside the function as proxy), nested functions each.

    One pass over the texts that define a function; nothing is shuffled.
    """
    able = files.where(F.col("code").rlike(f"(?m){DEFINITION}")).select("path", "code")
    found = able.mapInArrow(_spanned, "path string, function string, start_line int, n_lines long, max_depth long")
    return found.withColumn("too_long", F.col("n_lines") > max_lines).withColumn(
        "too_deep", F.col("max_depth") > max_depth)


def layer_violations(files: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Imports a directory class may not make.

    ``forbidden(layer, module)``: a file with path component ``layer`` must not import ``module``.
    """
    lines = T.explode_lines(files, "path").select(
        "path", "line_no", F.explode(T.imported_names(F.col("line"))).alias("module"))
    layered = lines.withColumn("layer", F.explode(F.array_distinct(F.split("path", "/"))))
    return layered.join(forbidden, ["layer", "module"]).select(
        "path", "layer", "module", F.col("line_no").alias("line_number"))


def reasoning_flags(reasoning: str, weasel: Sequence[str] = R.WEASEL_PHRASES,
                    proximity: Sequence[str] = R.PROXIMITY_WORDS) -> tuple[Column, Column]:
    """(hedging, proximity) flags of a reasoning text; either one voids a finding."""
    low = f"lower({reasoning})"
    return T.contains_any(low, weasel), T.contains_any(low, proximity)
