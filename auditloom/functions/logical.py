"""Source texts as logical statements: lines joined over open brackets, strings and continuations.

A statement ends at a line feed outside of strings, comments and open round or square brackets (in Python of any
bracket) that no backslash escapes.  In other languages a block in braces opens statements of its own, also inside
round brackets, so the body of a function that is passed as an argument stays several statements.  Brackets without
a partner join nothing.

The state machine runs over the tokens of one text, inside the row; nothing is shuffled and a text leaves its task
as its statements only.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from auditloom import rules as R
from auditloom.functions import text as T

PARTNER = {")": "(", "]": "[", "}": "{"}
HASH_COMMENTS = ("python", "ruby", "bash")
PART = 500  # texts whose statements leave a task together
_QUOTED = r'"(?:\\.|[^"\\\n])*"|' + r"'(?:\\.|[^'\\\n])*'"
# Brackets one by one: with a first character in every branch the scan leaps from one possible token to the next.
_ENDS = r"\\\r?\n|\n|" + "|".join(map(re.escape, "()[]{}"))


def _within_line(not_in: str) -> str:
    """A pair of brackets on one line with no brackets, comments or escapes inside; it joins nothing, as one token."""
    inside = rf'(?:[^()\[\]{{}}"\'\\\n{not_in}]|"(?!"")[^"\\\n]*"|\'(?!\'\')[^\'\\\n]*\')*+'
    return rf"\({inside}\)|\[{inside}\]|\{{{inside}\}}"


_TRIPLE = r'"""(?:\\.|[^\\])*?(?:"""|\Z)|' + r"'''(?:\\.|[^\\])*?(?:'''|\Z)"
_TOKEN = {
    True: re.compile(rf"{_TRIPLE}|{_QUOTED}|#[^\n]*|{_within_line('#')}|{_ENDS}", re.S),
    False: re.compile(rf"//[^\n]*|/\*.*?(?:\*/|\Z)|`(?:\\.|[^`\\])*`|{_QUOTED}|{_within_line('/`')}|{_ENDS}", re.S)}


def _partners(marks: list[tuple[int, int, str]]) -> set[int]:
    """Positions of brackets that have a partner."""
    found, open_ = set(), []
    n_open = dict.fromkeys("([{", 0)
    for at, _, mark in marks:
        if mark in n_open:
            open_.append((at, mark))
            n_open[mark] += 1
        elif mark in PARTNER and n_open[PARTNER[mark]]:
            while True:
                begin, kind = open_.pop()
                n_open[kind] -= 1
                if kind == PARTNER[mark]:
                    break
            found |= {begin, at}
    return found


def statements(code: str, language: str) -> list[tuple[int, str]]:
    """(number of the first line, text) of each logical statement; its lines are parted by one space."""
    marks = [(m.start(), m.end(), token[-1]) for m in _TOKEN[language in HASH_COMMENTS].finditer(code)
             if len(token := m[0]) == 1 or token[-1] == "\n"]
    paired = _partners(marks)
    out, open_, start, line = [], [], 0, 1
    for at, end, mark in [*marks, (len(code), len(code), "")]:
        if mark and mark != "\n":
            if at in paired:
                open_.pop() if mark in PARTNER else open_.append(mark)
        elif not mark or end - at == 1 and not (open_ and (open_[-1] != "{" or language == "python")):
            text = code[start:at]
            if "\n" in text:
                pieces = [p.strip().removesuffix("\\").rstrip() for p in text.split("\n")]
                out.append((line, " ".join(p for p in pieces if p)))
            else:
                out.append((line, text.strip(" ")))
            line += text.count("\n") + 1
            start = end
    return [s for s in out if s[1]]


def _cut(marks: str):
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, PART):
                ends, lines, texts = [0], [], []
                part = batch.slice(k, PART)
                for language, code in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    found = statements(code, language) if code else []
                    if marks:
                        found = [s for s in found if any(m in s[1] for m in marks)]
                    lines += [n for n, _ in found]
                    texts += [t for _, t in found]
                    ends.append(len(lines))
                cut = pa.StructArray.from_arrays([pa.array(lines, pa.int32()), pa.array(texts, pa.string())], ["line_no", "line"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cut), *part.columns[3:]],
                    ["path", "language", "lines", *part.schema.names[3:]])
    return run


def logical_files(files: DataFrame, *keep: str, marks: str = "") -> DataFrame:
    """(path, language, lines: array of (line_no, line)) of ``files(path, ext, code)`` in a known language.

    With ``keep``, columns that go along, the rows of all files; those in no known language have no lines.  With ``marks``
    only statements that hold one of these characters.
    """
    language = T.lookup_sql("lower(ext)", R.LANGUAGE_OF).alias("language")
    own = files.select("path", language, "code", *keep)
    if keep:
        own = own.withColumn("code", F.expr("CASE WHEN language IS NOT NULL THEN code END"))
    else:
        own = own.where("language IS NOT NULL")
    kept = "".join(f", {c} {files.schema[c].dataType.simpleString()}" for c in keep)
    return own.mapInArrow(_cut(marks), "path string, language string, lines array<struct<line_no int, line string>>" + kept)


def logical_lines(files: DataFrame) -> DataFrame:
    """(path, language, line_no, line) of every logical statement of ``files(path, ext, code)`` in a known language."""
    return logical_files(files).selectExpr("path", "language", "inline(lines)")
