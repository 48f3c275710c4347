"""Column expressions over file texts."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from auditloom.rules import LineRule, Rule


def lit(value: str) -> str:
    """SQL string literal.  Wide expressions are built as one SQL text: it parses at once, while each
    Column operation costs a round trip to the JVM."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any_sql(text: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def contains_any(text: str, words: Iterable[str]) -> Column:
    """True if ``text`` (a SQL expression) holds one of ``words`` (plain substrings)."""
    return F.expr(contains_any_sql(text, words))


def unify_newlines(text: Column) -> Column:
    """CRLF and lone CR become LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def split_lines(text: Column) -> Column:
    """Lines of a text; a trailing newline gives a last empty line."""
    return F.split(text, "\n", -1)


def line_count(text: Column) -> Column:
    """Number of lines, not counting an empty last one."""
    extra = F.when((text == "") | text.endswith("\n"), 1).otherwise(0)
    return F.size(split_lines(text)) - extra


def one_decimal(number: Column) -> Column:
    """A number with one decimal as text; a tie goes to the even digit, as in C and Python and not as in Java."""
    return F.format_string("%.1f", F.bround(number, 1))


def numbered(text: Column, before: Column | str = "", after: str = " | ") -> Column:
    """Text with each line prefixed by ``before`` + line number + ``after``."""
    head = F.lit(before) if isinstance(before, str) else before
    return F.array_join(
        F.transform(split_lines(text),
                    lambda line, i: F.concat(head, (i + 1).cast("string"), F.lit(after), line)), "\n")


def explode_lines(files: DataFrame, *keep: str, text: str = "code") -> DataFrame:
    """One row per line: the kept columns, ``line_no`` from 1, ``line``."""
    return files.select(*keep, F.posexplode(split_lines(F.col(text))).alias("_pos", "line")).select(
        *keep, (F.col("_pos") + 1).alias("line_no"), "line")


# Characters whose presence is tested once per text and shared by all rules that need them.
SHARED_MARKS = {"(": "_has_paren", "=": "_has_equals", "_": "_has_underscore", "<": "_has_angle"}


def prepared(df: DataFrame, text: str, where: str = "TRUE") -> DataFrame:
    """Add what ``hit_count_sql`` reads besides the text: its lower-cased form and the shared marks.

    Rows outside ``where`` get nulls and cost nothing.
    """
    marks = [f"CASE WHEN {where} THEN contains({text}, {lit(c)}) END AS {name}" for c, name in SHARED_MARKS.items()]
    return df.selectExpr("*", f"CASE WHEN {where} THEN lower({text}) END AS _lowered", *marks)


PREPARED = ("_lowered", *SHARED_MARKS.values())


def hit_count_sql(text: str, rule: Rule) -> str:
    """Non-overlapping matches of a rule in a prepared text; the regex runs only on texts that can match."""
    count = f"regexp_count({text}, {lit(rule.pattern)})"
    tests = [SHARED_MARKS[w] for w in rule.must if w in SHARED_MARKS]
    if rule.needles:
        tests.append(contains_any_sql("_lowered", rule.needles))
    tests += [f"contains({text}, {lit(w)})" for w in rule.must if w not in SHARED_MARKS]
    return f"CASE WHEN {' AND '.join(tests)} THEN {count} ELSE 0 END" if tests else count


def computed_once(df: DataFrame, name: str, value: Column | str) -> DataFrame:
    """Add a costly column so that filters on it are not rewritten into copies of its expression.

    The optimizer pushes a filter below a projection by substituting the expression; a one-element
    explode is not passed, so the value is computed once and then filtered.
    """
    value = F.expr(value) if isinstance(value, str) else value
    return df.select("*", F.explode(F.array(value)).alias(name))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Suffix of the file name with its dot, or an empty string."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]*[^.])$", 1)


def has_part(path: Column, parts: Iterable[str]) -> Column:
    """True if a path component is one of ``parts``."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in parts]))


def glob_regex(pattern: str) -> str:
    """Anchored regex of a glob: ``**`` is anything, ``*`` anything but a slash."""
    out = []
    for piece in pattern.split("**"):
        stars = ["".join("\\" + c if c in ".+^${}()|[]\\" else c for c in part)
                 for part in piece.split("*")]
        out.append("[^/]*".join(stars))
    return "^" + ".*".join(out) + "$"


def line_matches_sql(line: str, rule: LineRule) -> str:
    hit = f"{line} RLIKE {lit(rule.pattern)}"
    return f"({hit})" if rule.allow is None else f"({hit} AND NOT {line} RLIKE {lit(rule.allow)})"


def compact(items: Column) -> Column:
    """Array without its null items."""
    return F.filter(items, lambda x: x.isNotNull())


def lookup(value: Column, mapping: dict, otherwise) -> Column:
    """Value mapped through a fixed dict."""
    out = None
    for k, v in mapping.items():
        out = F.when(value == k, F.lit(v)) if out is None else out.when(value == k, F.lit(v))
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


# Import statements (first match of each per line).
IMPORT_PATTERNS = (
    r"import\s+(\w+)",
    r"from\s+(\w+)\s+import",
    r"require\(['\"](\w+)['\"]\)",
    r"import.*from\s+['\"](\w+)['\"]",
    r"import\s+['\"](\w+)['\"]",
)


def imported_names(line: Column) -> Column:
    """Distinct lower-cased names a line imports."""
    found = F.array(*[F.regexp_extract(line, p, 1) for p in IMPORT_PATTERNS])
    return F.array_distinct(F.transform(F.filter(found, lambda x: x != ""), F.lower))


def lookup_sql(value: str, mapping: dict[str, str], otherwise: str = "NULL") -> Column:
    """``lookup`` for a SQL expression and text values."""
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return F.expr(f"CASE {value} {whens} ELSE {otherwise} END")
