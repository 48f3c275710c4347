"""Source -> propagation -> sink relations of logical statements, and reachability by joins.

A syntax tree per file is replaced by relations of statements, kept as lists in one row per file (``relations``).  Files
are followed in their row; long ones by joins over (path, line_no) of names and line numbers, with texts fetched at the
end, for the few statements that are reported.

Two questions are asked.  ``reach`` follows variables by name, in any order of statements, as propagation reports do.
``unsanitised`` follows definitions: a use reads the last assignment of its variable above it, so a value printed
before it is sanitised leaks, and one that is assigned anew does not.  Programs are taken as straight lines; branches
and loops are read once, from top to bottom.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T_

from auditloom import rules as R
from auditloom.functions import text as T
from auditloom.functions.logical import PART, logical_files
from auditloom.functions.session import materialise, scratch_path

NAME = r"[A-Za-z_][A-Za-z0-9_]*"
# Runs are possessive and calls begin where a name begins: no shorter or later run could match, so none is tried.
ASSIGN = rf"^\s*+(?:[A-Za-z_][A-Za-z0-9_<>,\[\]]*+\s++)*({NAME}+)\s*+:?=\s*+([^=\s].*+)$"
CALL = r"(?<![A-Za-z_])([A-Za-z_][A-Za-z0-9_.:]*+)!?+\s*+\("
NOT_CALLS = ("if", "for", "while", "switch", "return", "catch", "elif", "with")
QUOTES = "\"'"
STRING = r"\"[^\"]*\"|'[^']*'"
RULE, SEVERITY = "L2-DATA-FLOW", "HIGH"  # of findings of unsanitised flow
BOUNDARY = 3  # depth from which a trace is marked


@dataclass(frozen=True)
class SinkRegistry:
    """Names and patterns of calls that make a value safe."""

    middleware: tuple[str, ...] = R.SINK_MIDDLEWARE
    decorators: tuple[str, ...] = R.SINK_DECORATORS
    patterns: tuple[str, ...] = R.SINK_PATTERNS

    @classmethod
    def from_rows(cls, rows: Iterable) -> "SinkRegistry":
        """From rows (kind, value), e.g. of ``sources.config.sink_table``."""
        by_kind: dict[str, list[str]] = {"middleware": [], "decorators": [], "patterns": []}
        for row in rows:
            by_kind[row["kind"]].append(row["value"])
        return cls(*(tuple(dict.fromkeys(by_kind[k])) for k in ("middleware", "decorators", "patterns")))


def _last_part(callee: Column) -> Column:
    return F.substring_index(F.substring_index(callee, ".", -1), ":", -1)


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``value`` as ``name``, computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _names_words_of_language(words: dict[str, tuple[str, ...]]) -> str:
    """SQL: the line holds one of its language's words, in any case."""
    known = f"language IN {_in(words)}"
    return f"(CASE WHEN {known} THEN " + _let("lowered", "lower(line)", " OR ".join(
        f"(language = {T.lit(lang)} AND {T.contains_any_sql('lowered', [w.lower() for w in ws])})"
        for lang, ws in words.items())) + f" ELSE {known} END)"


def _in(words: Iterable[str]) -> str:
    return "(" + ", ".join(T.lit(w) for w in words) + ")"


def _sink_sql(sinks: SinkRegistry) -> str:
    """Name of the first sanitising call of a line, or null."""
    last = "substring_index(substring_index({}, '.', -1), ':', -1)".format
    named = f"get(filter(calls, c -> {last('c')} IN {_in(sinks.middleware + sinks.decorators)}), 0)"
    pattern = " OR ".join(f"line RLIKE {T.lit(p)}" for p in sinks.patterns)
    within = T.contains_any_sql("line", sinks.middleware)
    return (f"CASE WHEN size(calls) > 0 THEN coalesce({last(named)}, CASE WHEN {pattern} "
            f"OR (language <> 'python' AND {within}) THEN {last('get(calls, 0)')} END) END")


_DEFINED = r"^\s*(?:async\s+)?(?:def|function|func|class)\s"
_TARGET = f"CASE WHEN contains(line, '=') THEN get(filter(array(regexp_extract(line, {T.lit(ASSIGN)}, 1)), v -> v <> ''), 0) END"
_CALLS = (f"CASE WHEN NOT contains(line, '(') OR ({T.contains_any_sql('line', ('def', 'func', 'class'))} "
          f"AND line RLIKE {T.lit(_DEFINED)}) THEN array() "
          f"ELSE filter(regexp_extract_all(line, {T.lit(CALL)}, 1), c -> c NOT IN {_in(NOT_CALLS)}) END")


def _called(met: bool) -> str:
    """SQL: the calls of a line; of one that does not assign only if sanitisers it meets are asked for."""
    return _CALLS if met else f"CASE WHEN target IS NULL THEN array() ELSE {_CALLS} END"


def _rhs(line: str, target: str) -> str:
    """SQL: the right side.  No part of a target holds "=", so it starts after the first one."""
    return (f"CASE WHEN {target} IS NOT NULL THEN rtrim({T.lit('; ' + chr(9) + chr(13))}, "
            f"ltrim(substring({line}, instr({line}, '=') + 1))) END")


_PARTS = ("line_no", "line", "target", "rhs", "calls", "sink", "output")


def statement_lists(files: DataFrame, sinks: SinkRegistry = SinkRegistry()) -> DataFrame:
    """One row per file: path, language, ``st``, the list of its statements with their parts as in ``statements``."""
    # A part is an array of its own until the end: arrays of structs would be copied from one step to the next.
    known = logical_files(files).selectExpr(
        "path", "language", "lines.line_no AS line_no", "lines.line AS line",
        f"transform(lines.line, line -> {_TARGET}) AS target", f"transform(lines.line, line -> {_CALLS}) AS calls")
    sunk = known.selectExpr("*", f"zip_with(line, target, (line, target) -> {_rhs('line', 'target')}) AS rhs",
                            f"zip_with(line, calls, (line, calls) -> {_sink_sql(sinks)}) AS sink")
    may = "zip_with(sink, calls, (sink, calls) -> sink IS NULL AND size(calls) > 0)"
    shown = sunk.selectExpr("*", f"zip_with(line, {may}, (line, may) -> coalesce(may AND {_names_words_of_language(R.UNSAFE_OUTPUT)}, "
                            "false)) AS output")
    return shown.selectExpr("path", "language", f"arrays_zip({', '.join(_PARTS)}) AS st")


def statements(files: DataFrame, sinks: SinkRegistry = SinkRegistry()) -> DataFrame:
    """One row per logical statement with its parts: path, language, line_no (its first line), line (its text), target,
    rhs, calls, sink, output (an output call of the language without a sanitiser)."""
    # Outer, since a test for empty lists would be pushed down as a copy of all expressions.
    return statement_lists(files, sinks).selectExpr("path", "language", "inline_outer(st)").where("line_no IS NOT NULL")


# Right sides that are one call or one subscript: a name and what is attached to it, with the last bracket closing
# the first one it opened.  Brackets are balanced to three levels.
_ROUND = r"\([^()]*\)"
for _ in range(2):
    _ROUND = rf"\([^()]*(?:{_ROUND}[^()]*)*\)"
_SQUARE = r"\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\]"
_ATTACHED = rf"(?:\s*{_ROUND}|\s*{_SQUARE}|\s*\.\s*[A-Za-z_][A-Za-z0-9_]*)*"
ONE_CALL = rf"^([A-Za-z_][A-Za-z0-9_.]*){_ATTACHED}\s*{_ROUND}$"
SUBSCRIPT = rf"^[A-Za-z_][A-Za-z0-9_.]*{_ATTACHED}\s*{_SQUARE}$"


def _form_sql() -> str:
    """How the right side of an assignment is classed: Python by form, other languages by external-input names."""
    def is_(pattern: str, what: str = "rhs") -> str:
        return f"{what} RLIKE {T.lit(pattern)}"
    safe = " OR ".join(f"startswith(callee, {T.lit(w)})" for w in R.SAFE_CALL_PREFIXES)
    called = _let("callee", f"regexp_extract(bare, {T.lit(ONE_CALL)}, 1)", (
        f"CASE WHEN callee = '' THEN 'OTHER' WHEN {safe} THEN 'SAFE_TRANSFORMATION' "
        f"WHEN sink IS NOT NULL THEN 'OTHER' ELSE 'EXTERNAL_INPUT' END"))
    # Brackets inside of strings are not brackets.
    bare = f"CASE WHEN contains(rhs, '\\'') OR contains(rhs, '\"') THEN regexp_replace(rhs, {T.lit(STRING)}, '\"\"') ELSE rhs END"
    by_call = _let("bare", bare, f"CASE WHEN {is_(SUBSCRIPT, 'bare')} THEN 'EXTERNAL_INPUT' ELSE {called} END")
    return (f"CASE WHEN language <> 'python' THEN CASE WHEN {_names_words_of_language(R.EXTERNAL_INPUT)} "
            f"THEN 'EXTERNAL_INPUT' END "
            f"WHEN {is_('^[rR]?[fF][' + QUOTES + ']')} THEN 'F_STRING_TEMPLATE' "
            f"WHEN {is_('^[' + QUOTES + '].*[' + QUOTES + r']\s*%\s')} THEN 'FORMAT_OPERATOR' "
            f"WHEN {is_('^[' + QUOTES + ']')} THEN 'LITERAL_STRING' ELSE {by_call} END")


_MARKED = ("variable", "line_no", "expression", "node_type", "clean")
_EXTERNAL = _in(("EXTERNAL_INPUT", "F_STRING_TEMPLATE", "FORMAT_OPERATOR"))


def source_statements(stmts: DataFrame) -> DataFrame:
    """Statements that assign external input: path, language, variable, line_no, expression, node_type, clean (the
    value passes a sanitiser at once)."""
    classed = T.computed_once(stmts.where("target IS NOT NULL"), "node_type", _form_sql())
    return classed.where(f"node_type IN {_EXTERNAL}").selectExpr(
        "path", "language", "target AS variable", "line_no", "line AS expression", "node_type", "sink IS NOT NULL AS clean")


def _marked_list() -> str:
    """SQL: ``source_statements`` of the list ``st`` of a file."""
    form = _form_sql()
    for name in ("rhs", "line", "sink"):
        form = _let(name, f"s.{name}", form)
    marked = (f"transform(filter(st, s -> s.target IS NOT NULL), s -> named_struct('variable', s.target, 'line_no', s.line_no, "
              f"'expression', s.line, 'node_type', {form}, 'clean', s.sink IS NOT NULL))")
    return f"filter({marked}, s -> coalesce(s.node_type IN {_EXTERNAL}, false))"


def sources(stmts: DataFrame) -> DataFrame:
    """``listed_sources`` of statements, which are parsed once and written as a table of the marked ones."""
    return listed_sources(materialise(source_statements(stmts), "sources"))


def listed_sources(found: DataFrame) -> DataFrame:
    """Variables assigned from external input, of ``source_statements``: path, variable, line_no, expression,
    node_type; in languages other than Python one row per variable and file (its first line)."""
    columns = ("line_no", "expression", "node_type")
    other = (found.where("language <> 'python'").groupBy("path", "variable").agg(F.min(F.struct(*columns)).alias("s"))
             .select("path", "variable", "s.*"))
    return found.where("language = 'python'").select("path", "variable", *columns).unionByName(other)


# Names read in a text: what stands after a dot is no name of its own.
_NAMES = (r"regexp_extract_all(plain, '" + (r"\.\s*+[A-Za-z_][A-Za-z0-9_]*+|([A-Za-z_][A-Za-z0-9_]*+)").replace("\\", "\\\\") + "', 1)")


def _plain(value: str, body: str) -> str:
    """SQL: ``body`` with the text ``value`` without its plain strings as ``plain``."""
    quoted = r"(?:^|[^A-Za-z0-9_])[rR]?[fF][" + QUOTES + "]"
    plain = (f"CASE WHEN NOT (contains(t, '\\'') OR contains(t, '\"')) OR contains(t, '${{') "
             f"OR ({T.contains_any_sql('t', [f + q for f in 'fF' for q in QUOTES])} AND t RLIKE {T.lit(quoted)}) "
             f"THEN t ELSE regexp_replace(t, {T.lit(STRING)}, '\"\"') END")
    return _let("t", value, _let("plain", plain, body))


def _uses_list(assigned: bool = True, read: str = "s.target IS NOT NULL OR size(s.calls) > 0") -> str:
    """SQL: names ``read`` by the statements of the list ``st`` of a file, as (line_no, variable, target, sink, output).

    Names that no statement of the file assigns (``made``) take part in no relation and are left out if ``assigned``, as are
    statements that neither assign nor call.
    """
    own = f"array_intersect({_NAMES}, made)" if assigned else f"filter(array_distinct({_NAMES}), v -> v <> '')"
    names = _plain(f"coalesce({_rhs('s.line', 's.target')}, s.line)", own)
    use = "named_struct('line_no', s.line_no, 'variable', v, 'target', s.target, 'sink', s.sink, 'output', s.output)"
    return (f"flatten(transform(filter(st, s -> {read}), "
            f"s -> transform({names}, v -> {use})))")


@dataclass(frozen=True)
class _InRows:
    """A written table of a row per file, ``files`` (path, key, size, lists).

    Files are followed in their row.  ``apart`` has the keys (hashes of paths) of those that are not: files of more than
    ``CLOSED`` entries, and rows that share their path with others and are one file together.  They meet in joins.
    """

    files: DataFrame
    apart: DataFrame
    has_apart: bool

    @property
    def in_row(self) -> DataFrame:
        return self.files.join(self.apart, "key", "left_anti") if self.has_apart else self.files

    @property
    def by_joins(self) -> DataFrame:
        return self.files.join(self.apart, "key", "left_semi")


@dataclass(frozen=True)
class Relations(_InRows):
    """Relations of a set of files in one written table, a row per file: ``files`` (path, language, key, size, st, marked,
    uses), the lists of ``statements``, ``source_statements`` and names read."""

    def listed(self, name: str, files: DataFrame | None = None) -> DataFrame:
        """A list of the files as rows with their path and language."""
        return (self.files if files is None else files).selectExpr("path", "language", f"inline({name})")

    @property
    def statements(self) -> DataFrame:
        return self.listed("st")

    @property
    def marked(self) -> DataFrame:
        return self.listed("marked")

    @property
    def sources(self) -> DataFrame:
        return listed_sources(self.marked)

    @property
    def uses_by_joins(self) -> DataFrame:
        """Names read by the files that meet in joins; what one row reads another row of the path may assign."""
        return self.by_joins.selectExpr("path", f"inline({_uses_list(assigned=False)})")

    @property
    def uses(self) -> DataFrame:
        in_row = self.in_row.selectExpr("path", "inline(uses)")
        return in_row.unionByName(self.uses_by_joins) if self.has_apart else in_row


def relations(files: DataFrame, sinks: SinkRegistry = SinkRegistry()) -> Relations:
    """The relations of the files as a written table: texts are parsed once, and a file's lists stay in its row."""
    parts = statement_lists(files, sinks).selectExpr(
        "*", "xxhash64(path) AS key", "filter(st.target, v -> v IS NOT NULL) AS made").selectExpr(
        "*", f"{_marked_list()} AS marked", f"{_uses_list()} AS uses")
    kept = ("line_no", "line", "target", "calls", "sink", "output")
    parts = materialise(parts.selectExpr(
        "path", "language", "key", "size(st) + size(marked) + size(uses) AS size",
        f"arrays_zip({', '.join(f'st.{c}' for c in kept)}) AS st", "marked", "uses"), "flow")
    return Relations(parts, *_apart(parts))


def _apart(parts: DataFrame) -> tuple[DataFrame, bool]:
    """Keys of the files that are not followed in their row, and whether there are any."""
    apart = materialise(parts.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n")).where(
        (F.col("size") > CLOSED) | (F.col("n") > 1)).select("key"), "flow-apart")
    return apart, not apart.isEmpty()


@dataclass(frozen=True)
class Leaks(Relations):
    """Relations of which only statements that assign or may put out are kept, with ``leaks`` of each file (root, root_line,
    line_no, line), told as it was parsed, ``sourced`` (it has a source) and the columns that go along."""

    @property
    def uses_by_joins(self) -> DataFrame:
        return self.by_joins.selectExpr("path", f"inline({_uses_list(assigned=False, read='TRUE')})")

    @property
    def findings(self) -> DataFrame:
        """``unsanitised`` of the files."""
        leaked = self.in_row.selectExpr("path", "inline(leaks)")
        return _leak_findings(leaked.unionByName(joined_leaks(self)) if self.has_apart else leaked)


def leaks(files: DataFrame, *keep: str, sinks: SinkRegistry = SinkRegistry()) -> Leaks:
    """The leaks of the files in one written table with a row for every file: its texts are parsed and it is followed
    in one pass, and only statements that take part are written.

    Calls are looked for only in statements that assign or hold a word of an output, names only where a source is not
    sanitised at once and something is put out.
    """
    shown = f"transform(lines.line, line -> contains(line, '(') AND coalesce({_names_words_of_language(R.UNSAFE_OUTPUT)}, false))"
    known = logical_files(files, *keep, marks="=(").selectExpr(
        "path", "language", *keep, "lines.line_no AS line_no", "lines.line AS line",
        f"transform(lines.line, line -> {_TARGET}) AS target", f"{shown} AS shown")
    wanted = "zip_with(target, shown, (target, shown) -> target IS NOT NULL OR shown)"
    called = known.selectExpr("*", f"zip_with(line, {wanted}, (line, wanted) -> CASE WHEN wanted THEN {_CALLS} ELSE array() END) AS calls")
    sunk = called.selectExpr("path", "language", *keep, "line_no", "line", "target", "shown", "calls",
                             f"zip_with(line, calls, (line, calls) -> {_sink_sql(sinks)}) AS sink")
    st = ("filter(transform(arrays_zip(line_no, line, target, sink, shown, calls), s -> named_struct('line_no', s.line_no, 'line', s.line, "
          f"'target', s.target, 'rhs', {_rhs('s.line', 's.target')}, 'sink', s.sink, 'output', "
          "s.shown AND s.sink IS NULL AND size(s.calls) > 0)), s -> s.target IS NOT NULL OR s.output)")
    parts = sunk.selectExpr("path", "language", *keep, f"{st} AS st", "filter(target, v -> v IS NOT NULL) AS made").selectExpr(
        "*", f"{_marked_list()} AS found")
    marked = "transform(found, s -> named_struct('variable', s.variable, 'line_no', s.line_no, 'clean', s.clean))"
    # Names of a statement go as one text: a list in each statement of a list costs most of what following costs.
    names = _plain("coalesce(s.rhs, s.line)", f"array_join(array_intersect({_NAMES}, made), ' ')")
    passes = "s.target IS NOT NULL AND s.sink IS NULL"
    read = (f"CASE WHEN exists(found, s -> NOT s.clean) AND exists(st, s -> s.output) THEN transform(st, s -> named_struct("
            "'line_no', s.line_no, 'target', s.target, 'source', exists(found, m -> m.line_no = s.line_no AND NOT m.clean), "
            f"'passes', {passes}, 'output', s.output, 'names', CASE WHEN ({passes}) OR s.output THEN {names} ELSE '' END)) ELSE array() END")
    read = parts.selectExpr("path", "language", *keep, "st", f"{marked} AS marked", f"{read} AS read").selectExpr(
        "*", "size(st) + size(marked) + aggregate(read, 0, (n, s) -> n + size(split(s.names, ' '))) AS size")
    followed = read.withColumn("leaks", _leaks_in_row(None)(F.expr(f"CASE WHEN size <= {CLOSED} THEN read ELSE array() END")))
    text = "get(filter(st, s -> s.line_no = k.line_no), 0).line"
    parts = materialise(followed.selectExpr(
        "path", "language", *keep, "xxhash64(path) AS key", "size",
        "transform(st, s -> named_struct('line_no', s.line_no, 'line', s.line, 'target', s.target, 'sink', s.sink, 'output', s.output)) AS st",
        "marked", "size(marked) > 0 AS sourced", "transform(leaks, k -> named_struct('root', k.root, 'root_line', k.root_line, "
        f"'line_no', k.line_no, 'line', {text})) AS leaks"), "leaks")
    return Leaks(parts, *_apart(parts))


@dataclass(frozen=True)
class Traces(_InRows):
    """What ``reach`` follows, and no more, in one written table, a row per file: ``files`` (path, key, size, seeds, steps,
    met), the names of sources, steps (variable, next_variable) and names that meet a sanitiser."""

    @property
    def seed_rows(self) -> DataFrame:
        return self.by_joins.selectExpr("path", "explode(seeds) AS root").selectExpr("path", "root", "root AS variable")

    @property
    def step_rows(self) -> DataFrame:
        return self.by_joins.selectExpr("path", "inline(steps)").distinct()


def traces(files: DataFrame, sinks: SinkRegistry = SinkRegistry(), met: bool = False) -> Traces:
    """The traces of the files; ``met`` (variable, line_no, sink_name) are listed only if asked for.

    Statements that neither assign nor, for ``met``, call are dropped before they are parsed, and neither texts nor
    output calls are looked at or written.
    """
    kept = "contains(s.line, '=')" + (" OR contains(s.line, '(')" if met else "")
    known = logical_files(files).selectExpr("path", "language", f"filter(lines, s -> {kept}) AS lines").selectExpr(
        "path", "language", "lines.line_no AS line_no", "lines.line AS line", f"transform(lines.line, line -> {_TARGET}) AS target")
    called = known.selectExpr("*", f"zip_with(line, target, (line, target) -> {_called(met)}) AS calls")
    sunk = called.selectExpr("*", f"zip_with(line, target, (line, target) -> {_rhs('line', 'target')}) AS rhs",
                             f"zip_with(line, calls, (line, calls) -> {_sink_sql(sinks)}) AS sink")

    def names(but: str) -> str:
        return _plain("coalesce(s.rhs, s.line)", f"array_except({_NAMES}, array('', {but}))")

    steps = (f"flatten(transform(filter(st, s -> s.target IS NOT NULL AND s.sink IS NULL), s -> transform({names('s.target')}, "
             "v -> named_struct('variable', v, 'next_variable', s.target))))")
    hits = (f"flatten(transform(filter(st, s -> s.sink IS NOT NULL), s -> transform({names(T.lit(''))}, "
            "v -> named_struct('variable', v, 'line_no', s.line_no, 'sink_name', s.sink))))")
    lists = {"seeds": f"array_distinct({_marked_list()}.variable)", "steps": steps} | ({"met": hits} if met else {})
    parts = sunk.selectExpr("path", "language", "arrays_zip(line_no, line, target, rhs, calls, sink) AS st").selectExpr(
        "path", "xxhash64(path) AS key", *[f"{value} AS {name}" for name, value in lists.items()])
    parts = materialise(parts.selectExpr("*", f"{' + '.join(f'size({name})' for name in lists)} AS size"), "traces")
    return Traces(parts, *_apart(parts))


CLOSED = 2_000  # steps and seeds of a file up to which its closure is taken in the row


def _lists(column: pa.ListArray) -> list[list[tuple]]:
    """Lists of structs as lists of tuples."""
    rows = list(zip(*(f.to_pylist() for f in column.flatten().flatten())))
    out, at = [], 0
    for n in pc.fill_null(pc.list_value_length(column), 0).to_pylist():
        out.append(rows[at:at + n])
        at += n
    return out


def _followed(seeds: list[tuple], steps: list[tuple], n_root: int, n_node: int, max_depth: int | None):
    """New rows (root..., node...) of every round from ``seeds``, by steps (node..., next_node...), and its number."""
    after = {}
    for step in steps:
        after.setdefault(step[:n_node], []).append(step[n_node:])
    new = seen = set(seeds)
    depth = 0
    while new:
        yield depth, new
        if depth == max_depth:
            break
        depth += 1
        new = {row[:n_root] + to for row in new for to in after.get(row[n_root:], ())} - seen
        seen = seen | new


def _closed(n_root: int, n_node: int, max_depth: int | None):
    """Rows (path, seeds, steps) of a file to rows (path, root..., node..., depth)."""
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, PART):
                out = []
                paths, *lists = batch.slice(k, PART).columns
                for path, seeds, steps in zip(paths.to_pylist(), *map(_lists, lists)):
                    for depth, new in _followed(seeds, steps, n_root, n_node, max_depth):
                        out += [(path, *row, depth) for row in new]
                        if len(out) >= 100_000:
                            yield out
                            out = []
                yield out
    return run


def _closed_rows(files: DataFrame, names: list[str], types: dict[str, str], n_root: int, max_depth: int | None) -> DataFrame:
    """Rows (path, root..., node..., depth) of ``files(path, seeds, steps)``, followed in the row."""
    schema = ", ".join(f"{c} {types[c]}" for c in names) + ", depth int"
    fields = pa.schema([(c, pa.string() if types[c] == "string" else pa.int32()) for c in names] + [("depth", pa.int32())])
    rows = _closed(n_root, len(names) - 1 - n_root, max_depth)

    def run(batches):
        for out in rows(batches):
            columns = zip(*out) if out else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    return files.mapInArrow(run, schema)


def _type(rows: DataFrame) -> T_.StructType:
    """Type of the rows without their path."""
    return T_.StructType(rows.schema.fields[1:])


def closure(seeds: DataFrame, steps: DataFrame, root: list[str], node: list[str],
            max_depth: int | None = None) -> DataFrame:
    """All that ``seeds`` (path, root..., node...) reach by ``steps`` (path, node..., next_node...), with the least
    number of steps as ``depth``; seeds are at 0.

    The steps of a file of up to ``CLOSED`` steps and seeds meet once and are followed in the row, so nothing moves
    from round to round.  Longer files, of any length, are followed by joins, see ``_closure_by_joins``.
    """
    names = ["path", *root, *node]
    seeds, steps = seeds.select(*names), steps.select("path", *node, *[f"next_{c}" for c in node])
    sized = seeds.select("path").unionByName(steps.select("path")).groupBy("path").agg(F.count("*").alias("n"))
    long = materialise(sized.where(F.col("n") > CLOSED).select("path"), "reach-long")
    has_long = not long.isEmpty()

    # Seeds and steps of a file meet in one shuffle; repeats are dropped before they move.
    of_seed, of_step = F.struct(*seeds.columns[1:]), F.struct(*steps.columns[1:])
    both = seeds.select("path", of_seed.alias("seed"), F.lit(None).cast(_type(steps)).alias("step")).unionByName(
        steps.select("path", F.lit(None).cast(_type(seeds)).alias("seed"), of_step.alias("step")))
    short = both.join(long, "path", "left_anti") if has_long else both
    files = short.groupBy("path").agg(F.collect_set("seed").alias("seeds"), F.collect_set("step").alias("steps")).where(
        "size(seeds) > 0")

    followed = _closed_rows(files, names, dict(seeds.dtypes), len(root), max_depth)
    if not has_long:
        return followed
    return followed.unionByName(_closure_by_joins(
        seeds.join(long, "path", "left_semi"), steps.join(long, "path", "left_semi").distinct(), root, node, max_depth))


def _closure_by_joins(seeds: DataFrame, steps: DataFrame, root: list[str], node: list[str],
                      max_depth: int | None = None) -> DataFrame:
    """``closure`` of files of any length.

    Semi-naive: only what the last round has found new is joined with the steps, until there is nothing new (or
    ``max_depth`` is reached).  Rounds are written side by side into one folder, so lineage stays short and all of them
    are one scan; their number is the longest chain.
    """
    names = ["path", *root, *node]
    spark, folder = seeds.sparkSession, scratch_path(seeds.sparkSession, "reach")
    steps = materialise(steps, "reach-steps")
    new, depth = seeds.select(*names).distinct(), 0
    schema = new.withColumn("depth", F.lit(0)).schema

    def written(rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{folder}/depth={depth}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/depth={depth}")

    new = written(new)
    while depth != max_depth and not new.isEmpty():
        seen = spark.read.schema(schema).parquet(folder)
        depth += 1
        found = new.join(steps, ["path", *node]).select(
            "path", *root, *[F.col(f"next_{c}").alias(c) for c in node]).distinct()
        new = written(found.join(seen, names, "left_anti"))
    return spark.read.schema(schema).parquet(folder)


def _reached_names(seeds: list[str], steps: list[tuple[str, str]], max_depth: int | None):
    """Each root of a file with what it reaches, a dict of names to their least depth, in order of depth."""
    after = {}
    for variable, to in steps:
        after.setdefault(variable, []).append(to)
    for root in seeds:
        depth, queue = {root: 0}, [root]
        for variable in queue:
            next_depth = depth[variable] + 1
            if max_depth is not None and next_depth > max_depth:
                break
            for to in after.get(variable, ()):
                if to not in depth:
                    depth[to] = next_depth
                    queue.append(to)
        yield root, depth


def _strings(column: pa.ListArray) -> list[list[str]]:
    """Lists of strings, none for null."""
    return [x or [] for x in column.to_pylist()]


def _reaching_rows(max_depth: int | None):
    """Rows (path, seeds, steps) of a file to rows (path, root, variable, depth)."""
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, PART):
                paths, seeds, steps = batch.slice(k, PART).columns
                out = [[], [], [], []]
                for path, own, after in zip(paths.to_pylist(), _strings(seeds), _lists(steps)):
                    for root, depth in _reached_names(own, after, max_depth):
                        out[0] += [path] * len(depth)
                        out[1] += [root] * len(depth)
                        out[2] += depth
                        out[3] += depth.values()
                        if len(out[0]) >= 100_000:
                            yield _reached_batch(out)
                            out = [[], [], [], []]
                yield _reached_batch(out)
    return run


def _reached_batch(columns: list[list]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.string(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["path", "root", "variable", "depth"])


def _names_reached(max_depth: int | None):
    """(seeds, steps) of a file to its names that are reached, with the least and the greatest depth over its roots."""
    name = pa.struct([("variable", pa.string()), ("least", pa.int32()), ("most", pa.int32())])

    def run(seeds: pa.Array, steps: pa.Array) -> pa.Array:
        ends, names, least, most = [0], [], [], []
        for own, after in zip(_strings(seeds), _lists(steps)):
            low, high = {}, {}
            for _, depth in _reached_names(own, after, max_depth):
                for variable, at in depth.items():
                    low[variable] = min(at, low.get(variable, at))
                    high[variable] = max(at, high.get(variable, at))
            names += low
            least += low.values()
            most += high.values()
            ends.append(len(names))
        columns = [pa.array(c, f.type) for c, f in zip((names, least, most), name)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(name)))
    return F.arrow_udf(run, "array<struct<variable string, least int, most int>>")


def _trace_by_joins(found: Traces, max_depth: int | None) -> DataFrame:
    """``trace`` of the files that are not followed in their row."""
    return closure(found.seed_rows, found.step_rows, ["root"], ["variable"], max_depth)


def trace(found: Traces, max_depth: int | None = None) -> DataFrame:
    """``reach`` of traces."""
    rows = found.in_row.where("size(seeds) > 0").select("path", "seeds", "steps").mapInArrow(
        _reaching_rows(max_depth), "path string, root string, variable string, depth int")
    return rows.unionByName(_trace_by_joins(found, max_depth)) if found.has_apart else rows


def trace_boundary(found: Traces, boundary: int = BOUNDARY, max_depth: int | None = None) -> DataFrame:
    """``boundary_hits`` of traces; files that are followed in their row are told there."""
    reached = _names_reached(max_depth)("seeds", "steps")
    rows = found.in_row.where("size(seeds) > 0").select("path", reached.alias("names")).select(
        "path", (F.array_max("names.most") >= boundary).alias("trace_boundary_reached"))
    return rows.unionByName(boundary_hits(_trace_by_joins(found, max_depth), boundary)) if found.has_apart else rows


def trace_sink_hits(found: Traces, max_depth: int | None = None) -> DataFrame:
    """``sink_hits`` of traces that list ``met``; files that are followed in their row meet their sanitisers there."""
    tracked = "names.variable" if max_depth is None else f"filter(names, n -> n.least < {max_depth}).variable"
    rows = found.in_row.where("size(seeds) > 0 AND size(met) > 0").select(
        "path", "met", _names_reached(max_depth)("seeds", "steps").alias("names"))
    hits = rows.selectExpr("path", "met", f"{tracked} AS tracked").selectExpr(
        "path", "inline(filter(met, m -> array_contains(tracked, m.variable)))").select("path", "variable", "line_no", "sink_name")
    if not found.has_apart:
        return hits
    met = found.by_joins.selectExpr("path", "inline(met)")
    return hits.unionByName(met.join(_tracked(_trace_by_joins(found, max_depth), max_depth), ["path", "variable"])
                            .groupBy("path", "variable", "line_no").agg(F.min("sink_name").alias("sink_name")))


def reach(found: Relations, max_depth: int | None = None) -> DataFrame:
    """Variables reached from each source by assignments, whatever their order: path, root, variable, depth (least).

    Statements in which the variable meets a sanitiser are not followed.  With ``max_depth`` rows of that depth
    are not followed further.
    """
    names = ["path", "root", "variable"]
    live = "filter(uses, s -> s.target IS NOT NULL AND s.sink IS NULL AND s.variable <> s.target)"
    rows = found.in_row.where("size(marked) > 0").selectExpr(
        "path", "array_distinct(transform(marked, s -> named_struct('root', s.variable, 'variable', s.variable))) AS seeds",
        f"transform({live}, s -> named_struct('variable', s.variable, 'next_variable', s.target)) AS steps")
    followed = _closed_rows(rows, names, dict.fromkeys(names, "string"), 1, max_depth)
    if not found.has_apart:
        return followed
    steps = found.uses_by_joins.where("target IS NOT NULL AND sink IS NULL").select(
        "path", "variable", F.col("target").alias("next_variable")).distinct()
    seeds = found.listed("marked", found.by_joins).select("path", F.col("variable").alias("root"), "variable").distinct()
    return followed.unionByName(closure(seeds, steps, ["root"], ["variable"], max_depth))


def boundary_hits(reached: DataFrame, boundary: int = BOUNDARY) -> DataFrame:
    """Files whose trace reached ``boundary`` steps; a mark, the trace goes on."""
    return reached.groupBy("path").agg((F.max("depth") >= boundary).alias("trace_boundary_reached"))


def _tracked(reached: DataFrame, max_depth: int | None) -> DataFrame:
    rows = reached if max_depth is None else reached.where(F.col("depth") < max_depth)
    return rows.groupBy("path", "variable").agg(F.min("depth").alias("depth"))


def propagation(found: Relations, reached: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Edges variable -> target or callee: path, variable, line_no, to, type.  One per (line, to)."""
    live = found.uses.where("sink IS NULL").join(_tracked(reached, max_depth), ["path", "variable"])
    assign = live.where("target IS NOT NULL").select(
        "path", "variable", "depth", "line_no", F.col("target").alias("to"),
        F.lit("ASSIGNMENT").alias("type"))
    called = found.statements.where("size(calls) > 0 AND sink IS NULL").select("path", "line_no", "calls")
    call = live.select("path", "variable", "depth", "line_no").join(called, ["path", "line_no"]).select(
        "path", "variable", "depth", "line_no", F.explode("calls").alias("to"), F.lit("CALL").alias("type")).withColumn(
        "to", _last_part(F.col("to")))
    return (assign.unionByName(call).groupBy("path", "line_no", "to")
            .agg(F.min(F.struct("depth", "variable", "type")).alias("e"))
            .select("path", "e.variable", "line_no", "to", "e.type"))


def sink_hits(found: Relations, reached: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Statements in which a tracked variable meets a sanitiser: path, variable, line_no, sink_name."""
    return (found.uses.where("sink IS NOT NULL").join(_tracked(reached, max_depth), ["path", "variable"])
            .groupBy("path", "variable", "line_no").agg(F.min("sink").alias("sink_name")))


def _output_texts(found: Relations) -> DataFrame:
    """Texts of output statements: path, line_no, line."""
    return found.statements.where("output").select("path", "line_no", "line")


def output_edges(found: Relations) -> DataFrame:
    """Output calls naming a source: path, variable, line_no, to (the whole statement)."""
    named = found.sources.select("path", "variable").distinct()
    return found.uses.where("output").join(named, ["path", "variable"]).join(
        _output_texts(found), ["path", "line_no"]).select("path", "variable", "line_no", F.col("line").alias("to"))


_MADE = ("transform(filter(st, s -> s.target IS NOT NULL), s -> named_struct('line_no', s.line_no, 'target', s.target))")
_READ = "path string, line_no int, variable string, target string, sink string, output boolean, def_line int"


def _read_in_row(made: list[tuple], uses: list[tuple]) -> list[tuple]:
    """Uses (line_no, variable, ...) of a file with the line of the last assignment (line_no, target) above as last
    part.  Both come by lines; a statement's own assignment comes after its uses."""
    last, at, out = {}, 0, []
    for use in uses:
        while at < len(made) and made[at][0] < use[0]:
            last[made[at][1]] = made[at][0]
            at += 1
        if use[1] in last:
            out.append((*use, last[use[1]]))
    return out


def _reading(batches):
    """Rows (path, made, uses) of a file to ``reaching``."""
    fields = pa.schema([("path", pa.string()), ("line_no", pa.int32()), ("variable", pa.string()), ("target", pa.string()),
                        ("sink", pa.string()), ("output", pa.bool_()), ("def_line", pa.int32())])
    for batch in batches:
        for k in range(0, batch.num_rows, PART):
            paths, *lists = batch.slice(k, PART).columns
            out = [(path, *row) for path, made, uses in zip(paths.to_pylist(), *map(_lists, lists))
                   for row in _read_in_row(made, uses)]
            columns = zip(*out) if out else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)


def _reaching_by_joins(found: Relations) -> DataFrame:
    """``reaching`` of the files that are not followed in their row.

    An as-of join as one window over names and line numbers of a file: the statement's own assignment comes after
    its uses and takes the place of earlier ones.
    """
    made = found.by_joins.selectExpr("path", f"inline({_MADE})").select(
        "path", F.col("target").alias("variable"), "line_no", F.col("line_no").alias("made"))
    both = found.uses_by_joins.unionByName(made, allowMissingColumns=True)
    # A use and an assignment on one line: nulls first, so the use.
    above = Window.partitionBy("path", "variable").orderBy("line_no", F.asc_nulls_first("made")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("def_line", F.last("made", ignorenulls=True).over(above)).where(
        "made IS NULL AND def_line IS NOT NULL").drop("made")


def reaching(found: Relations) -> DataFrame:
    """Names read with ``def_line``: the line of the last assignment of the variable above the statement; uses that no
    assignment reaches are left out."""
    rows = found.in_row.where("size(uses) > 0").selectExpr("path", f"{_MADE} AS made", "uses").mapInArrow(_reading, _READ)
    return rows.unionByName(_reaching_by_joins(found))


def tainted(found: Relations, read: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Definitions that hold the value of a source: path, root, root_line, variable, line_no, depth; of the files that
    are not followed in their row.

    A source's own definition is one unless it is sanitised at once; an assignment without a sanitiser passes on
    what the definitions that reach it hold.  ``read`` is ``_reaching_by_joins`` as a table.
    """
    seeds = found.listed("marked", found.by_joins).where("NOT clean").select(
        "path", F.col("variable").alias("root"), F.col("line_no").alias("root_line"), "variable", "line_no")
    steps = read.where("target IS NOT NULL AND sink IS NULL").select(
        "path", "variable", F.col("def_line").alias("line_no"), F.col("target").alias("next_variable"),
        F.col("line_no").alias("next_line_no")).distinct()
    return closure(seeds, steps, ["root", "root_line"], ["variable", "line_no"], max_depth)


def _leaking(max_depth: int | None):
    """(seeds, made, uses) of a file to its leaks: (root, root_line, line_no of the first output)."""
    leak = pa.struct([("root", pa.string()), ("root_line", pa.int32()), ("line_no", pa.int32())])

    def run(seeds: pa.Array, made: pa.Array, uses: pa.Array) -> pa.Array:
        leaks = []
        for roots, assigned, used in zip(_lists(seeds), _lists(made), _lists(uses)):
            read = _read_in_row(assigned, used)
            steps = [(name, def_line, target, line) for line, name, target, sink, _, def_line in read
                     if target is not None and sink is None]
            shown = {}
            for line, name, _, _, output, def_line in read:
                if output:
                    shown[name, def_line] = min(line, shown.get((name, def_line), line))
            first = {}
            for _, new in _followed(roots, steps, 2, 2, max_depth) if shown else ():
                for row in new:
                    line = shown.get(row[2:])
                    if line is not None:
                        first[row[:2]] = min(line, first.get(row[:2], line))
            leaks.append([{"root": v, "root_line": n, "line_no": line} for (v, n), line in first.items()])
        return pa.array(leaks, pa.list_(leak))
    return F.arrow_udf(run, "array<struct<root string, root_line int, line_no int>>")


def _leaks_of(read: list[tuple], max_depth: int | None) -> list[tuple]:
    """Leaks (root, root_line, line_no of the first output) of a file's statements (line_no, target, source, passes, output,
    names parted by spaces).

    Statements come by lines and read the last definitions above them, so one pass finds all that a definition holds: the
    sources (root, root_line) with the least number of steps.
    """
    held, first = {}, {}
    for line, target, source, passes, output, names in read:
        roots = {}
        for name in names.split():
            for root, depth in held.get(name, {}).items():
                roots[root] = min(depth, roots.get(root, depth))
        if output:
            for root in roots:
                first.setdefault(root, line)
        if target is not None:
            held[target] = {root: depth + 1 for root, depth in roots.items() if max_depth is None or depth < max_depth} if passes else {}
            if source:
                held[target][target, line] = 0
    return [(*root, line) for root, line in first.items()]


def _leaks_in_row(max_depth: int | None):
    """Statements of a file to its leaks, see ``_leaks_of``."""
    leak = pa.struct([("root", pa.string()), ("root_line", pa.int32()), ("line_no", pa.int32())])

    def run(read: pa.Array) -> pa.Array:
        names, leaks = [f.name for f in leak], [_leaks_of(statements, max_depth) for statements in _lists(read)]
        return pa.array([[dict(zip(names, row)) for row in rows] for rows in leaks], pa.list_(leak))
    return F.arrow_udf(run, "array<struct<root string, root_line int, line_no int>>")


def joined_leaks(found: Relations, max_depth: int | None = None) -> DataFrame:
    """Leaks (path, root, root_line, line_no, line) of the files that are not followed in their row."""
    read = materialise(_reaching_by_joins(found), "reaching")
    held = tainted(found, read, max_depth).select("path", "root", "root_line", "variable", F.col("line_no").alias("def_line"))
    texts = found.listed("st", found.by_joins).where("output").select("path", "line_no", "line")
    return (read.where("output").join(held, ["path", "variable", "def_line"]).groupBy("path", "root", "root_line")
            .agg(F.min("line_no").alias("line_no")).join(texts, ["path", "line_no"]))


def unsanitised(found: Relations, max_depth: int | None = None) -> DataFrame:
    """Sources whose value reaches an output through definitions that no sanitiser has cleaned: one finding per
    source and its first such output."""
    seeds = ("transform(filter(marked, s -> NOT s.clean), s -> named_struct('root', s.variable, 'root_line', s.line_no, "
             "'variable', s.variable, 'line_no', s.line_no))")
    rows = found.in_row.where("exists(marked, s -> NOT s.clean) AND exists(uses, s -> s.output)").selectExpr(
        "path", "filter(st, s -> s.output) AS outputs", f"{seeds} AS seeds", f"{_MADE} AS made", "uses")
    leaks = rows.select("path", "outputs", F.explode(_leaking(max_depth)("seeds", "made", "uses")).alias("leak"))
    columns = ("path", "root", "root_line", "line_no", "line")
    leaked = leaks.selectExpr("path", "leak.*", "get(filter(outputs, s -> s.line_no = leak.line_no), 0).line AS line").select(*columns)
    if found.has_apart:
        leaked = leaked.unionByName(joined_leaks(found, max_depth).select(*columns))
    return _leak_findings(leaked)


def _leak_findings(leaked: DataFrame) -> DataFrame:
    """Findings of leaks (path, root, root_line, line_no, line)."""
    return leaked.select(
        "path", F.lit(RULE).alias("rule_id"), F.lit("Insecure Data Flow").alias("rule_name"),
        F.col("root").alias("variable"), F.col("root_line").alias("line_number"), F.col("line_no").alias("sink_line"),
        F.concat(F.lit("Source: "), "root", F.lit(" (line "), F.col("root_line").cast("string"),
                 F.lit(") -> Sink: "), F.col("line"), F.lit(" (line "),
                 F.col("line_no").cast("string"), F.lit(")")).alias("data_flow"),
        F.lit(SEVERITY).alias("severity"))


def source_questions(files: DataFrame, source_rows: DataFrame, edges: DataFrame,
                     hits: DataFrame, code_chars: int | None = None) -> DataFrame:
    """One question row per source: its own steps and sanitiser hits as text, and the code (its first
    ``code_chars`` characters, if stated)."""
    def listed(rows: DataFrame, what: Column, name: str) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct("line_no", what.alias("what"))))
        return rows.groupBy("path", "variable").agg(F.array_join(F.transform(
            items, lambda s: F.concat(F.lit("  Line "), s["line_no"].cast("string"), s["what"])),
            "\n").alias(name))
    steps = listed(edges, F.concat(F.lit(": passes to "), "to"), "propagation")
    safe = listed(hits, F.concat(F.lit(": hits registered sink "), "sink_name", F.lit(" - SAFE")),
                  "sink_status")
    asked = (source_rows.join(steps, ["path", "variable"], "left").join(safe, ["path", "variable"], "left")
             .select("path", "variable", "line_no", "expression",
                     F.coalesce("propagation", F.lit("  No propagation detected")).alias("propagation"),
                     F.coalesce("sink_status", F.lit("  No registered sink reached")).alias("sink_status")))
    # The questions of a file meet its code once; rows are made after the join.
    of_file = asked.groupBy("path").agg(F.collect_list(F.struct(*asked.columns[1:])).alias("asked"))
    head = F.col("code") if code_chars is None else F.substring("code", 1, code_chars)
    return files.select("path", head.alias("code_head")).join(of_file, "path").select(
        "path", "code_head", F.inline("asked")).select(*asked.columns, "code_head")


def file_verdicts(source_rows: DataFrame, findings: DataFrame) -> DataFrame:
    """Per file with sources: verdict and details."""
    bad = findings.groupBy("path").agg(F.count("*").alias("n_bad"))
    n = F.coalesce("n_bad", F.lit(0).cast("bigint"))
    n_src = F.col("n_sources").cast("string")
    return (source_rows.groupBy("path").agg(F.count("*").alias("n_sources")).join(bad, "path", "left")
            .select("path", F.when(n > 0, "REJECT").otherwise("ACCEPT").alias("verdict"), "n_sources",
                    n.alias("n_violations"),
                    F.when(n > 0, F.concat(F.lit("Layer 2 found "), n.cast("string"),
                                           F.lit(" violation(s) across "), n_src,
                                           F.lit(" source(s).")))
                    .otherwise(F.concat(F.lit("Layer 2 cleared "), n_src,
                                        F.lit(" source(s). No violations confirmed."))).alias("details")))
