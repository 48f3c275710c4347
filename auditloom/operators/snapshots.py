"""Snapshots, versions and incremental re-audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from auditloom import rules as R
from auditloom.functions import text as T
from auditloom.functions.session import materialise
from auditloom.functions.twolevel import with_previous


def fingerprints(docs: DataFrame) -> DataFrame:
    """md5 and sha-256 of each document: ``docs(project, name, content)``."""
    return docs.select("project", "name", F.md5("content").alias("md5"),
                       F.sha2("content", 256).alias("sha256"))


def project_signature(docs: DataFrame, names: Sequence[str] = R.DOCUMENT_NAMES) -> DataFrame:
    """sha-256 over the contents of a project's named documents in name order; missing is empty.

    The names are a short fixed list, so a group holds at most that many texts.
    """
    ordered = sorted(names)
    texts = [F.max(F.when(F.col("name") == n, F.col("content"))).alias(f"_c{i}")
             for i, n in enumerate(ordered)]
    joined = F.concat(*[F.coalesce(f"_c{i}", F.lit("")) for i in range(len(ordered))])
    return docs.where(F.col("name").isin(*ordered)).groupBy("project").agg(*texts).select(
        "project", F.sha2(joined, 256).alias("signature"))


def verify_signatures(docs: DataFrame, locks: DataFrame) -> DataFrame:
    """``valid``: the stored signature matches, or there is none yet."""
    now = project_signature(docs)
    return now.join(locks.select("project", F.col("signature").alias("stored")), "project", "left").select(
        "project", "signature", F.coalesce(F.col("signature") == F.col("stored"), F.lit(True)).alias("valid"))


def _hashed(docs: DataFrame, name: str) -> DataFrame:
    return docs.select("project", "name", F.md5("content").alias(name))


def snapshot_status(live: DataFrame, snapshot: DataFrame,
                    names: Sequence[str] = R.DOCUMENT_NAMES) -> DataFrame:
    """Status of every expected document of every project.  Only hashes are shuffled."""
    projects = live.select("project").union(snapshot.select("project")).distinct()
    expected = projects.select("project", F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    both = expected.join(_hashed(live, "_l"), ["project", "name"], "left").join(
        _hashed(snapshot, "_s"), ["project", "name"], "left")
    status = (F.when(F.col("_l").isNull() & F.col("_s").isNull(), "N/A")
              .when(F.col("_l").isNull(), "MISSING IN LIVE").when(F.col("_s").isNull(), "MISSING IN VAULT")
              .when(F.col("_l") == F.col("_s"), "IN SYNC").otherwise("OUT OF SYNC"))
    return both.select("project", "name", status.alias("status"))


def _digests(leaves: DataFrame, side: str) -> DataFrame:
    """One digest a project over the digests of its documents, in any order: partial sums, no list."""
    leaf = F.xxhash64("name", "_h").cast("decimal(38,0)")
    return leaves.groupBy("project").agg(F.sum(leaf).alias(f"_sum_{side}"), F.count("*").alias(f"_n_{side}"))


def changed_keys(live: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(project, name) of live documents that differ from the snapshot or are missing there, as a table.

    Compared as a tree of digests: projects first, documents only of projects that differ.  Contents are read once
    a side, to be hashed where they lie; what moves are hashes.
    """
    now, then = (materialise(docs.select("project", "name", F.md5("content").alias("_h")), "leaves")
                 for docs in (live, snapshot))
    same = _digests(now, "l").join(_digests(then, "s"), "project").where("_sum_l = _sum_s AND _n_l = _n_s")
    open_ = now.join(same, "project", "left_anti")
    return materialise(open_.join(then, ["project", "name", "_h"], "left_anti")
                       .select("project", "name").distinct(), "changed")


def changed_documents(live: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Live documents that differ from the snapshot or are missing there."""
    return live.join(changed_keys(live, snapshot), ["project", "name"], "left_semi")


def sync(live: DataFrame, snapshot: DataFrame) -> DataFrame:
    """New snapshot: changed live documents replace their copies; the rest stays.

    Only contents of changed documents are taken from ``live``; the keys that tell them are a narrow table.
    """
    keys = changed_keys(live, snapshot)
    kept = snapshot.join(keys, ["project", "name"], "left_anti")
    return kept.select("project", "name", "content").unionByName(
        live.join(keys, ["project", "name"], "left_semi").select("project", "name", "content"))


# --- versions ---------------------------------------------------------------------------------------------

def cosmetic_form(content: Column) -> Column:
    """Content with lines trimmed, blank lines dropped, and joined."""
    lines = F.transform(F.split(content, "\r?\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "")


def with_history(versions: DataFrame, bucket: str = "hour") -> DataFrame:
    """``versions(path, ts, content)`` as lists of line hashes next to the previous version's: path, ts, lines, hash,
    form (md5 of content and cosmetic form), prev_lines, prev_hash, prev_form.

    ``bucket`` is the time unit a path's versions are cut into, so that one busy path is spread.  Contents are hashed
    where they lie; their lines are kept by ``line_store`` and fetched where they are shown.
    """
    listed = materialise(versions.select(
        "path", "ts", F.transform(T.split_lines(F.col("content")), lambda x: F.xxhash64(x)).alias("lines"),
        F.md5("content").alias("hash"), F.md5(cosmetic_form(F.col("content"))).alias("form")), "version-lists")
    return with_previous(listed, ["path"], F.date_trunc(bucket, "ts"), F.col("ts"), ["lines", "hash", "form"])


TOGETHER = 1_000  # versions of a path up to which they meet in one group


def version_pairs(versions: DataFrame, bucket: str = "hour") -> DataFrame:
    """``versions(path, ts, content)`` with ``previous``, the content of the path's version before (null for the first).

    A version moves once, to the others of its path: they lie side by side and are alike, so what is compressed and
    moved is little more than one of them, and nothing has to be fetched later.  Paths of more than ``TOGETHER`` versions
    are cut into time units as by ``with_history``.
    """
    many = materialise(versions.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > TOGETHER).select("path"), "busy")
    has_many = not many.isEmpty()
    few = versions.join(many, "path", "left_anti") if has_many else versions
    pairs = few.select("path", "ts", "content", F.lag("content").over(Window.partitionBy("path").orderBy("ts")).alias("previous"))
    if not has_many:
        return pairs
    busy = materialise(versions.join(many, "path", "left_semi").select("path", "ts", "content"), "busy-versions")
    return pairs.unionByName(with_previous(busy, ["path"], F.date_trunc(bucket, "ts"), F.col("ts"), ["content"]).select(
        "path", "ts", "content", F.col("prev_content").alias("previous")))


def line_store(versions: DataFrame) -> DataFrame:
    """Every distinct line of every path once: path, hash, line.  Tasks drop repeats before anything moves, so lines
    that stay the same over many versions move about once a task."""
    lines = T.explode_lines(versions, "path", text="content")
    return lines.select("path", F.xxhash64("line").alias("hash"), "line").distinct()


def skip_flags(versions: DataFrame, bucket: str = "hour") -> DataFrame:
    """Per version: ``unchanged`` and ``cosmetic`` against the previous one.  Only hashes move."""
    hashed = materialise(versions.select(
        "path", "ts", F.md5("content").alias("hash"),
        F.md5(cosmetic_form(F.col("content"))).alias("form")), "hashes")
    p = with_previous(hashed, ["path"], F.date_trunc(bucket, "ts"), F.col("ts"), ["hash", "form"])
    same = F.coalesce(F.col("hash") == F.col("prev_hash"), F.lit(False))
    return p.select("path", "ts", same.alias("unchanged"),
                    (~same & F.coalesce(F.col("form") == F.col("prev_form"), F.lit(False))).alias("cosmetic"))


def _pair_flags(content: Column, previous: Column) -> Column:
    """Per line position: does it differ between the two texts (by position)."""
    return F.zip_with(T.split_lines(content), T.split_lines(previous), lambda a, b: ~a.eqNullSafe(b))


def changed_lines(history: DataFrame, store: DataFrame) -> DataFrame:
    """Positions whose line differs from the previous version: path, ts, line_no, line, prev_line; a side that has no
    such line is null.  ``history`` of ``with_history``, ``store`` of ``line_store``."""
    pairs = F.zip_with("lines", "prev_lines", lambda a, b: F.struct(a.alias("now"), b.alias("prev")))
    rows = history.where("prev_lines IS NOT NULL").select("path", "ts", F.posexplode(pairs).alias("p", "x")).where(
        ~F.col("x.now").eqNullSafe(F.col("x.prev"))).select("path", "ts", (F.col("p") + 1).alias("line_no"), "x.*")
    for side, name in (("now", "line"), ("prev", "prev_line")):
        texts = store.select("path", F.col("hash").alias(side), F.col("line").alias(name))
        rows = rows.join(texts, ["path", side], "left")
    return rows.select("path", "ts", "line_no", "line", "prev_line")


def changed_pairs(pairs: DataFrame) -> DataFrame:
    """``changed_lines`` of ``version_pairs``."""
    lines = F.zip_with(T.split_lines(F.col("content")), T.split_lines(F.col("previous")), lambda a, b: F.struct(
        a.alias("line"), b.alias("prev_line")))
    differ = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("line_no"), x["line"].alias("line"), x["prev_line"].alias("prev_line"))),
                      lambda x: ~x["line"].eqNullSafe(x["prev_line"]))
    return pairs.where("content <> previous").select("path", "ts", F.inline(differ))


def _shown(flags: Column, n: Column, context: int) -> Column:
    """Sorted line numbers within ``context`` of a set flag (a flag a position), up to ``n``."""
    changed = F.filter(F.transform(flags, lambda f, i: F.when(f, i + 1)), lambda i: i.isNotNull())
    near = F.transform(
        F.filter(changed, lambda i: F.greatest(F.lit(1), i - context) <= F.least(n, i + context)),
        lambda i: F.sequence(F.greatest(F.lit(1), i - context), F.least(n, i + context)))
    return F.array_sort(F.array_distinct(F.flatten(near)))


def audit_chunk(content: Column, previous: Column, context: int = 10) -> Column:
    """Changed lines with ``context`` lines around them, merged and numbered; empty if nothing changed.

    Each changed position yields its window of line numbers; the distinct sorted union is rendered.
    """
    lines = T.split_lines(content)
    shown = _shown(_pair_flags(content, previous), F.size(lines), context)
    return F.array_join(F.transform(shown, lambda i: F.concat(
        i.cast("string"), F.lit(" | "), F.element_at(lines, i))), "\n")


def audit_chunks(history: DataFrame, store: DataFrame, context: int = 10) -> DataFrame:
    """``audit_chunk`` of every version with a predecessor, where not empty: path, ts, chunk.

    Positions are told from the lists of hashes; only the lines that are shown are fetched.
    """
    flags = F.zip_with("lines", "prev_lines", lambda a, b: ~a.eqNullSafe(b))
    places = history.where("prev_lines IS NOT NULL").select(
        "path", "ts", "lines", F.explode(_shown(flags, F.size("lines"), context)).alias("n"))
    texts = places.select("path", "ts", "n", F.element_at("lines", F.col("n")).alias("hash")).join(store, ["path", "hash"])
    shown = F.array_sort(F.collect_list(F.struct("n", "line")))  # lines of one version
    return texts.groupBy("path", "ts").agg(F.array_join(F.transform(
        shown, lambda x: F.concat(x["n"].cast("string"), F.lit(" | "), x["line"])), "\n").alias("chunk"))


def audit_pairs(pairs: DataFrame, context: int = 10) -> DataFrame:
    """``audit_chunks`` of ``version_pairs``."""
    changed = T.computed_once(pairs.where("content <> previous"), "chunk", audit_chunk(F.col("content"), F.col("previous"), context))
    return changed.where("chunk <> ''").select("path", "ts", "chunk")


def mode_of(first_limit: int, full_limit: int, power_mode: bool = False) -> Column:
    """Mode of a row with lines, hash, form, prev_hash and prev_form."""
    n = F.size("lines")
    first = F.col("prev_hash").isNull()
    skip = F.coalesce((F.col("hash") == F.col("prev_hash")) | (F.col("form") == F.col("prev_form")), F.lit(False))
    mode = F.when(skip, "skip")
    if power_mode:
        mode = mode.otherwise("full")
    else:
        mode = (mode.when(first & (n > first_limit), "index_only")
                .when(first | (n <= full_limit), "full").otherwise("diff"))
    return mode


def audit_mode(history: DataFrame, first_limit: int = 200, full_limit: int = 150, power_mode: bool = False) -> DataFrame:
    """Per version: mode (skip, index_only, full, diff), from hashes alone; ``history`` of ``with_history``."""
    return history.select("path", "ts", F.size("lines").alias("n_lines"), mode_of(first_limit, full_limit, power_mode).alias("mode"))


def sent_texts(versions: DataFrame, modes: DataFrame, chunks: DataFrame) -> DataFrame:
    """What is sent of each version: path, ts, mode, sent (its content if full, its chunk if diff, else null)."""
    full = versions.join(modes.where("mode = 'full'").select("path", "ts"), ["path", "ts"], "left_semi")
    texts = full.select("path", "ts", F.col("content").alias("sent")).unionByName(
        modes.where("mode = 'diff'").select("path", "ts").join(
            chunks.select("path", "ts", F.col("chunk").alias("sent")), ["path", "ts"]))
    return modes.select("path", "ts", "mode").join(texts, ["path", "ts"], "left")


def sent_pairs(pairs: DataFrame, first_limit: int = 200, full_limit: int = 150, context: int = 10) -> DataFrame:
    """``sent_texts`` of ``version_pairs``, by the modes of ``audit_mode``: a version is told and rendered in its row."""
    content, previous = F.col("content"), F.col("previous")
    # The texts are at hand and stand for their hashes.
    forms = pairs.select(*pairs.columns, content.alias("hash"), previous.alias("prev_hash"), T.split_lines(content).alias("lines"),
                         cosmetic_form(content).alias("form"), cosmetic_form(previous).alias("prev_form"))
    told = T.computed_once(forms, "mode", mode_of(first_limit, full_limit))
    chunk = F.get(F.filter(F.array(audit_chunk(content, previous, context)), lambda x: x != ""), F.lit(0))
    sent = F.when(F.col("mode") == "full", content).when(F.col("mode") == "diff", chunk)
    return told.select("path", "ts", "mode", sent.alias("sent"))


# --- removed technologies ---------------------------------------------------------------------------------

def removed_imports(diffs: DataFrame, *keep: str) -> DataFrame:
    """Names imported by removed lines of a diff: kept columns, ``tech`` (distinct)."""
    keep = keep or ("path",)
    named = "(contains({0}, 'import') OR contains({0}, 'require'))".format  # all patterns hold one of these words
    lines = T.explode_lines(diffs.where(named("diff")), *keep, text="diff").where(
        f"{named('line')} AND line LIKE '-%' AND line NOT LIKE '---%'")
    return lines.select(*keep, F.explode(T.imported_names(
        F.trim(F.substring("line", 2, 2_000_000_000)))).alias("tech")).distinct()


# --- rules files -----------------------------------------------------------------------------------------

def missing_rules(rules_docs: DataFrame,
                  required: Sequence[tuple[tuple[str, ...], str]] = R.MANDATORY_RULES,
                  header: str = R.MANDATORY_HEADER) -> DataFrame:
    """Mandatory rules a rules text lacks, numbered on from its highest rule: ``rules_docs(project, rules)``.

    A text that already has the mandatory section is left alone.
    """
    numbers = F.transform(F.regexp_extract_all("rules", F.lit(r"(?i)(?:^|\n)Rule\s+(\d+)\s*:"), 1),
                          lambda d: d.cast("int"))
    top = F.coalesce(F.array_max(numbers), F.lit(0))
    absent = T.compact(F.array(*[
        F.when(~T.contains_any("rules", marks), F.lit(full)) for marks, full in required]))
    rows = rules_docs.where(~F.col("rules").contains(header)).select("project", top.alias("_top"), F.posexplode(absent).alias("_i", "rule_text"))
    return rows.select("project", (F.col("_top") + F.col("_i") + 1).alias("rule_no"), "rule_text")


def has_history(content: Column) -> Column:
    """The text has content lines besides headers and the empty-file template."""
    return F.exists(T.split_lines(content), lambda x: (F.trim(x) != "") & ~x.startswith("#")
                    & ~x.contains("No problems"))
