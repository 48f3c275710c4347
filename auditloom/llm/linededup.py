"""Deletion of repeated runs of lines, by winnowing over line hashes.

A window is the shortest stretch of lines, from a line with words on, that holds ``min_words`` words; lines
without words are skipped.  It depends only on the lines in it, so a stretch of that many words that stands in
two places has the same windows in both.  The least line hash of a window is its fingerprint: two equal windows
are sure to select the same line (winnowing), so windows whose fingerprint stands in one place of the corpus
are never looked at again.  Around the fingerprints that stand in several places, every window that selected
them is compared with the first equal window of the corpus, in the order of (id, line).  Overlapping windows
that match are merged into runs, and later runs go.

A match is extended both ways.  To the left nothing is left to do: the window of an equal line before a matching
window ends no later than that one, so it matches too.  To the right, lines that follow the last window of a match
are fewer than a window's words (or there would be one more window), so they are in the ``after`` of that window:
the lines of the next line's stretch that are past the window.  A line goes if the window and the lines up to it
stand earlier in the corpus.  Every line is in one ``after``, so these rows are no more than the lines.

All of it is DataFrame work on narrow rows of hashes and positions; texts move once, for the deletion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from auditloom.functions.session import materialise
from auditloom.llm.chars import WORD


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """One row per window: id, th (hash of the text), line (its number among lines with words), first, last (line
    numbers in the text), size, mark (fingerprint), place (its line), content (hash of the lines' hashes), after
    (hash and number of each line past the window that begins within min_words words of the next line's start)."""
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"),
                        F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "text"))
    counted = lines.select("id", "th", "pos", F.xxhash64("text").alias("h"),
                           F.regexp_count("text", F.lit(WORD)).cast("long").alias("n")).where("n > 0")
    # Rows of a repeated document are one text; the repartition serves this and the windows.
    counted = counted.repartition("id", "th").dropDuplicates(["id", "th", "pos"])
    of_text = Window.partitionBy("id", "th").orderBy("pos")
    before = counted.withColumns({
        "line": F.row_number().over(of_text),
        "words": F.sum("n").over(of_text) - F.col("n")})
    # Lines that begin before the window has all its words; each has a word, so there are at most min_words.
    reach = Window.partitionBy("id", "th").orderBy("words").rangeBetween(0, min_words - 1)
    reached = before.withColumns({"ls": F.collect_list(F.struct("h", "pos")).over(reach),
                                  "total": F.sum("n").over(reach), "last": F.max("pos").over(reach)})
    following = F.coalesce(F.lead("ls").over(of_text), F.array().cast("array<struct<h:bigint,pos:int>>"))
    framed = reached.withColumns({"hs": F.col("ls.h"), "next": following}).where(F.col("total") >= min_words)
    mark = F.array_min("hs")
    return framed.select("id", "th", "line", F.col("pos").alias("first"), "last", F.size("hs").alias("size"),
                         mark.alias("mark"), (F.col("line") + F.array_position("hs", mark)).alias("place"),
                         F.xxhash64("hs").alias("content"),
                         F.filter("next", lambda x: x["pos"] > F.col("last")).alias("after"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """Runs to delete: (id, th, first, last) with line numbers from 0, both inclusive; runs of a text are apart.

    A window, or a window and lines that follow it, is repeated if the first equal stretch is in another text or
    ends before it begins, so of a text that repeats itself line by line the first window stays.
    """
    found = materialise(windows(docs, id_col, text_col, min_words), "line-windows")
    at = F.struct("id", "th", "place")
    marks = materialise(found.groupBy("mark").agg(F.min(at).alias("a"), F.max(at).alias("b"))
                        .where("a <> b").select("mark"), "line-marks")
    near = materialise(found.join(marks, "mark", "left_semi"), "line-candidates")
    head = F.min(F.struct("id", "th", "line"))
    firsts = materialise(near.groupBy("content").agg(head.alias("head"), F.count("*").alias("n"))
                         .where("n > 1").select("content", "head"), "line-firsts")
    other = ~(F.col("id").eqNullSafe(F.col("head.id")) & (F.col("th") == F.col("head.th")))
    apart = other | (F.col("line") >= F.col("head.line") + F.col("size"))
    again = near.join(firsts, "content").where(apart).select("id", "th", "first", "last")
    stretches = materialise(near.join(firsts.select("content"), "content", "left_semi").select(
        "id", "th", "line", "first", "size", "content", "after", F.posexplode("after").alias("k", "end")).select(
        "id", "th", "line", "first", (F.col("size") + F.col("k") + 1).alias("size"), F.col("end.pos").alias("last"),
        F.xxhash64("content", F.slice("after.h", F.lit(1), F.col("k") + 1)).alias("stretch")), "line-stretches")
    heads = stretches.groupBy("stretch").agg(head.alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = again.unionByName(stretches.join(heads, "stretch").where(apart).select("id", "th", "first", "last"))
    of_text = Window.partitionBy("id", "th").orderBy("first", "last")
    reached = F.max("last").over(of_text.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("first") > F.coalesce(F.col("reached"), F.lit(-2)) + 1, 1).otherwise(0)
    return again.withColumn("reached", reached).withColumn("run", F.sum(opens).over(of_text)).groupBy(
        "id", "th", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def delete_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    min_words: int = 50) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from the text column, and ``removed_runs``, an array of
    (first, last) line numbers of the text before (empty if nothing went).

    Null texts stay null, empty ones empty; a text of repeated lines only becomes empty.  Ties (equal windows)
    are settled by id, then by a hash of the text; null ids come first.  Rows with equal id and text are one text
    and change alike.  Other columns are kept as they are, whatever their names, unless one is ``removed_runs``.
    """
    runs = repeated_runs(docs, id_col, text_col, min_words).groupBy("id", "th").agg(
        F.sort_array(F.collect_list(F.struct("first", "last"))).alias("removed_runs"))
    rows = docs.drop("removed_runs").select(F.struct("*").alias("row"), F.xxhash64(text_col).alias("th"))
    met = rows.join(runs, F.col(f"row.{id_col}").eqNullSafe(runs["id"]) & (rows["th"] == runs["th"]), "left")
    lines = F.split(F.col(f"row.{text_col}"), "\n", -1)
    cut = F.expr("transform(removed_runs, (r, k) -> slice(lines, if(k = 0, 1, removed_runs[k - 1].last + 2), "
                 "r.first - if(k = 0, 0, removed_runs[k - 1].last + 1)))")
    rest = F.expr("slice(lines, element_at(removed_runs, -1).last + 2, size(lines))")
    left = F.array_join(F.concat(F.flatten(cut), rest), "\n")
    split = met.select("row", "removed_runs", F.when(F.col("removed_runs").isNotNull(), lines).alias("lines"))
    new = F.when(F.col("lines").isNull(), F.col(f"row.{text_col}")).otherwise(left)
    empty = F.array().cast("array<struct<first:int,last:int>>")
    return split.select(*[(new if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns
                          if c != "removed_runs"], F.coalesce("removed_runs", empty).alias("removed_runs"))
