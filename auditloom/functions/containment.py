"""Substring matching between two tables by an index of character grams.

A ``contains`` join compares every pair in a group.  Here texts are cut into grams of ``GRAM`` characters, once, and a
needle is looked up by one of its grams only: the one that fewest texts of its group hold.  The few texts that
hold it are then compared with the needle.  Rows through the join grow with the texts' length and not with the
number of needle lengths; a needle with a gram that no text holds meets nothing.  Needles shorter than a gram are
looked up among the distinct pieces of their own length.

Sizes of cut texts are unknown to the planner, which takes a table of grams for as small as the scan it comes from
and would send it to the driver.  So every join here is told to meet by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

GRAM = 3


def _pieces(text: Column, length: Column) -> Column:
    """Distinct substrings of a length, none of a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - length + 1)
    return F.when(F.length(text) >= length, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, length))))


def containing(texts: DataFrame, needles: DataFrame, on: Sequence[str], text_id: Sequence[str],
               text: str, needle: str) -> DataFrame:
    """Distinct (on, text_id, needle) where ``text`` contains ``needle`` within the group ``on``.

    Empty and null needles and texts, and null groups, meet nothing.
    """
    on = list(on)
    wanted = needles.select(*on, F.col(needle).alias("_sub")).where(F.length("_sub") > 0).distinct()
    held = texts.select(*on, *text_id, F.col(text).alias("_text"))
    # Short needles: pieces of the lengths that occur, GRAM - 1 at most.
    short = wanted.where(F.length("_sub") < GRAM).hint("merge")
    lengths = short.groupBy(*on).agg(F.collect_set(F.length("_sub")).alias("_lens")).hint("merge")
    small = held.join(lengths, on).select(*on, *text_id, "_text", F.explode("_lens").alias("_len")).select(
        *on, *text_id, F.explode(_pieces(F.col("_text"), F.col("_len"))).alias("_sub")).join(short, [*on, "_sub"])
    # Long ones: by the gram that fewest texts hold.
    width = F.lit(GRAM)
    grams = held.select(*on, *text_id, F.explode(_pieces(F.col("_text"), width)).alias("_gram"))
    own = wanted.where(F.length("_sub") >= GRAM).select(*on, "_sub", F.explode(_pieces(F.col("_sub"), width)).alias("_gram"))
    rarity = grams.join(own.select(*on, "_gram").distinct().hint("merge"), [*on, "_gram"], "left_semi").groupBy(*on, "_gram").agg(
        F.count("*").alias("_n"))
    key = own.join(rarity.hint("merge"), [*on, "_gram"], "left").groupBy(*on, "_sub").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_key")).where("_key.n > 0").select(
        *on, "_sub", F.col("_key._gram").alias("_gram"))
    met = grams.join(key.hint("merge"), [*on, "_gram"]).select(*on, *text_id, "_sub")
    verified = met.join(held.hint("merge"), [*on, *text_id]).where(F.contains("_text", F.col("_sub")))
    columns = [*on, *text_id, F.col("_sub").alias(needle)]
    return small.select(*columns).unionByName(verified.select(*columns)).distinct()
