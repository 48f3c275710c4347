"""Licence scans by diagonal voting.

Every run of ``GRAM`` consecutive words of every text is joined by its hash to the places where templates hold it
and compared word by word.  A hit votes for a diagonal of (text, template): place in the text less place in the
template.  Votes are added up by Spark; diagonals that differ by few words and whose hits follow each other closely
are one band, so added, lost or changed words do not split a copy.  A band's words are verified: the template's
words that its hits cover, as a share of the template and of the span.  Short notices must be covered whole, since
one word tells one licence from another there; long texts by ``LONG_SHARE``.  Spans within another one are left out,
and of equal spans all but the one with most covered words.

Texts are cut into words once.  Only words of texts that hold a phrase or a gram of a template go on, as the others have
neither places nor hits; they are written and read by both scans.

Templates are bounded by their code, so they are broadcast.  Texts are never shuffled: hits carry no text, are
added up before they move and are at most one a template for each vote; groups are bounded by a template's length
(a diagonal) or by one text (its bands).
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from auditloom.functions.session import materialise

GRAM = 4
CHUNK = 4096
SHORT, LONG_SHARE, DENSITY = 20, 0.6, 0.6
SLACK, GAP = 8, 16
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The same words by bytes of UTF-8: small letters for A-Z, a space for all other ASCII but letters and digits.
SPACED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))

#: Phrases of the base scan and their labels, fixed values.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Public licence notices and texts, fixed values: (label, text).
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Distributed under the terms of the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions: The above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
            "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
            "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
            "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
            "OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                   "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                   "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
                   "language governing permissions and limitations under the License."),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the "
                "License, or (at your option) any later version."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or (at your option) any later version."),
    ("lgpl-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation, either version 3 of "
                 "the License, or (at your option) any later version."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Affero General Public License as published by the Free Software Foundation, either version 3 of "
                 "the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met: Redistributions of source code must retain the above copyright "
            "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
            "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
            "documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all "
            "copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
                "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
                  "modify, publish, use, compile, sell, or distribute this software, either in source code form or as "
                  "a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
)


def words_of(text: str) -> list[str]:
    """Words of a template: A-Z lower-cased, ASCII other than letters and digits parts them."""
    return re.findall(WORDS, text.translate(str.maketrans(UPPER, LOWER)))


def template_words(templates=TEMPLATES) -> list[tuple[int, str, list[str]]]:
    """(template number, label, words) of templates of ``GRAM`` words or more; shorter ones are an error."""
    found = [(k, label, words_of(text)) for k, (label, text) in enumerate(templates)]
    for _, label, words in found:
        if len(words) < GRAM:
            raise ValueError(f"a template of {label} has fewer than {GRAM} words")
    return found


def template_grams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(gram, template, at): every run of ``GRAM`` words of every template and its place."""
    rows = [(" ".join(words[i:i + GRAM]), k, i) for k, _, words in template_words(templates)
            for i in range(len(words) - GRAM + 1)]
    return spark.createDataFrame(rows, "gram string, template int, at int")


def _cut(grams: set[tuple[bytes, ...]], phrases: list[bytes]):
    """A text to (n_words, words); words are null unless a gram or a phrase stands in them."""
    longest = {max(g, key=len) for g in grams}  # no gram stands in a text without one of these words

    def holds(words: list[bytes]) -> bool:
        if not longest.isdisjoint(words) and not grams.isdisjoint(zip(*(words[k:] for k in range(GRAM)))):
            return True
        line = b" %b " % b" ".join(words)
        return any(p in line for p in phrases)

    def run(texts: pa.Array) -> pa.Array:
        n_words, kept = [], []
        for text in texts:
            words = (text.as_py() or b"").translate(SPACED).split()
            n_words.append(len(words))
            kept.append(words if holds(words) else None)
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(kept, pa.list_(pa.binary()))], ["n_words", "words"])
    return F.arrow_udf(run, "n_words long, words array<binary>")


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES,
              templates=TEMPLATES) -> DataFrame:
    """(id, th, n_words, words) of every row; words only of texts in which a phrase or a gram of a template stands."""
    grams = {tuple(w.encode() for w in own[i:i + GRAM]) for _, _, own in template_words(templates) for i in range(len(own) - GRAM + 1)}
    cut = _cut(grams, [f" {p} ".encode() for p in phrases])
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), cut(F.col(text_col).cast("binary")).alias("cut")).select(
        "id", "th", "cut.n_words", F.col("cut.words").cast("array<string>").alias("words"))


def phrase_places(words: str, phrases: tuple[str, ...]) -> Column:
    """Array of (place, phrase number) of all places of phrases in an array of words that is not empty."""
    tests = []
    for phrase in phrases:
        own = phrase.split()
        tests.append(" AND ".join(f"get({words}, i + {k}) = '{w}'" for k, w in enumerate(own)))
    arrays = [f"transform(filter(sequence(0, size({words}) - 1), i -> {t}), i -> struct(i AS place, {k} AS phrase))"
              for k, t in enumerate(tests)]
    return F.expr(f"concat({', '.join(arrays)})")


def base_scan(texts: DataFrame, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(id, th, n_words, n_base, first_word, last_word, base_labels) of every row of ``cut_texts``: places of whole phrases.

    Phrases are small letters and digits parted by one space; a phrase of one word is allowed.
    """
    names, tags = tuple(phrases), tuple(phrases.values())
    # The space on either side keeps phrases whole; only texts that hold one are searched word by word.
    holds = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).rlike("|".join(f" {p} " for p in names))
    none = F.array().cast("array<struct<place:int,phrase:int>>")
    found = texts.select("id", "th", "n_words", F.when(holds, phrase_places("words", names)).otherwise(none).alias("places"))
    label = F.transform("places", lambda p: F.element_at(F.array(*map(F.lit, tags)), p["phrase"] + 1))
    return found.select("id", "th", "n_words", F.size("places").cast("long").alias("n_base"),
                        F.array_min("places.place").cast("long").alias("first_word"),
                        F.array_max("places.place").cast("long").alias("last_word"),
                        F.array_sort(F.array_distinct(label)).alias("base_labels"))


def hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """``text_hits`` of documents."""
    return text_hits(cut_texts(docs, id_col, text_col, {}, templates), templates)


def text_hits(texts: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(id, th, template, diagonal, first, last, ats) of ``cut_texts``: votes of a diagonal, the first and last place of its
    hits in the text and the places of its hits in the template.

    Texts are cut into chunks of words that share ``GRAM - 1`` words with the next one, so no gram is lost or twice.
    """
    table = F.broadcast(template_grams(texts.sparkSession, templates))  # bounded by the templates in the code
    words = texts.where("words IS NOT NULL").select("id", "th", "words")
    # Outer: an inner one would also filter by the size of its array, which means to build it twice.
    chunks = words.select("id", "th", F.explode_outer(F.expr(
        f"if(size(words) >= {GRAM}, transform(sequence(0, size(words) - {GRAM}, {CHUNK}), "
        f"s -> struct(s, slice(words, s + 1, {CHUNK + GRAM - 1}) AS own)), NULL)")).alias("chunk"))
    # A gram can only meet one that begins with the same word, so the others are not even built.
    begins = ", ".join(f"'{w}'" for w in sorted({own[i] for _, _, own in template_words(templates)
                                                 for i in range(len(own) - GRAM + 1)}))
    rolled = chunks.select("id", "th", "chunk.s", F.explode_outer(F.expr(
        f"transform(filter(sequence(1, size(chunk.own) - {GRAM - 1}), i -> chunk.own[i - 1] IN ({begins})), "
        f"i -> struct(i - 1 AS pos, array_join(slice(chunk.own, i, {GRAM}), ' ') AS gram))")).alias("rolled"))
    met = rolled.select("id", "th", (F.col("s") + F.col("rolled.pos")).alias("place"), F.col("rolled.gram").alias("found"),
                        F.xxhash64("rolled.gram").alias("h")).join(table.withColumn("h", F.xxhash64("gram")), "h")
    same = met.where("found = gram")  # a hash may lie
    return same.groupBy("id", "th", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.min("place").alias("first"), F.max("place").alias("last"), F.collect_set("at").alias("ats"))


def bands(voted: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(id, th, template, label, first, last, covered, share, accepted): merged diagonals, verified.

    first and last are words of the text, last inclusive.  A band's diagonals rise by at most ``SLACK`` words (by a
    quarter of a short template at most), in the order of diagonals; its hits leave at most ``GAP`` words between
    them, in the order of the text.
    """
    known = template_words(templates)
    sizes = F.broadcast(voted.sparkSession.createDataFrame(
        [(k, label, len(words)) for k, label, words in known], "template int, label string, n int"))
    of_text = Window.partitionBy("id", "th", "template").orderBy("diagonal")
    slack = F.least(F.lit(SLACK), F.floor(F.col("n") / 4))
    far = F.col("diagonal") - F.lag("diagonal", 1).over(of_text) > slack
    near = voted.join(sizes, "template").withColumn("far", F.coalesce(far, F.lit(True)).cast("int")).withColumn(
        "near", F.sum("far").over(of_text.rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy("id", "th", "template", "near").orderBy("first", "diagonal")
    reached = F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("first") - F.col("reached") - GRAM > GAP, F.lit(True))
    marked = near.withColumn("reached", reached).withColumn("apart", apart.cast("int")).withColumn(
        "band", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    # A template's places are bounded by its length, so a set of them is small.
    joined = marked.groupBy("id", "th", "template", "label", "n", "near", "band").agg(
        F.min("first").alias("first"), (F.max("last") + GRAM - 1).alias("last"),
        F.array_distinct(F.flatten(F.collect_set("ats"))).alias("ats"))
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        "ats", lambda a: F.sequence(a, a + F.lit(GRAM - 1))))))
    shared = joined.withColumn("covered", covered).withColumn("share", F.col("covered") / F.col("n"))
    enough = F.when(F.col("n") < SHORT, F.col("share") == 1).otherwise(F.col("share") >= LONG_SHARE)
    dense = F.col("covered") >= DENSITY * (F.col("last") - F.col("first") + 1)
    return shared.select("id", "th", "template", "label", "first", "last", "covered", "share",
                         (enough & dense).alias("accepted"))


def licence_spans(texts: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(id, th, spans, share) of every text of ``cut_texts`` with a hit: the accepted spans and the greatest share of any template.

    spans: array of (first, last, label, covered, share) by first word, without spans within another one; of equal
    spans that with more covered words stays, then with the greater share, then the first by label and template.
    """
    found = materialise(bands(text_hits(texts, templates), templates), "licence-bands")
    best = Window.partitionBy("id", "th", "accepted").orderBy(
        "first", F.desc("last"), F.desc("covered"), F.desc("share"), "label", "template").rowsBetween(
        Window.unboundedPreceding, -1)
    within = F.col("last") <= F.coalesce(F.max("last").over(best), F.lit(-1))
    span = F.when(F.col("accepted") & ~F.col("within"), F.struct("first", "last", "label", "covered", "share"))
    return found.withColumn("within", within).groupBy("id", "th").agg(
        F.sort_array(F.collect_list(span)).alias("spans"), F.max("share").alias("share"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES,
         templates=TEMPLATES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, spans, labels, score) of every row of ``docs``.

    labels: sorted distinct labels of phrases and of accepted spans.  score: 1 if a phrase stands in the text, else
    the greatest verified share of a template, 0 without any hit.  Null and empty texts have no words, empty
    arrays, null places and score 0.  Repeated rows are treated alike, null ids like any other; other columns are
    not read.
    """
    texts = materialise(cut_texts(docs, id_col, text_col, phrases, templates), "licence-words")
    base = base_scan(texts, phrases)
    own = licence_spans(texts, templates).withColumnsRenamed({"id": "i", "th": "t"})
    met = base.join(own, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<first:int,last:int,label:string,covered:int,share:double>>"))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return met.select("id", "n_words", "n_base", "first_word", "last_word", "base_labels", spans.alias("spans"),
                      F.array_sort(F.array_union("base_labels", spans["label"])).alias("labels"), score.alias("score"))
