"""Secret scan: fixed patterns, and character Markov models compared by log-likelihood ratio.

Everything is DataFrame work.  Positions of matches come from splitting a text at a pattern: the lengths of the
gaps and of the matches add up to where each match stands.  The sums run over the matches of one text, as rows
apart from the texts, so a text with very many matches costs no more for each of them.

Two first-order character models are trained from labelled samples: values that the fixed patterns find (random)
and other runs of the same characters (ordinary).  The model of random strings leans to equal chances, so that
kinds of secrets the samples lack are near it as well.  A run of enough characters is a secret if the mean of
its log-likelihood ratios passes a threshold.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from auditloom.functions.session import materialise
from auditloom.llm.langid import bounded

# The patterns of the contract, the least length of what counts, and the order of kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # runs are maximal, so shorter ones need no look
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = "[A-Za-z0-9+/_=-]"
NEEDLES = ("password", "passwd", "secret", "token", "api")

HIT = "array<struct<kind:int,i:int,gap:int,size:int,good:boolean>>"


def _pattern(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hits(kind: int, pattern: str, applies: str, least: int, group: int = 0) -> str:
    """SQL of the matches of a pattern in ``text``: number, gap before, length, whether its group has ``least``
    characters.  After the last match there is one more gap, with an empty match that does not count."""
    return f"""CASE WHEN {applies} THEN transform(arrays_zip(
        transform(split(text, {_pattern(pattern)}, -1), g -> length(g)),
        regexp_extract_all(text, {_pattern(pattern)}, 0), regexp_extract_all(text, {_pattern(pattern)}, {group})),
        (z, i) -> struct({kind} AS kind, i AS i, z.`0` AS gap, coalesce(length(z.`1`), 0) AS size,
                         coalesce(length(z.`2`) >= {least}, false) AS good)) ELSE CAST(array() AS {HIT}) END"""


def _base(text: str = "text") -> list[str]:
    needles = " OR ".join(f"contains(low, '{n}')" for n in NEEDLES)
    return [_hits(0, ASSIGN, f"({needles}) AND text RLIKE {_pattern(ASSIGN)}",
                  LEAST["assign"], 2),
            _hits(1, ACCESS, "contains(text, 'AKIA')", LEAST["access"]),
            _hits(2, HEX, f"text RLIKE {_pattern(HEX)}", LEAST["hex"])]


def _values(docs: DataFrame) -> DataFrame:
    """Labelled samples of (text): (value, secret) with the values of the fixed patterns and other runs."""
    blank = F.col("text")
    for p in (ASSIGN, ACCESS, HEX):
        blank = F.regexp_replace(blank, p, "\n")
    secret = F.concat(
        F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), 2), lambda v: F.length(v) >= LEAST["assign"]),
        F.filter(F.regexp_extract_all("text", F.lit(ACCESS), 0), lambda v: F.length(v) >= LEAST["access"]),
        F.regexp_extract_all("text", F.lit(HEX), 0))
    known = docs.select(F.explode(secret).alias("value")).withColumn("secret", F.lit(True))
    other = docs.select(F.explode(F.regexp_extract_all(blank, F.lit(RUN + "{8,}"), 0)).alias("value"))
    return known.unionByName(other.withColumn("secret", F.lit(False)))


def train(samples: DataFrame, random_weight: float = 500.0, ordinary_weight: float = 20.0) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of all pairs of characters of ``ALPHABET``, row by row.

    ``samples`` holds (value, secret).  The result has one number per pair, whatever the input.  Pairs lean by
    ``random_weight`` to equal chances, and by ``ordinary_weight`` to how often the second character is ordinary.
    """
    n = len(ALPHABET)
    chars = samples.where(F.length("value") > 1).select("secret", F.split("value", "").alias("c"))
    pairs = chars.select("secret", F.explode(F.expr(
        "zip_with(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1), (a, b) -> concat(a, b))")).alias("pair")).groupBy(
        "secret", "pair").agg(F.count("*").alias("n"))
    known = pairs.select("secret", F.expr(f"locate(substring(pair, 1, 1), '{ALPHABET}')").alias("a"),
                         F.expr(f"locate(substring(pair, 2, 1), '{ALPHABET}')").alias("b"), "n").where("a > 0 AND b > 0")
    side = lambda s: F.sum(F.when(F.col("secret") == s, F.col("n")).otherwise(0))
    counts = known.groupBy("a", "b").agg(side(True).alias("r"), side(False).alias("o"))
    grid = samples.sparkSession.range(n * n).select(
        (F.floor(F.col("id") / n) + 1).cast("int").alias("a"), (F.col("id") % n + 1).cast("int").alias("b"))
    full = grid.join(counts, ["a", "b"], "left").na.fill(0, ["r", "o"])
    first, second, whole = (Window.partitionBy(*k) for k in (["a"], ["b"], []))
    plain = (F.sum("o").over(second) + 0.5) / (F.sum("o").over(whole) + 0.5 * n)
    random = (F.col("r") + random_weight / n) / (F.sum("r").over(first) + random_weight)
    ordinary = (F.col("o") + ordinary_weight * plain) / (F.sum("o").over(first) + ordinary_weight)
    return [r.l for r in full.select("a", "b", F.log(random / ordinary).alias("l")).orderBy("a", "b").collect()]


def ratio(value: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of the pairs of a text of two or more ``ALPHABET`` characters."""
    n = len(ALPHABET)
    ratios = F.from_json(F.lit(json.dumps(table)), "array<double>")
    places = F.transform(F.split(value, ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)))
    # The state is (sum, place of the character before); splitting makes long runs linear.
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("before"))
    total = F.aggregate(places, start, lambda s, b: F.struct((s["sum"] + F.when(s["before"] == 0, 0.0).otherwise(
        F.element_at(ratios, (s["before"] - 1) * n + b))).alias("sum"), b.alias("before")), lambda s: s["sum"])
    return total / (F.length(value) - 1)


def learned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 20_000) -> list[float]:
    """Ratios learned from at most ``max_docs`` documents, chosen by a hash of their ids."""
    chosen = bounded(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), max_docs, "id")
    return train(_values(chosen))


def scan(docs: DataFrame, table: list[float], id_col: str = "doc_id", text_col: str = "text", least: int = 20,
         threshold: float = 2.5) -> DataFrame:
    """(id, found) of every row of ``docs``; found is an array of (start, kind, end, base) by start, then kind.

    kind is a place in ``KINDS``; positions are code points, end exclusive.  Fixed patterns are matched from the
    left without overlap, kind by kind, and what is too short is dropped after matching.  Runs of ``least``
    characters with a mean ratio over the ``threshold`` are added where they touch no match of a fixed pattern.  Null and empty
    texts have none.  Rows with equal id and text are scanned alike; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    run = f"{RUN}{{{least},}}"
    marked = rows.select("id", "text", F.lower("text").alias("low"),
                         F.when(F.col("text").rlike(run), F.regexp_extract_all("text", F.lit(run), 0)).alias("runs"))
    scored = marked.withColumn("scores", F.transform("runs", lambda v: ratio(v, table)))
    markov = f"""CASE WHEN exists(scores, s -> s > {threshold}D) THEN transform(arrays_zip(
        transform(split(text, {_pattern(run)}, -1), g -> length(g)), runs, scores), (z, i) ->
        struct(3 AS kind, i AS i, z.`0` AS gap, coalesce(length(z.runs), 0) AS size,
               coalesce(z.scores > {threshold}D, false) AS good)) ELSE CAST(array() AS {HIT}) END"""
    hits = scored.select("id", F.xxhash64("text").alias("th"), F.expr(
        f"concat({', '.join(_base() + [markov])})").alias("hits"))
    table_of = materialise(hits, "secret-hits")
    each = table_of.where(F.size("hits") > 0).distinct().select("id", "th", F.explode("hits").alias("h")).select(
        "id", "th", "h.*")
    before = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("id", "th", "kind").orderBy("i"))
    placed = each.withColumn("end", before.cast("int")).where("good").select(
        "id", "th", F.struct((F.col("end") - F.col("size")).alias("start"), "kind", "end").alias("span"))
    # A sweep in both directions: how far the fixed spans reach that start no later, and where the next one starts.
    of_text = Window.partitionBy("id", "th")
    reached = F.max(F.when(F.col("span.kind") < 3, F.col("span.end"))).over(of_text.orderBy("span.start").rangeBetween(
        Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(F.col("span.kind") < 3, F.col("span.start"))).over(of_text.orderBy(F.desc("span.start")).rangeBetween(
        Window.unboundedPreceding, Window.currentRow))
    touched = F.coalesce((F.col("reached") > F.col("span.start")) | (F.col("ahead") < F.col("span.end")), F.lit(False))
    apart = placed.withColumn("reached", reached).withColumn("ahead", ahead).where((F.col("span.kind") < 3) | ~touched)
    found = apart.groupBy("id", "th").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    out = table_of.select("id", "th").join(
        found.select(F.col("id").alias("i"), F.col("th").alias("t"), F.col("spans").alias("found")),
        F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left")
    return out.select("id", F.coalesce("found", F.array().cast(
        "array<struct<start:int,kind:int,end:int>>")).alias("found"))


def listed(found: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
