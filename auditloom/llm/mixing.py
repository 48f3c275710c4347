"""Mixing sources to target weights by temperature.

Source shares of tokens are raised to an exponent and normalised: exponent 1 keeps the shares, 0 makes them
equal.  The exponent is found by bisection, for a target entropy or for a limit on repetition; each Spark job
over the source table takes several bisection steps at once by measuring the ends of all their intervals.

The weights are realised as budgets.  A source's budget is filled with whole permutations (blocks) of its
documents and a last block that stops before the budget is passed.  A block's order is a hash of seed, block
and document, and its running totals use two levels: documents meet in slices of the hash range that hold a
bounded number of rows on average, and slices pass on their sums in two further levels, so that a source with
a third of all rows is no hot key.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from auditloom.functions.session import materialise
from auditloom.llm.chars import WORD

STEPS = 6  # bisection steps of one job


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 source_col: str = "source") -> DataFrame:
    """(id, source, tokens): words of every text; null texts have none, null sources are a source of their own."""
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"))


def _at(shares: DataFrame, lo: float, hi: float) -> list:
    """For 2 ** STEPS + 1 exponents between lo and hi: exponent x, entropy, and the most a source is repeated
    (mass of the weights over mass of the shares, against the source that is repeated least)."""
    n = 2 ** STEPS
    x = F.lit(lo) + (F.lit(hi) - F.lit(lo)) * F.col("k") / n
    power = F.exp(F.col("x") * F.col("l"))
    each = shares.select("l", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("k")).select("k", "l", x.alias("x"))
    sums = each.groupBy("k").agg(F.first("x").alias("x"), F.sum(power).alias("z"),
                                 F.sum(power * F.col("x") * F.col("l")).alias("zl"),
                                 F.max((F.col("x") - 1) * F.col("l")).alias("most"),
                                 F.min((F.col("x") - 1) * F.col("l")).alias("least"))
    return sums.select("x", (F.log("z") - F.col("zl") / F.col("z")).alias("entropy"),
                       F.exp(F.col("most") - F.col("least")).alias("repeats")).orderBy("x").collect()


def exponent(sources: DataFrame, entropy: float | None = None, repeats: float | None = None,
             jobs: int = 6) -> float:
    """Exponent for a target: ``entropy`` (nats) of the weights, or the least exponent at which no source is
    repeated more than ``repeats`` times as often as the one repeated least.

    ``sources`` has (source, tokens) with one row per source; sources without tokens have no share.  The answer
    is between 0 and 1 for ``repeats`` and between 0 and 64 for ``entropy``; a target out of reach gives the
    nearer end.  Both measures move one way in the exponent, so bisection finds the crossing.
    """
    if (entropy is None) == (repeats is None):
        raise ValueError("state entropy or repeats")
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    shares = materialise(sources.where("tokens > 0").select(F.log(F.col("tokens") / F.lit(total)).alias("l")),
                         "mixing-shares")
    lo, hi = 0.0, 1.0 if repeats is not None else 64.0
    for _ in range(jobs):
        seen = _at(shares, lo, hi)
        above = [(r.repeats > repeats if repeats is not None else r.entropy > entropy) for r in seen]
        if not above[0]:
            return seen[0].x
        if above[-1]:
            return seen[-1].x
        k = max(i for i, a in enumerate(above) if a)
        lo, hi = seen[k].x, seen[k + 1].x
    return hi


def weights(sources: DataFrame, power: float) -> DataFrame:
    """(source, tokens, weight, raw): weights of the sources with tokens; raw is tokens ** power, not normalised."""
    raised = sources.where("tokens > 0").withColumn("raw", F.exp(F.lit(power) * F.log("tokens")))
    total = raised.agg(F.sum("raw")).first()[0] or 1.0
    return raised.withColumn("weight", F.col("raw") / F.lit(total)).select("source", "tokens", "weight", "raw")


def budgets(weighted: DataFrame, total: float | None = None) -> DataFrame:
    """(source, tokens, weight, budget, blocks): tokens to take from each source and its number of whole blocks.

    ``total`` None takes the least total at which every source is passed over at least once.
    """
    if total is None:
        total = weighted.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
    # The tolerance keeps a budget that is a whole number of blocks from losing one to rounding.
    budget = F.floor(F.col("weight") * F.lit(float(total)) + 1e-6 * F.col("tokens")).cast("long")
    return weighted.select("source", "tokens", "weight", budget.alias("budget")).withColumn(
        "blocks", F.floor(F.col("budget") / F.col("tokens")).cast("int"))


def plan(counts: DataFrame, budgeted: DataFrame, seed: int = 0, rows_per_slice: int = 1_000) -> DataFrame:
    """(id, source, tokens, block, slot): every use of every document, blocks from 0, slot orders a block.

    Whole blocks hold all documents of a source with tokens.  The last block takes documents in the order of
    slot, then id, while their running total stays within what is left of the budget.  Documents without tokens
    are used once, in block 0.  Repeated rows are documents of their own.
    """
    used = counts.join(budgeted.select(F.col("source").alias("s"), F.col("tokens").alias("all"), "budget", "blocks"),
                       F.col("source").eqNullSafe(F.col("s")), "left")
    slot = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "block", "id"), 1)
    passes = F.when((F.col("tokens") == 0) | F.col("s").isNull(), 1).otherwise(F.col("blocks"))
    whole = used.where(passes > 0).select(
        "id", "source", "tokens", F.explode(F.sequence(F.lit(0), passes - 1)).alias("block"))
    part = used.where("tokens > 0 AND budget > blocks * all").select(
        "id", "source", "tokens", F.col("blocks").alias("block"),
        (F.col("budget") - F.col("blocks").cast("long") * F.col("all")).alias("left")).withColumn("slot", slot)
    n = counts.count()
    bits = max(0, math.ceil(math.log2(max(1, n / rows_per_slice))))
    fine = F.shiftright("slot", 63 - bits)  # slots are 63-bit numbers, slices are ranges of them
    part = materialise(part.withColumns({"fine": fine, "coarse": F.shiftright(fine, bits // 2)}), "mixing-part")
    sums = part.groupBy("source", "coarse", "fine").agg(F.sum("tokens").alias("t"))
    tops = sums.groupBy("source", "coarse").agg(F.sum("t").alias("t"))
    tops = tops.select("source", "coarse", (F.sum("t").over(Window.partitionBy("source").orderBy("coarse"))
                                            - F.col("t")).alias("base"))
    inner = F.sum("t").over(Window.partitionBy("source", "coarse").orderBy("fine")) - F.col("t")
    bases = sums.select("source", "coarse", "fine", inner.alias("inner")).alias("i").join(
        tops.alias("o"), F.col("i.source").eqNullSafe(F.col("o.source")) & F.expr("i.coarse = o.coarse")).select(
        F.col("i.source").alias("s"), F.col("i.fine").alias("f"), (F.col("inner") + F.col("base")).alias("base"))
    own = F.sum("tokens").over(Window.partitionBy("source", "fine").orderBy("slot", "id")
                               .rowsBetween(Window.unboundedPreceding, 0))
    last = part.withColumn("own", own).join(
        bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("fine") == F.col("f"))).where(
        F.col("base") + F.col("own") <= F.col("left"))
    columns = ("id", "source", "tokens", "block", "slot")
    return whole.withColumn("slot", slot).select(*columns).unionByName(last.select(*columns))


def mix(docs: DataFrame, entropy: float | None = None, repeats: float | None = None, total: float | None = None,
        seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The plan of a mixture of ``docs``: (id, source, tokens, block, slot).

    Null and empty texts are used once; with an empty table the plan is empty.  Ties of slots go to the smaller
    id.  Other columns are not read.
    """
    counts = materialise(token_counts(docs, id_col, text_col, source_col), "mixing-counts")
    sources = materialise(counts.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mixing-sources")
    weighted = weights(sources, exponent(sources, entropy, repeats))
    return plan(counts, materialise(budgets(weighted, total), "mixing-budgets"), seed)


def mixed_rows(docs: DataFrame, planned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, each as often as the plan uses it.

    Rows with equal ids are used alike: each as often as the plan uses the id, over its number of rows, rounded
    up.  Null ids are an id.
    """
    first = F.count_if(F.col("block") == 0)  # every row used at all is in block 0 or, alone, in a part of it
    uses = planned.groupBy("id").agg(F.ceil(F.count("*") / F.greatest(first, F.lit(1))).cast("int").alias("uses"))
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("key"))
    met = own.join(uses, own["key"].eqNullSafe(uses["id"]))
    return met.select("row", F.explode(F.array_repeat(F.lit(1), F.col("uses")))).select("row.*")
