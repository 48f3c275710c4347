"""Connected components by alternating large and small stars; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from auditloom.functions.session import materialise


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """One star step.  ``edges`` holds (u, v) with u > v.

    The least neighbour of each node is a partial aggregate; a busy node is one row there, and its many
    edges are a skewed side that adaptive execution splits.
    """
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = materialise(seen.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "stars")
    met = seen.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.where("u <> m").select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: long); root is the least node it is connected to.

    Loops and repeated edges are allowed, nulls are not.  Rounds grow with the logarithm of the longest chain.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                      .distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark or new[0] == 0:
            break
        mark = new
        now = materialise(_starred(_starred(now, True), False), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
