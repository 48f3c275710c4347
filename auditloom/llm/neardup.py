"""Near-duplicates by the similarity of shingle sets, with MinHash candidates.

Texts are as similar as the Jaccard index of their sets of shingles.  The Golay keys of ``simhash`` do not find
texts of similarity 0.8: their fingerprints differ in 5 to 10 bits and more of 64, and those keys reach two.  So
the candidate keys of a text are BANDS keys of ROWS least hashes each; a pair of similarity s shares none of them
with probability (1 - s ** ROWS) ** BANDS, 3e-6 at 0.8 and less above.  All candidates are verified by the exact
Jaccard index.

Texts with equal sets are one node.  In keys of up to ALL nodes every pair is a candidate.  A larger key may be a
large group of near copies, whose pairs would be too many.  There every node is compared with the key's hub, the one
that meets most others over all its keys, which is the text that the copies were made from, if it is there.  What
this can lose are links of nodes that are not similar to any hub of theirs.  With ``exact`` nodes that are not
connected with most of their key by then are searched for partners among all nodes of such keys by prefix
filtering: the elements of each set in order of rarity, of which two sets of this similarity share one among the
first few.  Pairs without such an element are proven apart, the others are compared; nothing is lost, but the
pairs grow with the square of a group whose texts are all of about this similarity.
Pairs that are connected already are compared no more.  Only nodes that share a key have their sets written.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from auditloom.functions.session import materialise
from auditloom.llm.components import connected
from auditloom.llm.simhash import _blocks

BANDS, ROWS = 24, 4
ALL = 16
_RNG = np.random.default_rng(11)
FACTORS, TERMS = (_RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1) for _ in range(2))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the shingles of ``width`` words; fewer words are one shingle."""
    found, words = [], []
    for block in _blocks(text or b""):
        words += block
        count = len(words) - width + 1
        if count > 0:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
            found.append(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, count))
            words = words[count:]
    if not found and words:
        found.append(np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _node(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64))


def least_hashes(own: np.ndarray) -> np.ndarray:
    """Least of BANDS * ROWS hashes each over a set of hashes (uint64), as bands of rows."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), 4096):
        mixed = own[k:k + 4096, None] * FACTORS + TERMS
        out = np.minimum(out, ((mixed ^ mixed >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)).min(0))
    return out.reshape(BANDS, ROWS)


def keys(own: np.ndarray) -> list[int]:
    """Candidate keys of a set, one a band; none of an empty set."""
    found = [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least_hashes(own))] if len(own) else []
    return np.array(found, np.uint64).view(np.int64).tolist()


def _noded(width: int):
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                nodes, found = [], []
                for t in part.column("text"):
                    own = shingle_set(t.as_py(), width)
                    nodes.append(_node(own))
                    found.append(keys(own))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("th"), pa.array(nodes, pa.int64()),
                     pa.array(found, pa.list_(pa.int64()))], ["id", "th", "node", "keys"])
    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                found = [shingle_set(t.as_py(), width) for t in batch.column("text").slice(k, 100)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(map(_node, found), pa.int64()),
                     pa.array([own.view(np.int64) for own in found], pa.list_(pa.int64()))], ["node", "own"])
    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    met = pairs.join(sets.select(F.col("node").alias("b"), F.col("own").alias("of_b")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("own").alias("of_a")), "a")
    both = F.size(F.array_intersect("of_a", "of_b"))
    either = F.size("of_a") + F.size("of_b")
    # Half of a millionth of an element keeps equality safe from rounding.
    return met.select("a", "b", both.alias("both"), either.alias("sum")).where(
        F.col("both") >= similarity * (F.col("sum") - F.col("both")) - 5e-7).select("a", "b")


def _rare(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, n, token, place): so many of the rarest elements of each set of n that two sets of ``similarity`` share
    one, without those that no other set holds."""
    tokens = materialise(nodes.join(sets, "node").select("node", F.size("own").alias("n"), F.explode("own").alias("token")),
                         "near-tokens")
    rarity = tokens.groupBy("token").agg(F.count("*").alias("held"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("held", "token"))  # a text's own elements
    return tokens.join(rarity, "token").withColumn("place", place).where(
        F.col("place") <= F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1).where("held > 1").select(
        "node", "n", "token", "place")


def _left_over(large: DataFrame, found: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs left to compare of nodes that are not connected with most of one of their large keys."""
    labelled = materialise(large.select("key", "node").join(connected(found), "node", "left").select(
        "key", "node", F.coalesce("root", "node").alias("root")), "near-labels")
    most = labelled.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.max(F.struct("n", "root")).alias("most"))
    apart = materialise(labelled.join(most, "key").where("root <> most.root").select("key", "node").distinct(),
                        "near-apart")
    roots = labelled.select("node", "root").distinct()
    all_ = labelled.join(apart.select("key").distinct(), "key", "left_semi").select("node").distinct()
    rare = materialise(_rare(all_, sets, similarity).join(roots, "node"), "near-rare")
    few = rare.join(apart.select("node").distinct(), "node", "left_semi")
    a, b = (rows.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "place", "root")])
            for rows, side in ((few, "a"), (rare, "b")))
    # At the rarest element that two similar sets share, as many must be left in both as they share.
    left = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1
    shared = (F.col("n_a") + F.col("n_b")) * (similarity / (1 + similarity))
    met = a.join(b, "token").where((F.col("root_a") != F.col("root_b")) & (left >= shared - 1e-6))
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def similar_links(keyed: DataFrame, sets_of, similarity: float, exact: bool = True) -> DataFrame:
    """(a, b): verified links between nodes of ``keyed`` (key, node; distinct); ``sets_of`` gives (node, own) of some
    nodes.  With ``exact`` they connect all nodes that chains of similar nodes with a common key connect."""
    shared = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-shared")
    met = materialise(keyed.join(shared, "key"), "near-met")
    few, large = met.where(F.col("n") <= ALL), met.where(F.col("n") > ALL)
    meets = met.groupBy("node").agg(F.sum("n").alias("meets"))
    hubs = large.join(meets, "node").groupBy("key").agg(F.max(F.struct("meets", "node"))["node"].alias("hub"))
    pairs = few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")), "key").where(
        "a < b").select("a", "b").unionByName(large.join(hubs, "key").where("node <> hub").select(
            F.col("hub").alias("a"), F.col("node").alias("b")))
    counted = materialise(pairs.groupBy("a", "b").agg(F.count("*").alias("n")), "near-pairs")
    ends = counted.select(F.col("a").alias("node")).unionByName(counted.select(F.col("b").alias("node"))).distinct()
    sets = materialise(sets_of(ends), "near-sets")
    best = materialise(counted.groupBy("b").agg(F.max(F.struct("n", "a")).alias("m")).select(
        F.col("m.a").alias("a"), "b"), "near-best")
    first = materialise(_verified(best, sets, similarity), "near-first")
    of_a, of_b = (first.select(F.col("b").alias(c), F.col("a").alias(f"root_{c}")) for c in "ab")
    rest = counted.join(best, ["a", "b"], "left_anti").join(of_a, "a", "left").join(of_b, "b", "left").where(
        F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    found = materialise(first.unionByName(_verified(rest, sets, similarity)), "near-found")
    if not exact:
        return found
    return found.unionByName(_verified(_left_over(large, found, sets, similarity), sets, similarity))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    similarity: float = 0.8, exact: bool = True) -> DataFrame:
    """(id, th, component, kept) of every row of ``docs``; th is the XXH64 hash of the text.  For ``exact`` see above.

    component: least id reachable over texts whose sets of shingles of ``width`` words (A-Z lower-cased; fewer
    words are one shingle) have a Jaccard index of at least ``similarity``, a row's own included; kept: the row has
    that id.  Null and empty texts have the empty set and are linked.  Null ids are never a component's least id
    unless it has no other; then the component is null and its rows are kept.  Rows with equal ids are kept or left
    together if their texts are linked.  Other columns of ``docs`` are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"),
                       F.col(text_col).cast("binary").alias("text"))
    noded = materialise(rows.mapInArrow(_noded(width), f"id {kind}, th long, node long, keys array<long>"), "near-nodes")
    place = F.struct("id", "th")
    nodes = materialise(noded.groupBy("node").agg(F.min("id").alias("first"), F.min(place).alias("at"),
                                                  F.min("keys").alias("keys")), "near-distinct")

    def sets_of(ends: DataFrame) -> DataFrame:
        at = nodes.join(ends, "node", "left_semi").select(F.col("at.id").alias("i"), F.col("at.th").alias("t"))
        chosen = rows.join(at, rows["id"].eqNullSafe(F.col("i")) & (rows["th"] == F.col("t")), "left_semi")
        return chosen.select("text").mapInArrow(_sets(width), "node long, own array<long>").dropDuplicates(["node"])

    roots = connected(similar_links(nodes.select("node", F.explode("keys").alias("key")), sets_of, similarity, exact))
    joined = materialise(nodes.join(roots, "node", "left").select(
        "node", "first", F.coalesce("root", "node").alias("root")), "near-roots")
    least = joined.groupBy("root").agg(F.min("first").alias("component"))
    known = materialise(joined.join(least, "root").select("node", "component"), "near-components")
    return noded.select("id", "th", "node").join(known, "node").select(
        "id", "th", "component", F.col("id").eqNullSafe(F.col("component")).alias("kept"))
