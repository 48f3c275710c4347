"""Exact top-k search by distributed histogram selection.

Vectors are whole numbers, floor(256 * x) of every component, so scores are exact integers.  Queries are taken
in blocks of bounded size.  For a block every candidate is scored, each task counts scores in a histogram per
query, and the sums show in which bin a query's k-th highest score lies.  That bin becomes the next histogram's
range, until bins are one number wide and the k-th score is known.  A last pass keeps what is above it, and of
the ties at it the smallest ids of each task; ranks then settle them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from auditloom.functions.session import materialise

BINS = 256
ROWS = 1024  # candidates scored at once
NONE = -(1 << 62)  # below all scores


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors as array<long>; null ids and vectors that are null or hold nulls, NaN or infinities go."""
    v = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (
        F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(
        v, lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("v"))


def _by_length(ids: np.ndarray, column: pa.ListArray, exact: bool):
    """Row numbers, ids and matrix of the vectors of each length."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for n in np.unique(sizes):
        row = np.flatnonzero(sizes == n)
        at = (ends - sizes)[row][:, None] + np.arange(n)
        yield int(n), row, ids[row], flat[at].astype(np.int64 if exact else np.float64)


def _scores(batches, queries: dict, exact: bool):
    """For parts of the candidates: their ids, the numbers of the queries they meet, and scores (row, query)."""
    for batch in batches:
        for n, _, ids, matrix in _by_length(batch.column("id").to_numpy(), batch.column("v"), exact):
            if n not in queries:
                continue
            number, own, other = queries[n]
            for k in range(0, len(ids), ROWS):
                score = (matrix[k:k + ROWS] @ other.T).astype(np.int64)
                at = np.searchsorted(own, ids[k:k + ROWS]).clip(max=len(own) - 1)
                same = np.flatnonzero(own[at] == ids[k:k + ROWS])
                score[same, at[same]] = NONE
                yield ids[k:k + ROWS], number, score


def _best(query, score, ids, most: int):
    """Of rows (query, score, id) the first ``most`` of each query by falling score and rising id."""
    order = np.lexsort((ids, -score, query))
    query, score, ids = query[order], score[order], ids[order]
    start = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, int)
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
    return query[rank < most], score[rank < most], ids[rank < most]


def _block(candidates: DataFrame, queries: pa.Table, k: int, reach: int, exact: bool) -> DataFrame:
    """(query, id, score): at least the k best of each query of a block, few more."""
    spark = candidates.sparkSession
    ids = queries.column("id").to_numpy()
    order = np.argsort(ids)
    table = queries.take(pa.array(order)).combine_chunks()
    ids, column = ids[order], table.column("v").combine_chunks()
    groups = {n: (row, own, m) for n, row, own, m in _by_length(
        ids, column.chunk(0) if isinstance(column, pa.ChunkedArray) else column, exact)}
    shared = spark.sparkContext.broadcast(groups)
    width, span = (2 * reach) // BINS, BINS  # reach is a power of two, so both are
    low = np.full(len(ids), -reach, np.int64)
    need = np.full(len(ids), k, np.int64)
    while True:
        def counted(batches, low=low, width=width, span=span):
            counts = np.zeros((len(low), BINS), np.int64)
            for _, number, score in _scores(batches, shared.value, exact):
                place = (score - low[number]) // width
                inside = (place >= 0) & (place < span)
                flat = (np.arange(len(number)) * BINS + place)[inside]
                counts[number] += np.bincount(flat, minlength=len(number) * BINS).reshape(-1, BINS)
            q, b = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)),
                                              pa.array(counts[q, b])], ["q", "bin", "n"])

        seen = candidates.mapInArrow(counted, "q int, bin int, n long").groupBy("q", "bin").agg(
            F.sum("n").alias("n")).toArrow()  # at most BINS rows for each query of the block
        counts = np.zeros((len(ids), BINS), np.int64)
        counts[seen.column("q").to_numpy(), seen.column("bin").to_numpy()] = seen.column("n").to_numpy()
        from_top = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
        known = from_top[:, 0] >= need  # else there are fewer than k candidates in all
        chosen = np.where(known, (from_top >= need[:, None]).sum(1) - 1, 0)
        above = np.append(from_top, np.zeros((len(ids), 1), np.int64), axis=1)[np.arange(len(ids)), chosen + 1]
        low = np.where(known, low + chosen * width, low)
        need = np.where(known, need - above, need)
        if width == 1:
            break
        width, span = max(1, width // BINS), min(BINS, width)
    least = np.where(known, low, NONE + 1)

    def kept(batches):
        rows = tuple(np.zeros(0, np.int64) for _ in range(3))
        for own, number, score in _scores(batches, shared.value, exact):
            row, col = np.nonzero(score >= least[number])
            rows = _best(*(np.concatenate(x) for x in zip(rows, (number[col], score[row, col], own[row]))), k)
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows[0]]), pa.array(rows[2]), pa.array(rows[1])],
                                         ["query", "id", "score"])

    return candidates.mapInArrow(kept, "query long, id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
          vector_col: str = "embedding", block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every query with all other vectors.

    ``queries`` holds rows of the same columns.  Rows with the query's id are its own and no candidates; a
    repeated query id is searched once, with its least vector.  Repeated candidates count each.  Ties go to the
    smaller id.  Vectors of different lengths do not meet.  ``block`` bounds the queries that are broadcast at a
    time (twice as many at most are ever in one).  Other columns are not read.
    """
    spark = vectors.sparkSession
    candidates = materialise(whole_vectors(vectors, id_col, vector_col), "topk-candidates")
    asked = whole_vectors(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    ordered = materialise(asked, "topk-queries")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, most = ordered.count(), candidates.agg(F.max(square)).first()[0]
    parts = []
    if n and most is not None:
        reach = 1 << max(7, math.ceil(math.log2(most * (1 + 1e-9) + 1)))
        if reach > 1 << 60:
            raise ValueError("scores may leave the range of a long")
        blocks = math.ceil(n / block)
        numbered = ordered.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        for b in range(blocks):
            rows = numbered.where(F.col("b") == b).select("id", "v").toArrow()
            for at in range(0, rows.num_rows, 2 * block):
                parts.append(materialise(_block(candidates, rows.slice(at, 2 * block), k, reach, reach > 1 << 52),
                                         "topk-found"))
    found = parts[0] if parts else spark.createDataFrame([], "query long, id long, score long")
    for p in parts[1:]:
        found = found.unionByName(p)
    ranks = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k).select(
        F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
