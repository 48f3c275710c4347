"""Importance resampling of documents towards a target distribution, over hashed n-grams of words.

A document's features are its runs of 1 to ``ORDER`` words.  A table of 256 bytes lower-cases A-Z and blanks the
separators of the UTF-8 text, ``bytes.split`` yields the words, and a CRC-32 of an n-gram is the seed of the one
that is a word longer, so every word is hashed once an order.  Counters reduce the features of a task to at most
``buckets`` numbers; Spark adds those up for all documents and for all texts of the target.

A bucket's gain is the logarithm of target over raw share, a document's weight the sum over its features.  Weights
plus Gumbel noise from a hash of the id, ranked, are a draw without replacement.  The drawn share is ranked by a
range partition whose sizes are added up; no task sees more than its range, and the driver holds ``buckets`` gains.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from auditloom.functions.session import materialise

ORDER = 3
BLOCK = 1 << 20
PART = 1000
#: Digits, small letters and bytes of other scripts stay, A-Z become small, all else becomes a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def grams(text: bytes, order: int = ORDER) -> Iterator[tuple[int, list[int]]]:
    """A block of about 1 MB at a time: the number of its words and the CRC-32 of all n-grams that end in it."""
    clean, at, carried = text.translate(TABLE), 0, []
    while at < len(clean):
        cut = clean.find(b" ", at + BLOCK)
        end = cut if cut >= 0 else len(clean)
        words = carried + clean[at:end].split()
        spaced = [b" " + w for w in words]
        seeds = list(map(crc32, words))
        found = seeds[len(carried):]
        for n in range(1, order):
            seeds = list(map(crc32, spaced[n:], seeds))
            found += seeds[max(len(carried) - n, 0):]
        yield len(words) - len(carried), found
        carried, at = words[max(len(words) - order + 1, 0):], end


def _counted(buckets: int):
    def run(batches):
        counts = Counter()
        for batch in batches:
            for text in batch.column("text"):
                for _, found in grams(text.as_py()):
                    counts.update((np.array(found, np.uint32) % np.uint32(buckets)).tolist())
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(counts.keys(), pa.int32()),
                                          "n": pa.array(counts.values(), pa.int64())})
    return run


def bucket_counts(texts: DataFrame, buckets: int = 10_000, text_col: str = "text") -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; nulls have none, empty buckets no row."""
    own = texts.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("binary").alias("text"))
    return own.mapInArrow(_counted(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = 10_000, text_col: str = "text") -> np.ndarray:
    """Per bucket floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of add-one smoothed shares."""
    counts = []
    for side in (docs, target):
        found = bucket_counts(side, buckets, text_col).toArrow()  # one row a bucket at most
        own = np.zeros(buckets)
        own[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
        counts.append(own)
    s, t = counts
    of_s, of_t = float(s.sum()) + buckets, float(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * of_s / ((a + 1) * of_t))) for a, b in zip(s, t)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of every row of ``docs``; null and empty texts have zeros."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        own = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, PART):
                part, rows = batch.slice(k, PART), []
                for text in part.column("text"):
                    n_words = n_features = weight = 0
                    for n, found in grams(text.as_py() or b""):
                        n_words, n_features = n_words + n, n_features + len(found)
                        weight += int(own[np.array(found, np.uint32) % np.uint32(len(own))].sum())
                    rows.append((n_words, n_features, weight))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns],
                                                 ["id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, f"id {kind}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """(row, rank): the first ``most`` of ``rows`` (row, id, score) by falling score, then id, then row, from 1.

    ``rows`` is a table; ``row`` tells its rows apart.  Rows far below the cut are left out by an approximate
    quantile, if enough remain; ranges of the rest are counted, and a range's rows follow those of all before it.
    """
    total = rows.count()
    if not most or not total:
        return rows.limit(0).select("row", F.lit(0).cast("long").alias("rank"))
    cut = rows.agg(F.percentile_approx("score", F.lit(max(0.0, 1 - 2 * most / total)), F.lit(1000))).first()[0]
    high = rows.where(F.col("score") >= cut)
    high = high if high.count() >= most else rows
    order = [F.desc("score"), F.asc_nulls_first("id"), F.asc("row")]
    dealt = materialise(high.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = dealt.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inner = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.join(starts, "part").select("row", (F.col("start") + inner).alias("rank")).where(F.col("rank") <= most)


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42,
              buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of ``docs``; drawn rows have a rank from 1.

    Of the N rows with ``least_words`` words, floor(percent * N / 100) are drawn: those of the highest scores, ties
    to the smaller id.  score is weight plus floor(-1000 ln(-ln(u))), u from the first 32 bits of the SHA-256 of
    ``seed:id`` (of ``seed:`` for a null id).  Rows with equal id and score are ranked one after the other, null ids
    before others; empty tables are allowed on both sides.  Other columns are not read.
    """
    found = weighted(docs, gains(docs, target, buckets, text_col), id_col, text_col)
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = materialise(found.select("*", (F.col("weight") + noise).alias("score"),
                                      F.monotonically_increasing_id().alias("row")), "resample-scores")
    able = scored.where(F.col("n_words") >= least_words).select("row", "id", "score")
    return scored.join(ranked(able, percent * able.count() // 100), "row", "left").drop("row")
