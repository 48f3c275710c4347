"""Ordered computations per key that stay parallel when one key holds much of the data.

A plain window over a hot key sorts all its rows in one task.  Here each key's order is cut into
buckets (an expression that never decreases along the order: an hour, a score and hash prefix).
Rows meet only within (key, bucket); between buckets only one summary row per bucket moves.
Key columns must not be null.  The input is read twice (summaries and rows): pass a table, or a narrow
relation written by ``materialise``, rather than a computation over texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from auditloom.functions.session import materialise


def running_sums(df: DataFrame, keys: Sequence[str], bucket: Sequence[Column],
                 order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """Add running totals (inclusive) of ``sums`` over each key in (bucket, order)."""
    names = [f"_b{i}" for i in range(len(bucket))]
    at = df.withColumns(dict(zip(names, bucket)) | {f"_v_{n}": v for n, v in sums.items()})
    totals = at.groupBy(*keys, *names).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, *names, *[
        F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_p_{n}") for n in sums])
    inner = Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    out = at.join(before, [*keys, *names])
    for n in sums:
        out = out.withColumn(n, F.col(f"_p_{n}") + F.sum(f"_v_{n}").over(inner))
    return out.select(*df.columns, *sums)


def range_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """``running_sums`` without a bucket: rows are dealt by ranges of (keys, order), so a key of any size is spread
    evenly over tasks; a range's totals move to the ranges after it as one row a (key, range).

    ``order`` must tell rows of a key apart, or large ties stay together.
    """
    keyed = df.withColumns({f"_v_{n}": v for n, v in sums.items()})
    dealt = materialise(keyed.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*keys, "_range").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_range", *[
        F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_p_{n}") for n in sums])
    inner = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.join(before, [*keys, "_range"])
    for n in sums:
        out = out.withColumn(n, F.col(f"_p_{n}") + F.sum(f"_v_{n}").over(inner))
    return out.select(*df.columns, *sums)


def with_previous(df: DataFrame, keys: Sequence[str], bucket: Column, order: Column,
                  columns: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Add the values of ``columns`` of the key's previous row (null for its first row).

    ``order`` must be unique within a key and consistent with ``bucket``.
    """
    at = df.withColumns({"_b": bucket, "_o": order})
    last = at.groupBy(*keys, "_b").agg(
        F.max_by(F.struct(*columns), F.col("_o")).alias("_last"))
    by_bucket = Window.partitionBy(*keys).orderBy("_b")
    carried = last.select(*keys, F.lead("_b").over(by_bucket).alias("_b"), "_last").where(
        F.col("_b").isNotNull())
    inner = Window.partitionBy(*keys, "_b").orderBy("_o")
    out = at.join(carried, [*keys, "_b"], "left").withColumn("_rn", F.row_number().over(inner))
    for c in columns:
        out = out.withColumn(prefix + c, F.when(F.col("_rn") == 1, F.col("_last")[c]).otherwise(
            F.lag(c).over(inner)))
    return out.select(*df.columns, *[prefix + c for c in columns])
