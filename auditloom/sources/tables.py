"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.functions.session import spread


def table(spark: SparkSession, folder: str, name: str, *spread_by: str, per_split: int = 1) -> DataFrame:
    """A table of a folder; with ``spread_by`` a scan of too few splits is spread over the cores, see ``spread``."""
    scan = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(scan, *spread_by, per_split=per_split) if spread_by else scan
