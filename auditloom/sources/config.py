"""User configuration as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditloom import rules as R

SINK_SCHEMA = "middleware array<string>, decorators array<string>, patterns array<string>"


def default_sinks(spark: SparkSession) -> DataFrame:
    rows = [(kind, value) for kind, values in (
        ("middleware", R.SINK_MIDDLEWARE), ("decorators", R.SINK_DECORATORS), ("patterns", R.SINK_PATTERNS))
        for value in values]
    return spark.createDataFrame(rows, "kind string, value string")


def user_sinks(configs: DataFrame) -> DataFrame:
    """Rows (kind, value) of JSON config texts (column ``config``); unreadable texts give none."""
    c = configs.select(F.from_json("config", SINK_SCHEMA).alias("c"))
    named = c.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(f"c.{k}").alias("vals"))
        for k in ("middleware", "decorators", "patterns")])).alias("k"))
    rows = named.select("k.kind", F.explode("k.vals").alias("value"))
    stripped = F.when(F.col("kind") == "decorators", F.regexp_replace("value", "^@+", "")).otherwise(F.col("value"))
    return rows.select("kind", stripped.alias("value"))


def sink_table(spark: SparkSession, configs: DataFrame) -> DataFrame:
    """Defaults and user rows, without repeats."""
    return default_sinks(spark).unionByName(user_sinks(configs)).distinct()
