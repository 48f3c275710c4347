"""Session helpers: shared scratch folder, scan parallelism, size-checked small tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


DEALT = 4 << 20  # bytes of a table that ``per_split`` tasks share


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir``.  Only a local session may fall back to a folder of its own.
    """
    conf = spark.sparkContext.getConf()
    configured = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if configured:
        return configured
    if not (conf.get("spark.master") or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, *keys: str, per_split: int = 1) -> DataFrame:
    """Hash-repartition a scan by ``keys`` only if it has fewer splits than the session has cores.

    A large table already comes in many splits and is returned as it is, so no shuffle of the texts
    happens at scale.  Call it on a scan (no shuffle below), where counting splits runs no job.

    Of narrow rows that long texts are made from, a split is hours of work, and files of few row groups leave most
    splits empty.  With ``per_split`` above 1 such a scan is dealt over that many tasks for every ``DEALT`` bytes, however
    large its own splits are, so that a task's work does not grow with the table.
    """
    splits = scan.rdd.getNumPartitions()
    dealt = splits if per_split == 1 else _splits_of(scan, DEALT) * per_split
    wanted = max(scan.sparkSession.sparkContext.defaultParallelism, dealt)
    return scan if splits >= wanted else scan.repartition(wanted, *keys)


def _splits_of(scan: DataFrame, size: int) -> int:
    """Splits of a scan if none may be above ``size`` bytes."""
    conf, name = scan.sparkSession.conf, "spark.sql.files.maxPartitionBytes"
    before = conf.get(name)
    conf.set(name, str(size))
    try:
        return scan.select("*").rdd.getNumPartitions()  # planned anew
    finally:
        conf.set(name, before)


def small_rows(df: DataFrame, max_rows: int = 10_000) -> list:
    """Rows of a configuration table (sinks, rules); refuses a table above ``max_rows``."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"configuration table has more than {max_rows} rows")
    return rows
