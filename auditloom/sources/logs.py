"""Override log (JSON lines), audit ledger (markdown) and findings table: readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

OVERRIDE_SCHEMA = ("timestamp timestamp, override_reason string, raw_model_response string, "
                   "triggered_verdict string")
_HEADER = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \| Result: (\w+)"


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OVERRIDE_SCHEMA).json(path)


def stream_overrides(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(OVERRIDE_SCHEMA).json(path)


def append_overrides(log: DataFrame, path: str) -> None:
    log.write.mode("append").json(path)


def ledger_entries(texts: DataFrame) -> DataFrame:
    """Ledger blocks as rows: ``texts(ledger, content)`` -> ledger, seq, ts, result, reasoning.

    A block starts at a ``## <time> | Result: <verdict>`` line; its reasoning is what follows ``> ``.
    """
    blocks = F.slice(F.split("content", r"(?m)^## (?=\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} \| Result: )", -1),
                     2, 2_000_000_000)
    rows = texts.select("ledger", F.posexplode(blocks).alias("seq", "block"))
    said = F.regexp_extract("block", r"(?s)\n> (.*)$", 1)
    return rows.select("ledger", (F.col("seq") + 1).alias("seq"),
                       F.to_timestamp(F.regexp_extract("block", _HEADER, 1)).alias("ts"),
                       F.regexp_extract("block", _HEADER, 2).alias("result"),
                       F.regexp_replace(said, r"\s+$", "").alias("reasoning"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("ledger"), F.col("value").alias("content"))
    return ledger_entries(texts)


def ledger_text(verdicts: DataFrame) -> DataFrame:
    """Verdict rows (ts, result, reasoning) rendered as ledger blocks, one per row."""
    return verdicts.select(F.concat(
        F.lit("\n## "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" | Result: "), F.col("result"),
        F.lit("\n**Thought Process:**\n> "), F.trim("reasoning"), F.lit("\n")).alias("value"))


def append_findings(findings: DataFrame, path: str, *partition_by: str) -> None:
    findings.write.mode("append").partitionBy(*partition_by).parquet(path)


def stream_findings(findings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of findings to a table, exactly once, until the input is used up."""
    return (findings.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
