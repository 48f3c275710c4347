"""Streaming forms of the audit: screen, re-audit state, rates, alerts.

Functions take a streaming DataFrame and return one; starting the query is left to the caller (or to
``run_to_table``).  Each also accepts a batch DataFrame where Spark allows it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from auditloom import rules as R
from auditloom.functions import text as T
from auditloom.functions.session import scratch_path
from auditloom.operators.screen import screen_findings
from auditloom.operators.snapshots import cosmetic_form

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State processors need the RocksDB provider: state lives off-heap, not in executor memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain a stream into a table in the shared folder and return the table."""
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    query = (stream.writeStream.format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_in_parts(parts: Sequence[DataFrame], shape: Callable[[DataFrame], DataFrame], name: str,
                 mode: str = "append") -> DataFrame:
    """Let ``parts`` (of one schema) arrive one after the other and return what the stream ``shape`` makes of them.

    Each part is appended to a folder in the shared one; then the query is started again from its checkpoint and
    takes what is new, so state and watermark are carried on from run to run.  ``shape`` gets the streaming
    DataFrame of the folder.
    """
    spark, base = parts[0].sparkSession, scratch_path(parts[0].sparkSession, name)
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        stream = shape(spark.readStream.schema(parts[0].schema).parquet(f"{base}/in"))
        query = (stream.writeStream.format("parquet").option("path", f"{base}/out")
                 .option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start())
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def continuous_screen(files: DataFrame, profile: R.Profile = R.LOCAL) -> DataFrame:
    """Findings of arriving files: gate and line rules, stateless."""
    return screen_findings(files, profile, "path")


def windowed_verdicts(ledger: DataFrame, length: str = "1 hour", slide: str | None = None,
                      lateness: str = "10 minutes") -> DataFrame:
    """Verdict counts per tumbling or sliding window; rows later than ``lateness`` are dropped."""
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (ledger.withWatermark("ts", lateness).groupBy(span.alias("w"), "action")
            .agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "action", "n"))


def suppress_repeats(sends: DataFrame, horizon: str = "1 hour") -> DataFrame:
    """Drop sends of the same path and content hash seen within the horizon."""
    return sends.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["path", "hash"])


def save_bursts(saves: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Sessions of saves per key, ended by a pause of ``gap``."""
    return (saves.withWatermark("ts", lateness).groupBy("key", F.session_window("ts", gap).alias("s"))
            .agg(F.count("*").alias("n_saves"))
            .select("key", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_saves"))


def override_alerts(log: DataFrame, threshold: int, length: str = "1 hour",
                    lateness: str = "10 minutes") -> DataFrame:
    """Windows in which a reason was forced more often than ``threshold``."""
    return (log.withWatermark("timestamp", lateness)
            .groupBy(F.window("timestamp", length).alias("w"), "override_reason")
            .agg(F.count("*").alias("n")).where(F.col("n") > threshold)
            .select(F.col("w.start").alias("window_start"), "override_reason", "n"))


# --- re-audit state --------------------------------------------------------------------------------------

class ReauditProcessor(StatefulProcessor):
    """Per path: hash and cosmetic form of the last version; emits the audit mode of each save.

    With ``keep_days`` every save sets a timer so many days ahead, in event time; the state of a path without a save
    until then is dropped, so state grows with the paths in use and not with all that ever were.
    """

    def __init__(self, first_limit: int = 200, full_limit: int = 150, keep_days: int | None = None):
        self.first_limit, self.full_limit, self.keep_days = first_limit, full_limit, keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "hash string, form string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = tuple(self.last.get()) if self.last.exists() else None
        # Only hashes and line counts come here; one trigger's saves of a path are put in time order.
        batch = pd.concat(list(rows)).sort_values("ts", kind="stable")
        out = []
        for ts, digest, form, n in zip(batch["ts"], batch["hash"], batch["form"], batch["n_lines"]):
            if seen is not None and (digest == seen[0] or form == seen[1]):
                mode = "skip"
            elif seen is None:
                mode = "index_only" if n > self.first_limit else "full"
            else:
                mode = "full" if n <= self.full_limit else "diff"
            seen = (digest, form)
            out.append((key[0], ts, n, mode))
        self.last.update(seen)
        if self.keep_days is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            last = int(pd.Timestamp(batch["ts"].iloc[-1]).timestamp() * 1000)
            self.handle.registerTimer(last + self.keep_days * 86_400_000)
        yield pd.DataFrame(out, columns=["path", "ts", "n_lines", "mode"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"path": pd.Series(dtype="str"), "ts": pd.Series(dtype="datetime64[ns]"),
                            "n_lines": pd.Series(dtype="int32"), "mode": pd.Series(dtype="str")})

    def close(self) -> None:
        pass


def reaudit(saves: DataFrame, first_limit: int = 200, full_limit: int = 150, keep_days: int | None = None,
            lateness: str = "1 hour") -> DataFrame:
    """Audit mode of each save from keyed state: ``saves(path, ts, content)``.

    Hashes are taken before the shuffle, so contents never reach the Python state processor.  With ``keep_days`` the
    state of a path that is not saved for so long is dropped, and saves later than ``lateness`` are, too.
    """
    use_rocksdb(saves.sparkSession)
    content = F.col("content")
    slim = saves.select("path", "ts", F.md5(content).alias("hash"),
                        F.md5(cosmetic_form(content)).alias("form"),
                        F.size(T.split_lines(content)).alias("n_lines"))
    if keep_days is not None:
        slim = slim.withWatermark("ts", lateness)
    return slim.groupBy("path").transformWithStateInPandas(
        ReauditProcessor(first_limit, full_limit, keep_days),
        outputStructType="path string, ts timestamp, n_lines int, mode string",
        outputMode="append", timeMode="none" if keep_days is None else "EventTime")
