"""Source files in folders, as a table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditloom import rules as R
from auditloom.functions import text as T

# Extensions a folder scan reads.
SCAN_EXTENSIONS = (".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".rs", ".cpp", ".c", ".cs")


def scan(spark: SparkSession, root: str, extensions: Iterable[str] = SCAN_EXTENSIONS,
         skip_dirs: Iterable[str] = R.SKIP_DIRS_SCAN, max_kb: int = 500) -> DataFrame:
    """Files below ``root``: path (relative), ext, code, n_bytes, skip_reason.

    Size is known before the content, so oversized files are never decoded.  Bad UTF-8 bytes are
    dropped, and so is a replacement character of the text itself.
    """
    glob = "*{" + ",".join(extensions) + "}"
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
           .option("pathGlobFilter", glob).load(root))
    rel = F.regexp_replace("path", "^.*?" + _quoted(root.rstrip("/").split(":")[-1]) + "/", "")
    kb = F.col("length") / 1024
    big = kb > max_kb
    decoded = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    rows = raw.select(rel.alias("path"), F.when(~big, decoded).alias("code"),
                      F.col("length").alias("n_bytes"),
                      F.when(big, F.concat(F.lit("File too large ("), T.one_decimal(kb), F.lit("KB)")))
                      .alias("skip_reason"))
    return rows.where(~T.has_part(F.col("path"), skip_dirs)).select(
        "path", T.extension(F.col("path")).alias("ext"), "code", "n_bytes", "skip_reason")


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "_/" else c for c in text)


def stream(spark: SparkSession, root: str, extensions: Iterable[str] = SCAN_EXTENSIONS,
           files_per_batch: int = 10_000) -> DataFrame:
    """Arriving files as a stream: path, ext, code, ts."""
    glob = "*{" + ",".join(extensions) + "}"
    raw = (spark.readStream.format("binaryFile").option("recursiveFileLookup", "true")
           .option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch)
           .schema("path string, modificationTime timestamp, length long, content binary").load(root))
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    return raw.select("path", T.extension(F.col("path")).alias("ext"), text.alias("code"),
                      F.col("modificationTime").alias("ts"))
