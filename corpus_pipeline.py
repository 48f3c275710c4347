"""The corpus pipeline: from raw documents to token ids in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's documents.  All but the last return the columns of ``documents``; further columns of the input
are passed by.  Each stage works on all that the one before has kept, whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditloom.functions.session import materialise, scratch_path
from auditloom.llm import langid, linededup, mixing, neardup, pieces, simhash
from auditloom.llm.chars import learned_from
from auditloom.llm.components import connected
from auditloom.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null texts, texts without letters, and texts in which no language
    has half of the letters.  Learned from the labelled documents of the input that may be learned from; if
    there are none, every document goes that has no language to be told by."""
    model = langid.train(docs.where(learned_from()))
    found = langid.identify(docs.select(F.struct(*COLUMNS).alias("row"), "text"), model, "row")
    return found.where("lang_pred <> 'und' AND score >= 0.5").select("id.*")


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later repeats of runs of lines of 50 words; documents left without a word go, n_chars follows.

    Null texts and texts that had no word before stay as they are.
    """
    found = linededup.delete_repeated(docs.select(*COLUMNS))
    gone = F.size("removed_runs") > 0
    return found.where(~gone | F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn(
        "n_chars", F.when(gone, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least (doc_id, hash of the text) of every group of near-duplicates, once if its
    row is repeated; of documents with one doc_id all stay that are no near-duplicates.

    Near-duplicates have SimHash fingerprints that differ in at most two bits, or sets of five-word shingles with a
    Jaccard index of 0.8 at least, or are chained by such documents; groups of any size with a common MinHash key
    are searched exactly.  Documents with a null doc_id have nothing to be chosen by; they stay.
    """
    rows = docs.select(*COLUMNS).withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("th")))
    named = rows.where("doc_id IS NOT NULL")
    prints = materialise(simhash.near_duplicates(named, "key").select("id", "component"), "pipeline-prints")
    alike = neardup.near_duplicates(named, "key").where("id <> component").select("id", "component")
    ends = materialise(prints.where("id <> component").unionByName(alike), "pipeline-alike")
    node = lambda c: F.xxhash64(f"{c}.doc_id", f"{c}.th")
    roots = connected(ends.select(node("id").alias("a"), node("component").alias("b")))
    members = ends.select(F.col("id").alias("key")).unionByName(ends.select(F.col("component").alias("key"))).distinct()
    rooted = materialise(members.withColumn("node", node("key")).join(roots, "node").select("key", "root"), "pipeline-roots")
    gone = rooted.join(rooted.groupBy("root").agg(F.min("key").alias("first")), "root").where("key <> first").select("key")
    # Few keys move if few go; repeated rows are the only texts that must meet.
    twice = prints.groupBy(F.col("id").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key")
    kept = rows.join(gone.unionByName(twice), "key", "left_anti")
    once = named.join(twice.join(gone, "key", "left_anti"), "key", "left_semi").dropDuplicates(["key"])
    return kept.unionByName(once).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that sources come as close to equal weights as two passes over one for each pass over
    another allow.  Every document is used; the largest source once, smaller ones up to twice."""
    rows = docs.select(*COLUMNS)
    return mixing.mixed_rows(rows, mixing.mix(rows, repeats=2.0))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, piece ids and their number; null texts have null ids and none of them."""
    ids = docs.select("doc_id", "source", pieces.encode(spark, F.col("text"), pieces.vocabulary()).alias("pieces"))
    return ids.withColumn("n_pieces", F.coalesce(F.size("pieces"), F.lit(0)).cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("line_dedup", new_lines),
    ("simhash_near_dedup", one_of_each),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

ORACLE_SQL = None  # language model, fingerprints and pieces have no SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
