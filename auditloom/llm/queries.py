"""Registered queries of the dealt operators: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditloom.functions.session import materialise
from auditloom.llm import (
    classifier, langid, linededup, mixing, perplexity, pieces, queries_text, secretscan, simhash, topk, warc)
from auditloom.llm.chars import held_out, learned_from
from auditloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op2_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = pieces.vocabulary()
    coded = materialise(table(spark, sf, "documents").select(
        "doc_id", pieces.encode(spark, F.col("text"), vocabulary).alias("pieces")), "pieces")
    text = pieces.decode(spark, F.col("pieces"), vocabulary)
    return coded.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces",
                        F.sha2(text.cast("binary"), 256).alias("decoded_sha256"))


def op3_secrets(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = secretscan.scan(docs, secretscan.learned(docs))
    base = F.filter("found", lambda s: s["kind"] < 3)
    counts = [F.expr(f"size(filter(found, s -> s.kind = {k}))").cast("long").alias(f"n_{name}")
              for k, name in enumerate(secretscan.KINDS)]
    return found.select(F.col("id").alias("doc_id"), *counts[:3],
                        F.sha2(secretscan.listed(base).cast("binary"), 256).alias("base_sha256"),
                        secretscan.listed(F.col("found")).alias("spans"), counts[3])


def op4_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = langid.identify(docs, langid.train(docs.where(learned_from())))
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score", "spans")


def op5_top_k(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


TOP_K_SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS double)) AS bigint)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS bigint)
    AS score
  FROM fine q JOIN fine c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS integer) AS rank,
         vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5"""


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    plan = mixing.mix(table(spark, sf, "documents"), entropy=2.9)
    return plan.select(F.col("id").alias("doc_id"), "source", "tokens", "block", "slot")


def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = classifier.train(docs, table(spark, sf, "labels").where(learned_from()), "quality")
    return classifier.score(docs, model).select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op8_rules(spark: SparkSession, sf: str) -> DataFrame:
    found = perplexity.judged(table(spark, sf, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "n_repeat_words", "base_failed", "kept", "log_ppl", "low", "high", "upper_ppl", "upper_low",
                        "upper_high")


def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = linededup.delete_repeated(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.size("removed_runs").cast("long").alias("n_runs"),
                        F.expr("aggregate(removed_runs, 0L, (n, r) -> n + r.last - r.first + 1)").alias("n_lines"))


LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
counted AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines),
placed AS (
  SELECT doc_id, line, pos, n, row_number() OVER d AS k, sum(n) OVER d - n AS words
  FROM counted WHERE n > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
framed AS (
  SELECT doc_id, pos, k, max(pos) OVER r AS last, count(*) OVER r AS size, sum(n) OVER r AS total,
         list(line) OVER r AS content, list(pos) OVER r AS places
  FROM placed WINDOW r AS (PARTITION BY doc_id ORDER BY words RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
following AS (
  SELECT *, coalesce(lead(content) OVER d, [])[size:] AS after, coalesce(lead(places) OVER d, [])[size:] AS ends
  FROM framed WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
stretched AS (
  SELECT doc_id, pos, k, last, size, content FROM following WHERE total >= 50 UNION ALL
  SELECT doc_id, pos, k, ends[e], size + e, list_concat(content, after[1:e])
  FROM (SELECT *, unnest(range(1, len(after) + 1)) AS e FROM following WHERE total >= 50)),
headed AS (
  SELECT *, first_value(doc_id) OVER c AS head, first_value(k) OVER c AS head_k
  FROM stretched WINDOW c AS (PARTITION BY content ORDER BY doc_id, k)),
gone AS (
  SELECT DISTINCT l.doc_id, l.pos FROM lines l JOIN headed h
  ON l.doc_id = h.doc_id AND l.pos BETWEEN h.pos AND h.last
  WHERE h.doc_id <> h.head OR h.k >= h.head_k + h.size),
runs AS (
  SELECT doc_id, count(*) AS n_runs, CAST(sum(n) AS bigint) AS n_lines FROM (
    SELECT doc_id, pos - k AS run, count(*) AS n FROM (
      SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM gone) GROUP BY ALL)
  GROUP BY doc_id),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
  FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(r.n_runs, 0) AS n_runs, coalesce(r.n_lines, 0) AS n_lines
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN runs r ON d.doc_id = r.doc_id"""

def op10_warc(spark: SparkSession, sf: str) -> DataFrame:
    found = warc.archived(table(spark, sf, "pages"))
    first = F.nullif(F.col("refers_to"), F.lit("")).cast("long")
    return found.select(F.nullif(F.col("page"), F.lit("")).cast("long").alias("page_id"), "payload_bytes",
                        "payload_digest", "record_type", first.alias("refers_to"), "url_key")


WARC_SQL = r"""
WITH paid AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS d
  FROM pages),
firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS f FROM paid)
SELECT page_id, payload_bytes, d AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> f THEN f END AS refers_to,
       array_to_string(list_reverse(string_split(regexp_extract(url, '^https?://(www\.)?([^/?#]*)', 2), '.')), ',')
         || ')' || CASE WHEN path = '' THEN '/' ELSE path END || regexp_extract(url, '^[^?#]*(\?[^#]+)', 1) AS url_key
FROM (SELECT *, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM firsts)"""

QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash, "op2_sentencepiece": op2_sentencepiece, "op3_secrets": op3_secrets,
    "op4_language": op4_language,
    "op5_top_k": op5_top_k, "op6_mixing": op6_mixing, "op7_quality": op7_quality,
    "op8_rules": op8_rules, "op9_line_dedup": op9_line_dedup, "op10_warc": op10_warc} | queries_text.QUERIES
ORACLE: dict[str, str] = {
    "op5_top_k": TOP_K_SQL, "op9_line_dedup": LINE_DEDUP_SQL, "op10_warc": WARC_SQL} | queries_text.ORACLE
