"""Registered queries of resampling, repetition and licence scans: thin, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditloom.llm import licences, repetition, resample
from auditloom.llm.chars import WORD
from auditloom.sources.tables import table


def op11_resampling(spark: SparkSession, sf: str) -> DataFrame:
    found = resample.resampled(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


# A CRC-32 in SQL: the table of 256 remainders, then a fold over the bytes.
CRC_TABLE = """
crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(
    list_prepend(CAST(n AS bigint), [CAST(0 AS bigint), 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"""


def _crc(octets: str) -> str:
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS bigint), {octets}), "
            "lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)")


def _features(name: str, table_: str, key: str) -> str:
    return f"""
{name}_words AS (
  SELECT {key} AS k, regexp_extract_all(translate(coalesce(text, ''), '{licences.UPPER}', '{licences.LOWER}'),
                                        '{licences.WORDS}') AS w FROM {table_}),
{name} AS (
  SELECT k, unnest(w) AS f FROM {name}_words UNION ALL
  SELECT k, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM {name}_words UNION ALL
  SELECT k, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
  FROM {name}_words)"""


_OCTETS = ("list_transform(range(0, octet_length(encode(f))), "
           "lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS bigint))")
RESAMPLING_SQL = rf"""
WITH {CRC_TABLE.strip()}, {_features("raw", "documents", "doc_id").strip()},
{_features("aim", "benchmark", "item_id").strip()},
hashed AS (
  SELECT f, {_crc(_OCTETS)} % 10000 AS b
  FROM (SELECT f FROM raw UNION SELECT f FROM aim), crc_table),
s AS (SELECT b, count(*) AS n FROM raw JOIN hashed USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM aim JOIN hashed USING (f) GROUP BY b),
totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) + 10000.0::double AS of_s,
                  (SELECT coalesce(sum(n), 0) FROM t) + 10000.0::double AS of_t),
gains AS (
  SELECT r.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * of_s / ((coalesce(s.n, 0) + 1)::double * of_t)))
              ::bigint AS gain
  FROM (SELECT unnest(range(10000)) AS b) r CROSS JOIN totals
  LEFT JOIN s ON r.b = s.b LEFT JOIN t ON r.b = t.b),
weights AS (
  SELECT k, count(*) AS n_features, sum(gain)::bigint AS weight FROM raw JOIN hashed USING (f) JOIN gains USING (b)
  GROUP BY k),
scored AS (
  SELECT k AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || k), 1, 8))::bigint + 0.5::double)
                                                    / 4294967296.0::double)))::bigint AS score
  FROM raw_words LEFT JOIN weights USING (k)),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_words >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, p.rank
FROM scored s LEFT JOIN placed p ON s.doc_id = p.doc_id AND p.rank <= 5 * p.n // 100"""


def repeating(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in every tenth document by crc32 of its id, words repeat from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("g"))
    words = chosen.select("doc_id", "text", "g", F.when(
        F.col("g").isNotNull(), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    placed = words.withColumn("a", F.expr("if(size(w) > 0, CAST(g % size(w) AS int), NULL)")).withColumn(
        "p", F.expr("CAST(1 + (size(w) - a) DIV (3 + g % 8) AS int)"))
    # Words from a on are those of one period, over and over.
    tail = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), CAST((size(w) - a) DIV p + 1 AS int))), 1, size(w) - a)")
    new = F.array_join(F.concat(F.expr("slice(w, 1, a)"), tail), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), new).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = repetition.word_periods(repeating(table(spark, sf, "documents")))
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, chr(10))), '')")
    # Exact order of length / period by cross products; the runs come by start, then period.
    best = F.expr("reduce(runs, CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>), (b, r) -> "
                  "if(b IS NULL OR r.length * b.period > b.length * r.period, r, b))")
    return found.withColumn("best", best).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length",
        "best.period", F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


_DIGITS = "list_transform(string_split(CAST(doc_id AS varchar), ''), lambda d: CAST(ord(d) AS bigint))"
PERIODIC_RUNS_SQL = rf"""
WITH {CRC_TABLE.strip()},
split AS (
  SELECT doc_id, {_crc(_DIGITS)} AS h, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
  FROM documents, crc_table),
chosen AS (
  SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g
  FROM split),
words AS (
  SELECT doc_id, unnest(range(n)) AS i, unnest(CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i:
           w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END) AS word, n
  FROM chosen),
equal AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q
  FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
grouped AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM equal),
stretched AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM grouped GROUP BY doc_id, q, part),
runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretched WHERE length >= 6 AND length >= 4 * q GROUP BY ALL),
summed AS (
  SELECT doc_id, count(*) AS n_runs,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
  FROM runs GROUP BY doc_id),
best AS (
  SELECT x.doc_id, x.start, x.length, x.period FROM runs x
  QUALIFY row_number() OVER (PARTITION BY doc_id
                             ORDER BY CAST(x.length AS double) / x.period DESC, x.start, x.period) = 1),
dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i)
  GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period,
       1000 * b.length // b.period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
       sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM split d LEFT JOIN summed s ON d.doc_id = s.doc_id LEFT JOIN best b ON d.doc_id = b.doc_id
LEFT JOIN kept k ON d.doc_id = k.doc_id"""


def op13_licences(spark: SparkSession, sf: str) -> DataFrame:
    found = licences.scan(table(spark, sf, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
                        F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


LICENCES_SQL = rf"""
WITH phrases(phrase, label) AS (VALUES {_rows(list(licences.PHRASES.items()))}),
templates(template, label, t) AS (VALUES {_rows([(k, n, " ".join(w)) for k, n, w in licences.template_words()])}),
split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licences.UPPER}', '{licences.LOWER}'),
                                    '{licences.WORDS}') AS w FROM documents),
placed AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM split),
base AS (
  SELECT p.doc_id, p.i, r.label FROM placed p JOIN phrases r ON p.word = split_part(r.phrase, ' ', 1)
  JOIN split s ON s.doc_id = p.doc_id
  AND array_to_string(s.w[p.i + 1:p.i + len(string_split(r.phrase, ' '))], ' ') = r.phrase),
based AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM base GROUP BY doc_id),
grams AS (
  SELECT doc_id, i AS place, word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d || ' '
         || lead(word, 3) OVER d AS gram FROM placed WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
wanted AS (
  SELECT template, unnest(range(len(w) - 3)) AS place,
         unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS gram
  FROM (SELECT template, string_split(t, ' ') AS w FROM templates)),
hits AS (
  SELECT g.doc_id, w.template, g.place, w.place AS "at", g.place - w.place AS diagonal
  FROM grams g JOIN wanted w ON g.gram = w.gram),
voted AS (
  SELECT doc_id, template, diagonal, min(place) AS first, max(place) AS last FROM hits GROUP BY ALL),
sized AS (
  SELECT v.*, CASE WHEN diagonal - lag(diagonal) OVER d <= least({licences.SLACK}, len(string_split(t.t, ' ')) // 4)
                   THEN 0 ELSE 1 END AS far
  FROM voted v JOIN templates t USING (template) WINDOW d AS (PARTITION BY doc_id, template ORDER BY diagonal)),
grouped AS (
  SELECT *, sum(far) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS near FROM sized),
reached AS (
  SELECT *, max(last) OVER (PARTITION BY doc_id, template, near ORDER BY first, diagonal
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM grouped),
banded AS (
  SELECT *, sum(CASE WHEN first - reached - {licences.GRAM} <= {licences.GAP} THEN 0 ELSE 1 END)
            OVER (PARTITION BY doc_id, template, near ORDER BY first, diagonal) AS band
  FROM reached),
bands AS (
  SELECT doc_id, template, min(place) AS first, max(place) + 3 AS last, count(DISTINCT "at" + k) AS covered
  FROM banded JOIN hits USING (doc_id, template, diagonal), (SELECT unnest(range({licences.GRAM})) AS k)
  GROUP BY doc_id, template, near, band),
judged AS (
  SELECT b.*, t.label, len(string_split(t.t, ' ')) AS n, covered::double / n AS share,
         CASE WHEN n < {licences.SHORT} THEN covered = n ELSE covered::double / n >= {licences.LONG_SHARE} END
         AND covered >= {licences.DENSITY}::double * (last - first + 1) AS accepted
  FROM bands b JOIN templates t USING (template)),
outer_ AS (
  SELECT *, max(last) OVER (PARTITION BY doc_id ORDER BY first, last DESC, covered DESC, share DESC, label, template
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
  FROM judged WHERE accepted),
labelled AS (
  SELECT doc_id, label, true AS is_base FROM base UNION ALL
  SELECT doc_id, label, false FROM outer_ WHERE reached IS NULL OR last > reached),
named AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels
  FROM labelled GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM judged GROUP BY doc_id)
SELECT s.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::double ELSE coalesce(share, 0.0::double) END AS score
FROM split s LEFT JOIN based b ON s.doc_id = b.doc_id LEFT JOIN named m ON s.doc_id = m.doc_id
LEFT JOIN best h ON s.doc_id = h.doc_id"""

QUERIES = {"op11_resampling": op11_resampling, "op12_periodic_runs": op12_periodic_runs,
           "op13_licences": op13_licences}
ORACLE = {"op11_resampling": RESAMPLING_SQL, "op12_periodic_runs": PERIODIC_RUNS_SQL, "op13_licences": LICENCES_SQL}
