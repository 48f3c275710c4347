"""Resampling, periodic runs and licence scans against plain programs."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from auditloom.llm import licences, queries_text, repetition, resample

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_features(text):
    words = plain_words(text)
    return [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_grams_of_blocks(monkeypatch, block):
    monkeypatch.setattr(resample, "BLOCK", block)
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choices("abZé9 -\n\u0085日", k=rng.randrange(80)))
        found = list(resample.grams(text.encode()))
        assert sum(n for n, _ in found) == len(plain_words(text))
        assert sorted(c for _, own in found for c in own) == sorted(crc32(f.encode()) for f in plain_features(text))


def test_op11_against_plain_program(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    s = Counter(crc32(f.encode()) % 10000 for t in docs.values() for f in plain_features(t))
    t = Counter(crc32(f.encode()) % 10000 for x in target for f in plain_features(x))
    of_s, of_t = sum(s.values()) + 10000.0, sum(t.values()) + 10000.0
    want = {}
    for i, text in docs.items():
        found = plain_features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * of_s / ((s[b] + 1) * of_t)))
                     for b in (crc32(f.encode()) % 10000 for f in found))
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        want[i] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None]
    able = sorted((i for i, x in docs.items() if len(plain_words(x)) >= 20), key=lambda i: (-want[i][2], i))
    for k, i in enumerate(able[:5 * len(able) // 100]):
        want[i][3] = k + 1
    got = {r.doc_id: [r.n_features, r.weight, r.score, r.rank] for r in queries_text.op11_resampling(spark, SMALL).collect()}
    assert got == want and any(w[3] for w in want.values())


def test_ranks_of_ties_over_many_ranges(spark):
    rows = spark.range(3000).select(F.col("id").alias("row"), (F.col("id") % 7).alias("id"),
                                    F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 11).alias("score"))
    plain = sorted(rows.collect(), key=lambda r: (-r.score, r.id, r.row))
    for most in (1, 900, 3000, 5000):
        got = {r["row"]: r["rank"] for r in resample.ranked(rows, most).collect()}
        assert got == {r["row"]: k + 1 for k, r in enumerate(plain[:most])}


def plain_runs(w, least_words, least_periods):
    n, out = len(w), {}
    for q in range(1, n // least_periods + 1):
        same = [i + q < n and w[i] == w[i + q] for i in range(n)]
        i = 0
        while i < n:
            k = i
            while k < n and same[k]:
                k += 1
            if k > i and k - i + q >= max(least_words, least_periods * q):
                out.setdefault((i, k - i + q), q)
            i = k + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_against_all_periods():
    rng = random.Random(1)
    seen = 0
    for _ in range(3000):
        words = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(50))]
        if rng.random() < 0.6:
            period = [rng.randrange(4) for _ in range(rng.randint(1, 7))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = period * rng.randint(2, 7) + period[:rng.randrange(len(period))]
        least_words, least_periods = rng.choice([(6, 4), (6, 4), (4, 2), (8, 3), (3, 2)])
        got = repetition.word_runs([b"%d" % x for x in words], least_words, least_periods)
        assert got == plain_runs(words, least_words, least_periods)
        seen += len(got)
    assert seen > 1000


def test_runs_of_a_long_text():
    rng = random.Random(2)
    period = [b"%d" % rng.randrange(900) for _ in range(5000)]
    head = [b"h%d" % i for i in range(1000)]
    words = head + period * 20 + period[:17] + [b"z"] * 50_000
    assert repetition.word_runs(words) == [(1000, 100_017, 5000), (101_017, 50_000, 1)]
    assert repetition.collapsed(words, repetition.word_runs(words)) == b" ".join(head + period + [b"z"])


def test_op12_plants_runs_and_finds_them(spark):
    rows = queries_text.op12_periodic_runs(spark, MIDDLE).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    longest = 0
    for r in rows:
        words, h = (docs[r.doc_id] or "").split(), crc32(str(r.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n < 600:
            found = plain_runs(words, 6, 4)
            assert r.n_runs == len(found)
            assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        longest = max(longest, r.period or 0)
    assert len(rows) == len(docs) and longest > 100


NOTICE = next(t for label, t in licences.TEMPLATES if label == "apache-2.0" and len(t) > 200)


def scanned(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return licences.scan(rows).orderBy("id").collect()


def test_licences_of_changed_texts(spark):
    rng = random.Random(4)
    prose = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(9000))
    words = NOTICE.split()
    edited = words[:20] + ["new", "words"] + words[20:45] + words[46:]
    mit = next(t for label, t in licences.TEMPLATES if label == "mit" and len(t) > 200)
    gpl = next(t for label, t in licences.TEMPLATES if label == "gpl-3.0" and len(t) > 200)
    got = scanned(spark, f"{prose} {' '.join(edited)} {prose}", " ".join(words[:25]), f"{prose}\n{mit}\n{gpl} {mit}",
                  "Licensed under CC BY-NC 4.0.", prose, "# " + gpl.replace(" ", "\n# "))
    assert [r.labels for r in got] == [["apache", "apache-2.0"], ["apache", "apache-2.0"], ["gpl", "gpl-3.0", "mit"],
                                       ["cc-by", "cc-by-nc-4.0"], [], ["gpl", "gpl-3.0"]]
    span = got[0].spans[0]
    assert (span.first, span.last) == (9000, 9000 + len(licences.words_of(" ".join(edited))) - 1)
    assert 0.8 < span.share < 1 and got[4].score == 0
    assert [(s.label, s.first) for s in got[2].spans] == [
        ("mit", 9000), ("gpl-3.0", 9000 + len(licences.words_of(mit))), ("mit", 9000 + len(licences.words_of(mit + gpl)))]
    # A part of a long text counts by its share, below the bar without a label.
    part = scanned(spark, " ".join(mit.split()[:40]))[0]
    assert part.labels == [] and 0.2 < part.score < 0.3


def test_grams_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(licences, "CHUNK", 5)
    text = "x y " + NOTICE + " z " + NOTICE
    voted = licences.hits(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    n = len(licences.words_of(NOTICE))
    longest = next(k for k, (_, t) in enumerate(licences.TEMPLATES) if t == NOTICE)
    assert {r.diagonal for r in voted if r.template == longest and len(r.ats) == n - 3} == {2, 3 + n}


def test_words_of_texts_are_cut_once(spark, monkeypatch):
    """Texts are read by one scan; the words are those of the pattern, and only texts with a phrase or a gram keep them."""
    texts = ["", None, "MIT LicensÉ Key_value,x y 1\x00b", "All under the mit/License!", "nothing to see here",
             "x Permission is hereby, GRANTED y", "granted permission hereby is"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = licences.cut_texts(docs).orderBy("id").collect()
    assert [r.n_words for r in cut] == [len(licences.words_of(t or "")) for t in texts]
    assert [r.words for r in cut] == [licences.words_of(t) if k in (3, 5) else None for k, t in enumerate(texts)]
    plans, real = [], licences.materialise
    monkeypatch.setattr(licences, "materialise", lambda df, purpose: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or real(df, purpose))
    found = licences.scan(docs).orderBy("id")
    read = [p.count("text#") > 0 for p in (*plans, found._jdf.queryExecution().executedPlan().toString())]
    assert read == [True, False, False]
    assert [(r.n_base, r.labels, r.score > 0) for r in found.collect()] == [
        (0, [], False)] * 3 + [(1, ["mit"], True), (0, [], False), (0, [], True), (0, [], False)]
