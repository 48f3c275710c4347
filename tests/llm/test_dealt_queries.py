"""The dealt queries over the given tables, against brute force, SQL, round trips and held-out labels."""

import hashlib
import heapq
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from check_oracle import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from auditloom.llm import langid, mixing, perplexity, pieces, queries, simhash, warc

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, folder):
    return {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_twins(spark, name):
    n, ok, note = compare(spark, connect(SMALL), SMALL, name, queries.QUERIES[name], queries.ORACLE[name])
    assert ok and n, note


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 14))


def plain_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op1_against_all_pairs(spark):
    docs = documents(spark, MIDDLE)
    rows = queries.op1_simhash(spark, MIDDLE).collect()
    fp = {i: plain_fingerprint(d.text) for i, d in docs.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{f:016x}" for i, f in fp.items()}
    least = {i: i for i in fp}
    ids = sorted(fp)
    bits = np.array([fp[i] for i in ids], np.uint64)
    near = [(i, ids[j]) for k, i in enumerate(ids) for j in np.flatnonzero(np.bitwise_count(bits ^ bits[k]) <= 2)]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(least[a], least[b])
            if (least[a], least[b]) != (low, low):
                least[a] = least[b] = low
                changed = True
    assert {r.doc_id: r.component_id for r in rows} == least
    assert len(set(least.values())) < len(least)


def test_golay_keys_meet_for_all_close_words():
    rng = random.Random(3)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.randrange(3)):
            b ^= 1 << k
        row, key = simhash.golay_keys(np.array([a, b], np.uint64).view(np.int64))
        assert set(key[row == 0]) & set(key[row == 1])
    words = np.arange(1 << 12, dtype=np.int32) << 11
    assert len(set(simhash.codeword_index(words).tolist())) > 1
    centres = simhash.codeword_index(np.array([1 << k for k in range(23)], np.int32))
    assert set(centres.tolist()) == {0}  # one error is mended to the zero codeword


def test_links_of_a_chain(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64)]
    for _ in range(60):
        fps.append(fps[-1] ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    fps += [rng.getrandbits(64) for _ in range(200)]
    signed = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def classes(pairs):
        for f in signed:
            root[f] = f
        for a, b in pairs:
            root[find(a)] = find(b)
        out = {}
        for f in signed:
            out.setdefault(find(f), set()).add(f)
        return {frozenset(s) for s in out.values()}

    near = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in got)
    assert classes([(r.a, r.b) for r in got]) == classes(near)


def plain_segmentation(v, text):
    """Best pieces by a plain table over positions; a longer last piece wins a tie."""
    ids = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k in (pieces.NORMAL, pieces.USER)}
    worst = min(v.scores[i] for i in ids.values()) - pieces.FALLBACK
    s = "▁" + text.replace("▁", "\uf8ff").replace(" ", "▁")
    best, back = [0.0] + [-math.inf] * len(s), [None] * (len(s) + 1)
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - 16), end):
            i = ids.get(s[start:end])
            if i is not None and best[start] + v.scores[i] > best[end]:
                best[end], back[end] = best[start] + v.scores[i], (start, i)
        if s[end - 1] not in ids and best[end - 1] + worst > best[end]:
            best[end], back[end] = best[end - 1] + worst, (end - 1, None)
    out, end = [], len(s)
    while end:
        start, i = back[end]
        out[:0] = [i] if i is not None else [
            v.pieces.index(f"<0x{b:02X}>") for b in s[start].replace("\uf8ff", "▁").encode()]
        end = start
    return out


def test_op2_against_a_plain_table(spark):
    v, docs = pieces.vocabulary(), documents(spark, SMALL)
    rows = queries.op2_sentencepiece(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id].text
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.n_pieces == len(r.pieces)
        if r.doc_id % 10 == 0:
            assert r.pieces == plain_segmentation(v, text)


def test_pieces_of_odd_texts():
    v = pieces.vocabulary()
    automaton, texts = pieces.Automaton(v), pieces.Texts(v)
    given = ["", " ", "  a  b ", "a\n\nb\n", "日本語 テスト", "▁x▁ ▁", "\t\x00\U0001F600", "é" * 9, "zz" * 700]
    batch = pa.array([t.encode() for t in given], pa.binary())
    coded = [x.to_pylist() for x in pieces.encode_batch(automaton, batch)][0]
    assert coded == [plain_segmentation(v, t) if t else [] for t in given]
    back = list(pieces.decode_batch(texts, next(pieces.encode_batch(automaton, batch))))
    assert back[0].to_pylist() == given


def any_case(word):
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


KEYS = "|".join(map(any_case, ("password", "passwd", "secret", "token"))) + "|" + any_case("api") + "_?" + any_case("key")
PATTERNS = {
    "assign": (re.compile(rf"""({KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16), "hex": (re.compile("[0-9a-f]+"), 0, 32)}


def plain_spans(text):
    found = [(m.start(), k, m.end()) for k, (p, g, least) in enumerate(PATTERNS.values())
             for m in p.finditer(text or "") if len(m[g]) >= least]
    return ",".join(f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_op3_against_plain_patterns(spark):
    docs = documents(spark, MIDDLE)
    rows = queries.op3_secrets(spark, MIDDLE).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = plain_spans(docs[r.doc_id].text)
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        own = Counter(s.split(":")[0] for s in r.spans.split(",") if s)
        assert (r.n_assign, r.n_access, r.n_hex) == (own["assign"], own["access"], own["hex"])
        assert ",".join(s for s in r.spans.split(",") if not s.startswith("markov")) == spans
    assert sum(r.n_assign for r in rows)


def test_op3_markov_tells_random_from_ordinary(spark):
    from auditloom.llm import secretscan
    table = secretscan.learned(spark.read.parquet(f"{MIDDLE}/documents.parquet"))
    rng = random.Random(1)
    secret = ["".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=32))
              for _ in range(50)]
    plain = ["thetransformationofinternational", "verarbeitungsmoeglichkeiten", "12345678901234567890123456"]
    rows = spark.createDataFrame([(i, f"see {s} there") for i, s in enumerate(secret + plain)],
                                 "doc_id long, text string")
    found = {r.id: r.found for r in secretscan.scan(rows, table).collect()}
    assert all([tuple(s) for s in found[i]] == [(4, 3, 36)] for i in range(50))
    assert not any(found[50 + i] for i in range(3))


def test_op4_held_out(spark):
    docs = documents(spark, MIDDLE)
    rows = [r for r in queries.op4_language(spark, MIDDLE).collect() if r.held_out]
    assert len(rows) > 200 and sum(r.lang_pred == docs[r.doc_id].lang for r in rows) >= 0.98 * len(rows)


def test_op4_spans_of_mixed_text(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    model = langid.train(docs)
    parts = ["the thing and the other thing is onthe that there ", "die und der einung ist nicht mit einer heit ",
             "la les des est pour avec une ementelle "]
    text = "".join(parts)
    r = langid.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [s.lang for s in r.spans] == ["en", "de", "fr"]
    assert all(text[s.start:s.end] == p.strip() for s, p in zip(r.spans, parts))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    sizes = np.array([3, 0, 5, 1])
    score = rng.normal(size=(9, 3)).astype(np.float32) * 2
    got = langid.viterbi(score, sizes, 1.5)
    at = 0
    for n in sizes:
        own = score[at:at + n]
        value = lambda p: sum(own[i, s] for i, s in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731,B023
        if n:
            best = max(itertools.product(range(3), repeat=int(n)), key=value)
            assert abs(value(best) - value(tuple(got[at:at + n]))) < 1e-4
        at += n


def plain_exponent(tokens, measure, target):
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if measure(tokens, mid) > target else (lo, mid)
    return hi


def test_op6_weights_and_blocks(spark):
    docs = documents(spark, MIDDLE)
    tokens = Counter()
    size = {i: len(WORD.findall(d.text or "")) for i, d in docs.items()}
    for i, d in docs.items():
        tokens[d.source] += size[i]
    total = sum(tokens.values())
    ratio = lambda t, x: max((n / total) ** (x - 1) for n in t.values()) / min(
        (n / total) ** (x - 1) for n in t.values())
    x = plain_exponent(tokens, ratio, 1.5)
    table = spark.createDataFrame(list(tokens.items()), "source string, tokens long")
    assert abs(mixing.exponent(table, repeats=1.5) - x) < 1e-6
    entropy = lambda w: -sum(v / sum(w) * math.log(v / sum(w)) for v in w)
    power = mixing.exponent(table, entropy=2.9)
    assert abs(entropy([n ** power for n in tokens.values()]) - 2.9) < 1e-6
    raised = {s: n ** power for s, n in tokens.items()}
    budget = max(n * sum(raised.values()) / raised[s] for s, n in tokens.items())
    rows = queries.op6_mixing(spark, MIDDLE).collect()
    for s, n in tokens.items():
        own = [r for r in rows if r.source == s]
        want = int(budget * raised[s] / sum(raised.values()) + 1e-6 * n)
        whole = want // n
        uses = Counter(r.doc_id for r in own if r.block < whole)
        ids = [i for i, d in docs.items() if d.source == s]
        assert uses == Counter({i: whole for i in ids})
        last = sorted((r.slot, r.doc_id) for r in own if r.block == whole)
        slots = {r.doc_id: r.slot for r in own if r.block == whole}
        assert sum(size[i] for i in slots) <= want - whole * n
        if last:  # the next document of the permutation would not fit
            assert max(size.values()) + sum(size[i] for i in slots) > want - whole * n


def test_op6_order_of_the_last_block(spark):
    counts = spark.createDataFrame([(i, "s" if i % 3 else "t", 1 + i % 5) for i in range(5000)],
                                   "id long, source string, tokens long")
    sums = {r.source: r.t for r in counts.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    budgeted = spark.createDataFrame([(s, t, 0.5, t + t // 3, 1) for s, t in sums.items()],
                                     "source string, tokens long, weight double, budget long, blocks int")
    a, b = (mixing.plan(counts, budgeted, rows_per_slice=k).where("block = 1") for k in (10, 100_000))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    hashed = counts.select("*", F.shiftrightunsigned(F.xxhash64(F.lit(0), F.lit(1), "id"), 1).alias("slot")).collect()
    for s, t in sums.items():
        run, want = 0, set()
        for r in sorted((r for r in hashed if r.source == s), key=lambda r: (r.slot, r.id)):
            run += r.tokens
            if run <= t // 3:
                want.add(r.id)
        assert want == {r.id for r in a.where(F.col("source") == s).collect()}


def test_op7_held_out(spark):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = [r for r in queries.op7_quality(spark, MIDDLE).collect() if r.held_out and r.doc_id in quality]
    good = [r.score for r in rows if quality[r.doc_id] == 1]
    bad = [r.score for r in rows if quality[r.doc_id] == 0]
    wins = sum((g > b) + (g == b) / 2 for g in good for b in bad)
    assert good and bad and wins >= 0.97 * len(good) * len(bad)


def plain_measures(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered))


def test_op8_measures_and_verdicts(spark):
    docs = documents(spark, MIDDLE)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = queries.op8_rules(spark, MIDDLE).collect()
    assert len(rows) == len(docs)
    for r in rows:
        m = plain_measures(docs[r.doc_id].text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0])
        assert not (r.kept and r.base_failed)
    clean = [r for r in rows if quality.get(r.doc_id) == 1 and not r.base_failed]
    junk = [r for r in rows if quality.get(r.doc_id) == 0]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean)
    assert sum(not r.kept for r in junk) >= 0.6 * len(junk)


def test_kneser_ney_sums_to_one():
    text = b"the cat sat on the mat and the other cat sat on the hat with the bat " * 3 + b"zebra quiz"
    grams, counts = np.unique(perplexity._grams([text, b"another text of the cat"])[0], return_counts=True)
    m = perplexity.model(grams, counts)
    seen = dict(zip(m.grams.tolist(), m.log_p.tolist()))
    for context in [*np.unique(grams >> 8)[:40].tolist(), ord("q") << 8 | ord("q")]:
        p = [math.exp(seen.get(context << 8 | c, m.back[context] + m.pairs[(context & 0xFF) << 8 | c]))
             for c in range(256)]
        assert abs(sum(p) - 1) < 1e-4
    assert np.isnan(perplexity.log_perplexity(m, [b""])).all()


def test_op10_merge_of_runs():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randrange(9), rng.randrange(3)) for _ in range(rng.randrange(20))) for _ in range(k)]
        got = [runs[r][i] for r, i in warc.merged(runs)]
        assert got == list(heapq.merge(*runs))


def test_op10_url_keys():
    assert warc.url_key("HTTP://WWW.Example.com:80/a/B?x=1#top") == "com,example)/a/B?x=1"
    assert warc.url_key("https://m.example.org:8443") == "org,example,m:8443)/"
    assert warc.url_key(None) == ")/"


def test_op10_order(spark):
    rows = queries.op10_warc(spark, MIDDLE).collect()
    assert [r.url_key for r in rows] == sorted(r.url_key for r in rows)


def test_pipeline_stages_on_their_own_inputs(spark, tmp_path):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    before = {r.doc_id: r for r in docs.collect()}
    for k, (name, fn) in enumerate(corpus_pipeline.STAGES):
        fn(spark, docs, MIDDLE).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        after = {r.doc_id: r for r in rows}
        assert set(after) <= set(before)
        if name == "language_id":
            assert all(i in after for i in before if quality.get(i) == 1)
        if name == "line_dedup":
            assert all(r.n_chars == len(r.text) for r in rows)
            assert sum(len(r.text) for r in rows) < sum(len(r.text) for r in before.values())
        if name == "simhash_near_dedup":
            near = {i: plain_fingerprint(r.text) for i, r in before.items()}
            kept = [near[i] for i in after]
            assert len(kept) == len(set(kept))
            assert all(any((near[i] ^ f).bit_count() <= 2 for f in near.values()) for i in before)
        if name == "mixing":
            assert set(after) == set(before) and max(Counter(r.doc_id for r in rows).values()) == 2
        if k < 4:
            before = after
    assert all(r.n_pieces == len(r.pieces) for r in rows)
