"""Small cases for places where an operator once did less than its whole job."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditloom.llm import langid, linededup, neardup, perplexity, queries, secretscan, simhash
from auditloom.llm.components import connected

MIDDLE = "/root/testdata/sf0.01"


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))


def deduped(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in linededup.delete_repeated(rows).orderBy("doc_id").collect()]


def test_line_dedup_extends_past_the_last_window(spark):
    a, b, c, d = words(1, 60), words(2, 40), words(3, 5), words(4, 70)
    assert deduped(spark, [f"{a}\n{b}"] * 3) == [f"{a}\n{b}", "", ""]
    # In the middle, over a line without words, and up to the first line that differs.
    assert deduped(spark, [f"{a}\n\n{b}\n{c}", f"{d}\n{a}\n\n{b}\nother\n{c}"]) == [
        f"{a}\n\n{b}\n{c}", f"{d}\nother\n{c}"]
    # The first text with the window ends there; the lines that follow stand in the second.
    assert deduped(spark, [a, f"{a}\n{b}", f"{a}\n{b}\n{c}", f"{a}\n{b}\n{c}"]) == [a, b, c, ""]
    # Short lines alone are no repeat, and a text's own first copy stays.
    assert deduped(spark, [b, b, f"{a}\n{c}\n{a}\n{c}"]) == [b, b, f"{a}\n{c}"]


def plain_dedup(texts, least=50):
    """The rule as a plain program: (doc, line) of every line to delete."""
    def count(x):
        return len(re.findall(r"[^\x20\x09-\x0D]+", x))

    seen, gone = {}, set()
    for d, text in enumerate(texts):
        lines = [(p, x) for p, x in enumerate(text.split("\n")) if count(x)]
        for k in range(len(lines)):
            total, j = 0, k
            while j < len(lines) and total < least:
                total, j = total + count(lines[j][1]), j + 1
            if total < least:
                break
            ends, reach, nxt = [j], 0, k + 1
            while nxt < len(lines) and reach < least:
                reach, nxt = reach + count(lines[nxt][1]), nxt + 1
                if nxt > j:
                    ends.append(nxt)
            for end in ends:
                head = seen.setdefault(tuple(x for _, x in lines[k:end]), (d, k))
                if head[0] != d or k >= head[1] + end - k:
                    gone |= {(d, p) for p in range(lines[k][0], lines[end - 1][0] + 1)}
    return gone


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_against_a_plain_program(spark, seed):
    rng = random.Random(seed)
    pool = [words(100 * seed + k, rng.choice([1, 4, 12, 30, 55])) for k in range(14)] + ["", " "]
    passages = [[rng.choice(pool) for _ in range(rng.randint(3, 9))] for _ in range(4)]
    texts = []
    for _ in range(14):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 4))]
        for _ in range(rng.randint(0, 3)):
            own = rng.choice(passages)
            lines += own[rng.randint(0, 1):rng.randint(3, 9)] + [rng.choice(pool) for _ in range(rng.randint(0, 2))]
        texts.append("\n".join(lines))
    gone = plain_dedup(texts)
    assert gone
    assert deduped(spark, texts) == ["\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone)
                                     for d, t in enumerate(texts)]


def test_op9_leaves_no_stub_of_an_exact_copy(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    first = docs.groupBy("text").agg(F.min("doc_id").alias("first"))
    copies = {r.doc_id: r.text for r in docs.join(first, "text").where("doc_id <> first").collect()}
    left = {r.doc_id: r.text for r in queries.op9_line_dedup(spark, MIDDLE).collect()}
    long = [i for i, t in copies.items() if len(re.findall(r"[^\x20\x09-\x0D]+", t)) >= 50]
    assert len(long) > 50 and not [i for i in long if left[i].strip()]


def test_line_dedup_stage_leaves_no_stub_of_an_exact_copy(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    first = docs.groupBy("text").agg(F.min("doc_id").alias("first"))
    copies = {r.doc_id: r.text for r in docs.join(first, "text").where("doc_id <> first").collect()}
    after = {r.doc_id: r.text for r in corpus_pipeline.new_lines(spark, docs, MIDDLE).collect()}
    long = {i for i, t in copies.items() if len(re.findall(r"[^\x20\x09-\x0D]+", t)) >= 50}
    assert len(long) > 50 and not long & set(after)


def plain_set(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(found[i:i + 5]) for i in range(max(1, len(found) - 4))) if found else frozenset()


def test_near_dedup_stage_against_all_pairs(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    sets = {r.doc_id: plain_set(r.text) for r in docs.collect()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids, near = sorted(sets), 0
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) * 5 >= 4 * max(len(x), len(y)):
                both = len(x & y)
                if 5 * both >= 4 * (len(x) + len(y) - both):
                    near += x != y
                    root[max(find(a), find(b))] = min(find(a), find(b))
    assert near >= 10
    got = {r.id: r.component for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: find(i) for i in sets}
    for r in simhash.near_duplicates(docs).collect():
        a, b = find(r.id), find(r.component)
        root[max(a, b)] = min(a, b)
    kept = [r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, MIDDLE).collect()]
    assert sorted(kept) == sorted(i for i in sets if find(i) == i)


def test_near_duplicates_of_a_large_group(spark):
    base = words(7, 100).split()
    texts = [" ".join(base[:i] + ["changed"] + base[i + 1:]) for i in range(40)] + [words(8, 100)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.component for r in neardup.near_duplicates(rows).orderBy("id").collect()] == [0] * 40 + [40]


@pytest.mark.parametrize("seed", range(3))
def test_links_of_large_keys_against_all_pairs(spark, seed):
    """One key for all: groups around some sets, chains, and sets just above and below the similarity."""
    rng = random.Random(seed)
    own = {}
    for group in range(4):
        base = [rng.randrange(1 << 40) for _ in range(60)]
        for k in range(25):
            changed = list(base) if k % 5 else own.get((group, k - 5), base)[:]
            for i in rng.sample(range(60), rng.choice([2, 5, 7, 9, 14])):
                changed[i] = rng.randrange(1 << 40)
            own[group, k] = changed
    nodes = {i: set(v) for i, v in enumerate(own.values())}
    root = {i: i for i in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in range(a):
            both = len(nodes[a] & nodes[b])
            if 5 * both >= 4 * (len(nodes[a]) + len(nodes[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    keyed = spark.range(len(nodes)).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("node"))
    sets = spark.createDataFrame([(i, sorted(v)) for i, v in nodes.items()], "node long, own array<long>")
    links = neardup.similar_links(keyed, lambda ends: sets.join(ends, "node", "left_semi"), 0.8)
    got = {r.node: r.root for r in connected(links).collect()}
    assert {i: got.get(i, i) for i in nodes} == {i: find(i) for i in nodes}
    assert len(set(map(find, nodes))) > 4


def test_sets_of_a_large_key_that_are_just_too_far_apart_make_no_pairs(spark):
    """Sets near one base share common elements among their rarest, but too few are left after them."""
    rng = random.Random(5)
    rows = [(i, [1_000 * i + k + 1_000 if k in own else k for k in range(60)])
            for i in range(40) for own in [set(rng.sample(range(60), 9))]]
    sets = spark.createDataFrame(rows, "node long, own array<long>")
    large = sets.select(F.lit(1).cast("long").alias("key"), "node")
    none = spark.createDataFrame([], "a long, b long")
    assert neardup._left_over(large, none, sets, 0.8).count() == 0
    near = spark.createDataFrame([(100, rows[7][1][:59] + [-1])], "node long, own array<long>")
    left = neardup._left_over(large.unionByName(near.select(F.lit(1).cast("long").alias("key"), "node")), none,
                              sets.unionByName(near), 0.8)
    assert [tuple(r) for r in left.collect()] == [(7, 100)]


def test_near_duplicates_of_odd_rows(spark):
    base = words(9, 60)
    rows = [(None, base), (5, base), (3, base + " x"), (5, base), (5, "other text altogether and more"), (7, None),
            (6, ""), (None, None), (8, "a b"), (9, "A  b"), (10, "x " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit(1) for c in ("id", "th", "node", "key", "keys")})
    got = {(r.id, r.component) for r in neardup.near_duplicates(docs).collect()}
    assert got == {(None, 3), (5, 3), (3, 3), (5, 5), (7, 6), (6, 6), (None, 6), (8, 8), (9, 8), (10, 10)}
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    only = docs.where("doc_id IS NULL AND text IS NOT NULL")
    assert [(r.component, r.kept) for r in neardup.near_duplicates(only).collect()] == [(None, True)]


def test_near_dedup_stage_keeps_other_texts_of_an_id(spark):
    a, b, c = words(21, 80), words(22, 80), words(23, 80)
    rows = [(1, a), (1, b), (1, b), (2, a + " more"), (3, c), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    kept = corpus_pipeline.one_of_each(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, a), (1, a), (1, b), (3, c)])


def test_language_of_scripts_nobody_learned(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    model = langid.train(docs)
    latin = docs.where("doc_id = 0 OR lang = 'en'").first().text[:60]
    texts = ["αβγ δεζ ηθι κλμ", "日本語 の 文章", f"{latin} αβγ", "the that " + "αβγδε " * 20]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = langid.identify(rows, model).orderBy("id").collect()
    assert all(r.lang_pred in model.languages and r.score == 0 for r in got[:2])
    assert [s.lang for r in got[:2] for s in r.spans] == ["und"] * 2
    assert got[2].lang_pred != "und" and got[2].score > 0.5 and got[2].spans[-1].lang == "und"
    assert got[3].lang_pred == "en" and abs(got[3].score - 7 / 107) < 1e-9
    given = docs.where("doc_id < 200").unionByName(docs.limit(1).select(
        F.lit(-1).cast("long").alias("doc_id"), F.lit("αβγ δεζ ηθι").alias("text"), F.lit(None).cast("string").alias("lang"),
        "source", "n_chars"))
    assert -1 not in {r.doc_id for r in corpus_pipeline.known_language(spark, given, MIDDLE).collect()}


def test_texts_half_of_garbage_fail(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    rng = random.Random(6)
    clean = docs.where("lang = 'en' AND n_chars BETWEEN 1500 AND 4000").orderBy("doc_id").limit(60).collect()
    kept = {r.id for r in perplexity.judged(docs).where("kept").collect()}
    clean = [r for r in clean if r.doc_id in kept][:30]
    assert len(clean) == 30
    rows = []
    for k, r in enumerate(clean):
        for j, share in enumerate((0.5, 0.65, 0.9)):
            n = int(len(r.text) * share / (1 - share)) // 7
            junk = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=6)) for _ in range(n))
            rows.append((10_000_000 + 10 * k + j, f"{r.text}\n{junk}", "en", r.source, 0))
        # A passage in another language is no garbage if most of the text is sound.
        other = docs.where("lang = 'fr'").orderBy("doc_id").first().text[:len(r.text) // 5] if k == 0 else other
        rows.append((10_000_000 + 10 * k + 9, f"{r.text}\n{other[:len(r.text) // 5]}", "en", r.source, 0))
    got = {r.id: r.kept for r in perplexity.judged(docs.unionByName(spark.createDataFrame(rows, docs.schema))).where(
        "id >= 10000000").collect()}
    assert not any(v for i, v in got.items() if i % 10 != 9)
    assert sum(v for i, v in got.items() if i % 10 == 9) >= 27


def test_random_spans_keep_off_fixed_ones(spark):
    """Against all pairs of spans of a text; many of them in one text take linear time."""
    rng = random.Random(8)
    pieces = ["password=abcdefghij", "AKIA" + "Q" * 16, "0123456789abcdef" * 2, "xK9" * 8, "token: x", "plain words here", "é"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", ",", "\n"]) for _ in range(rng.randint(1, 14))) for _ in range(60)]
    texts.append(" ".join(f"xK9vT{k:06d}qWz7Lm4Rb AKIA{'B' * 16}" for k in range(6000)))
    flat = [3.0] * len(secretscan.ALPHABET) ** 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.id: r.found for r in secretscan.scan(docs, flat).collect()}
    for i, text in enumerate(texts[:-1]):
        base = [s for s in rows[i] if s.kind < 3]
        runs = [(m.start(), m.end()) for m in re.finditer(secretscan.RUN + "{20,}", text)]
        want = [x for x in runs if not any(b.start < x[1] and x[0] < b.end for b in base)]
        assert [(s.start, s.end) for s in rows[i] if s.kind == 3] == want
    assert len(rows[60]) == 12_000


def test_near_dedup_stage_searches_large_keys_exactly(spark, monkeypatch):
    """The stage leaves no key to its hub alone."""
    asked, real = [], neardup.similar_links
    monkeypatch.setattr(neardup, "similar_links", lambda *a: asked.append(a[3]) or real(*a))
    docs = spark.createDataFrame([(i, f"one two three four five {i % 2}", "en", "s", 24) for i in range(4)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.one_of_each(spark, docs, "")
    assert asked == [True] and {r.doc_id for r in kept.collect()} == {0, 1}
