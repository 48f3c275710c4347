"""Quality rules with n-gram perplexity bands.

Per language, a modified Kneser-Ney model of byte trigrams: Spark counts the trigrams of all documents, and the
model is kept as sorted arrays of gram codes with log-probabilities beside them.  The three bytes of a gram are
its hash, free of collisions and good for every script, and bound a language's model at 2 ** 24 grams.  Unseen
grams back off to the interpolated bigrams.

A document's perplexity is told twice, from its stretches of STRETCH bytes: the QUANTILE-th and the UPPER-th from
below.  The first one does not let a passage of another language speak for the whole text; the second one does not
let a clean passage speak for a text of which half or more is out of order.  Each is compared with bands around
its own median in the language, as wide as a number of median absolute deviations and wider for short texts, and
both must lie within.  Bands come from histograms over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from auditloom.functions.session import materialise
from auditloom.llm.chars import runs

BEGIN = b"\xff\xff"  # no byte of UTF-8: what stands before a text
PART = 1_000_000
STRETCH, QUANTILE, UPPER = 128, 0.3, 0.6
FINE = 1000  # bins of the band histograms for each unit of log-perplexity
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
UNSHOWN = SPACES + bytes(range(0x80, 0xC0))  # bytes that begin no character of a word
SYMBOLS = b"#*$%&|<>"


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the trigrams that end at each byte of the texts, and the number of bytes of each text."""
    flat = np.frombuffer(b"".join(x for t in texts for x in (BEGIN, t)), np.uint8).astype(np.int32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.flatnonzero(flat != 0xFF)
    return flat[at - 2] << 16 | flat[at - 1] << 8 | flat[at], sizes


def _by_language(batch):
    """Language, row numbers and texts, a part of a batch at a time."""
    langs = np.array(batch.column("lang").to_pylist(), object)
    texts = batch.column("text").to_pylist()
    for lang in dict.fromkeys(langs):
        rows = np.flatnonzero(langs == lang)
        own = [texts[i] or b"" for i in rows]
        for a, b in runs([len(t) for t in own], PART):
            yield lang, rows[a:b], own[a:b]


def _tally(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    keys, counts = (np.concatenate(x) for x in zip(*pairs))
    distinct, where = np.unique(keys, return_inverse=True)
    return [(distinct, np.bincount(where, counts).astype(np.int64))]


def _counted(batches):
    """Counts of a task: (lang, gram, n)."""
    found: dict[str, list] = {}
    for batch in batches:
        for lang, _, texts in _by_language(batch):
            held = found.setdefault(lang, [])
            held.append(np.unique(_grams(texts)[0], return_counts=True))
            if len(held) > 16:
                found[lang] = _tally(held)
    for lang, held in found.items():
        [(gram, n)] = _tally(held)
        for a in range(0, len(gram), 100_000):
            part = gram[a:a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part.astype(np.int32)),
                                              pa.array(n[a:a + 100_000])], ["lang", "gram", "n"])


def count_grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n) over all documents; null languages are one language, the empty one."""
    rows = docs.select(F.coalesce(lang_col, F.lit("")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_counted, "lang string, gram int, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))


@dataclass
class Model:
    grams: np.ndarray  # sorted codes
    log_p: np.ndarray  # of each gram's last byte after the others
    back: np.ndarray  # log-weight of backing off, by the first two bytes
    pairs: np.ndarray  # interpolated log-probability of a byte after one other


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more; plain ones where counts of counts lack."""
    n = np.bincount(np.minimum(counts, 5), minlength=6).astype(float)
    if n[1:4].min() <= 0:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n[1] / (n[1] + 2 * n[2])
    d = np.array([0.0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]])
    return np.clip(d, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.9])


def _level(counts: np.ndarray, context: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Discounted share of each gram in its context, and the mass that each context leaves to backing off."""
    d = _discounts(counts)[np.minimum(counts, 3)]
    total = np.bincount(context, counts, size)
    left = np.bincount(context, d, size) / np.maximum(total, 1)
    return (counts - d) / total[context], np.where(total > 0, left, 1.0)


def model(grams: np.ndarray, counts: np.ndarray) -> Model:
    """Model of one language from its sorted gram codes and their counts."""
    pairs, kinds = np.unique(grams & 0xFFFF, return_counts=True)  # continuation counts of bigrams
    ones, few = np.unique(pairs & 0xFF, return_counts=True)  # and of single bytes
    share, left = _level(few, np.zeros(len(few), np.int64), 1)
    p1 = np.full(256, left[0] / 256)
    p1[ones] += share
    share, left = _level(kinds, pairs >> 8, 256)
    p2 = left[:, None] * p1[None, :]
    p2[pairs >> 8, pairs & 0xFF] += share
    share, left = _level(counts, grams >> 8, 1 << 16)
    p3 = share + left[grams >> 8] * p2.ravel()[grams & 0xFFFF]
    return Model(grams, np.log(p3).astype(np.float32), np.log(left).astype(np.float32),
                 np.log(p2.ravel()).astype(np.float32))


def log_perplexity(m: Model, texts: list[bytes]) -> np.ndarray:
    """Log-perplexity (mean of -log p over bytes) of each text, by its stretches at QUANTILE and UPPER; NaN for empty
    ones.

    A last stretch of less than half the length belongs to the one before it.
    """
    gram, sizes = _grams(texts)
    place = np.searchsorted(m.grams, gram)
    place[place == len(m.grams)] = 0
    log_p = np.where(m.grams[place] == gram, m.log_p[place], m.back[gram >> 8] + m.pairs[gram & 0xFFFF])
    pieces = np.maximum((sizes + STRETCH // 2) // STRETCH, sizes > 0)
    first = np.cumsum(pieces) - pieces
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(gram)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    piece = first[text] + np.minimum(at // STRETCH, pieces[text] - 1)
    mean = -np.bincount(piece, log_p, int(pieces.sum())) / np.maximum(np.bincount(piece, minlength=int(pieces.sum())), 1)
    ordered = mean[np.lexsort((mean, np.repeat(np.arange(len(sizes)), pieces)))]
    out = np.full((len(sizes), 2), np.nan)
    some = sizes > 0
    for k, q in enumerate((QUANTILE, UPPER)):
        out[some, k] = ordered[(first + np.floor(q * (pieces - 1)).astype(np.int64))[some]]
    return out


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that the text holds twice or more, the first included.

    Windows are told apart exactly: ranks of pairs of ranks double the width until it is reached.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    rank = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    single, reach = rank, 1
    while reach < width:
        step = min(reach, width - reach)
        other = rank if step == reach else single
        if step not in (1, reach):
            raise ValueError("width must be a power of two, or one more")
        rank = np.unique(rank[:len(rank) - step] << 32 | other[reach:reach + len(rank) - step],
                         return_inverse=True)[1]
        reach += step
    again = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edge = np.bincount(again, minlength=len(words) + 1) - np.bincount(again + width, minlength=len(words) + 1)
    return int((np.cumsum(edge) > 0).sum())


def _measures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    return (len(words), len(text.translate(None, UNSHOWN)), len(text) - len(text.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def measured(docs: DataFrame, grams: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", most: int = 1 << 24) -> DataFrame:
    """(id, lang, n_bytes, log_ppl, upper_ppl, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every row.

    The models of several languages are broadcast together up to ``most`` grams, which one language cannot pass;
    beyond that the documents are scored by groups of languages.
    """
    sizes = sorted((r.lang, r.n) for r in grams.groupBy("lang").agg(F.count("*").alias("n")).collect())
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(lang_col, F.lit("")).alias("lang"),
                       F.col(text_col).cast("binary").alias("text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    shape = f"id {kind}, lang string, n_bytes long, log_ppl double, upper_ppl double, " + ", ".join(f"{n} long" for n in names)
    groups = [[lang for lang, _ in sizes[a:b]] for a, b in runs([n for _, n in sizes], most)]
    out = None
    for k, group in enumerate(groups or [[]]):
        table = grams.where(F.col("lang").isin(group)).orderBy("lang", "gram").toArrow()
        langs = np.array(table.column("lang").to_pylist(), object)
        codes, counts = table.column("gram").to_numpy(), table.column("n").to_numpy()
        shared = docs.sparkSession.sparkContext.broadcast(
            {lang: model(codes[langs == lang], counts[langs == lang]) for lang in group})

        def scored(batches, shared=shared):
            models = shared.value
            for batch in batches:
                ppl = np.full((batch.num_rows, 2), np.nan)
                for lang, own, texts in _by_language(batch):
                    if lang in models:
                        ppl[own] = log_perplexity(models[lang], texts)
                texts = [t or b"" for t in batch.column("text").to_pylist()]
                found = np.array([_measures(t) for t in texts], np.int64).reshape(-1, len(names))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("lang"), pa.array([len(t) for t in texts], pa.int64()),
                     *(pa.array(p, mask=np.isnan(p)) for p in ppl.T.copy()), *(pa.array(c) for c in found.T)],
                    ["id", "lang", "n_bytes", "log_ppl", "upper_ppl", *names])

        # Languages without a model (empty texts only) go with the first group.
        own = F.col("lang").isin(group)
        if k == 0:
            own = own | ~F.col("lang").isin([lang for lang, _ in sizes])
        part = rows.where(own).mapInArrow(scored, shape)
        out = part if out is None else out.unionByName(part)
    return out


def _median(bins: DataFrame) -> DataFrame:
    """(lang, median): the middle bin of histograms (lang, bin, n)."""
    of_lang = Window.partitionBy("lang")
    upto = F.sum("n").over(of_lang.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return bins.withColumns({"upto": upto, "all": F.sum("n").over(of_lang)}).where(
        F.col("upto") * 2 >= F.col("all")).groupBy("lang").agg(F.min("bin").alias("median"))


def bands(rows: DataFrame, of: str = "log_ppl") -> DataFrame:
    """(lang, median, spread) of a log-perplexity: median and median absolute deviation, both to one bin.

    Only histograms, whose bins the range of log-perplexity bounds, meet by language.
    """
    n = F.sum("n").alias("n")
    bins = materialise(rows.select("lang", F.round(F.col(of) * FINE).cast("long").alias("bin"), F.lit(1).alias("n"))
                       .groupBy("lang", "bin").agg(n), "perplexity-bins")
    middle = materialise(_median(bins), "perplexity-medians")
    apart = bins.join(middle, "lang").groupBy("lang", F.abs(F.col("bin") - F.col("median")).alias("bin")).agg(n)
    return middle.join(_median(apart).withColumnRenamed("median", "spread"), "lang").select(
        "lang", (F.col("median") / FINE).alias("median"), (F.col("spread") / FINE).alias("spread"))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           below: float = 8.0, above: float = 5.0, short: int = 600, least: float = 0.01) -> DataFrame:
    """``measured`` columns of every row, base_failed, low and high (the document's band), upper_low and upper_high
    (that of ``upper_ppl``), and kept.

    A band is ``below`` and ``above`` deviations around the median of the language's texts that pass the base
    rules, times 1 + short / bytes; a deviation is the median absolute one, ``least`` at least.  Null and
    empty texts fail the base rules.  A language none of whose texts pass has no band; all fail anyhow.
    Repeated rows count and are judged each.  Other columns are not read.
    """
    grams = materialise(count_grams(docs, text_col, lang_col), "perplexity-grams")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = materialise(measured(docs, grams, id_col, text_col, lang_col).withColumn("base_failed", failed),
                       "perplexity-measures")
    sound = rows.where(~F.col("base_failed"))
    wide = F.greatest("spread", F.lit(least)) * (1 + short / F.greatest("n_bytes", F.lit(1)))
    within = ~F.col("base_failed")
    for of, before in (("log_ppl", ""), ("upper_ppl", "upper_")):
        low, high = f"{before}low", f"{before}high"
        known = materialise(bands(sound, of), "perplexity-bands")
        rows = rows.join(known, "lang", "left").withColumns({
            low: F.col("median") - below * wide, high: F.col("median") + above * wide}).drop("median", "spread")
        within = within & F.coalesce(F.col(of).between(F.col(low), F.col(high)), F.lit(False))
    return rows.withColumn("kept", within)
