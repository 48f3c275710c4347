"""Language identification: script ranges narrow the candidates, Viterbi over words labels spans.

A word is a run of letters.  Its score under a language adds the log-probabilities of the letter trigrams
around each of its letters, from hashed counts.  Only languages that use the word's script compete for it.
Viterbi runs over the words of a text with one penalty for every switch of language; runs of equal labels are
the spans, and the language with most letters is that of the text.  Words in a script that no learned language
uses belong to none: they are spans of ``und``, and their letters count for no language.  A text of such words only
gets the language whose trigrams fit its letters best, with score 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from auditloom.llm.chars import code_points, lower_letters, mixed, runs

# First code points of script ranges (Unicode blocks) and the scripts they belong to.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "other"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"),
    (0x1CC0, "other"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C00, "other"),
    (0x2C60, "Latin"), (0x2C80, "other"), (0x2DE0, "Cyrillic"), (0x2E80, "Han"), (0x3040, "Kana"),
    (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Han"), (0xA000, "other"),
    (0xA640, "Cyrillic"), (0xA6A0, "other"), (0xA720, "Latin"), (0xA800, "other"), (0xAC00, "Hangul"),
    (0xD800, "other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFE00, "other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"),
    (0xFFA0, "Hangul"), (0xFFE0, "other"), (0x20000, "Han"), (0x32000, "other"))
NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
STARTS = np.array([start for start, _ in SCRIPTS], np.uint32)
SCRIPT_OF = np.array([NAMES.index(name) for _, name in SCRIPTS], np.int16)

BITS = 16  # trigram counts are kept in 2 ** BITS hashed places a language
PART = 500_000  # code points worked on at once
GROUP = 4_000_000  # code points whose words are labelled together


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # (language, place)
    uses: np.ndarray  # (script, language): the language is written in the script


def _trigrams(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of the letters of the texts: hashed trigram, position, script, start of word; and the texts' offsets."""
    flat, offsets = code_points(texts)
    low = lower_letters()[flat].astype(np.uint64)
    at = np.flatnonzero(low)
    before = np.where(at > 0, low[at - 1], 0)
    key = low[at] << np.uint64(42) ^ before << np.uint64(21) ^ low[at + 1]  # a line feed ends each text
    script = SCRIPT_OF[np.searchsorted(STARTS, flat[at], "right") - 1]
    return mixed(key, BITS), at, script, before == 0, offsets


def _counted(batches):
    """Partial counts of a task: (lang, kind, place, n); kind 0 counts trigrams, kind 1 letters by script."""
    grams: dict[str, np.ndarray] = {}
    letters: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = batch.column("text").to_pylist()
        for lang in dict.fromkeys(langs):
            own = [texts[i] for i in np.flatnonzero(langs == lang)]
            for a, b in runs([len(t) for t in own], PART):
                place, _, script, _, _ = _trigrams(own[a:b])
                grams[lang] = grams.get(lang, 0) + np.bincount(place, minlength=1 << BITS)
                letters[lang] = letters.get(lang, 0) + np.bincount(script, minlength=len(NAMES))
    for kind, counts in ((0, grams), (1, letters)):
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "kind": np.full(len(at), kind, np.int32),
                                              "place": at.astype(np.int32), "n": n[at].astype(np.int64)})


def bounded(docs: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """The ``most`` rows with the least hashes of their ids (more only on equal ids), all if there are fewer."""
    mark = F.xxhash64(F.lit(7), F.col(id_col))
    last = docs.select(mark.alias("h")).orderBy("h").limit(most).agg(F.max("h"), F.count("*")).first()
    return docs if last[1] < most else docs.where(mark <= last[0])


def bounded_each(docs: DataFrame, most: int, max_languages: int, id_col: str = "doc_id") -> DataFrame:
    """About ``most`` rows of each ``lang`` by the hash of the id, all rows of a language that has no more."""
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).limit(
        max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    large = {lang: most / n for lang, n in sizes.items() if n > most}
    if not large:
        return docs
    share = F.create_map(*[F.lit(x) for pair in large.items() for x in pair])
    mark = F.pmod(F.xxhash64(F.lit(7), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    return docs.where(mark < F.coalesce(share[F.col("lang")], F.lit(1.0)))


def train(docs: DataFrame, max_docs: int = 5_000, smoothing: float = 0.05, share: float = 0.01,
          max_languages: int = 1_000) -> Model:
    """Counts of a bounded sample of labelled documents (doc_id, text, lang; nulls are left out).

    ``max_docs`` bounds the sample of each language, chosen by a hash of doc_id, so a rare language is learned beside
    frequent ones at every size; the count is met on average (repeated ids fall together).  The model is bounded by ``max_languages`` times
    2 ** BITS places; more languages are an error.  A language uses a script if ``share`` of its letters are in it.
    """
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    rows = bounded_each(known, max_docs, max_languages).select("text", "lang").mapInArrow(
        _counted, "lang string, kind int, place int, n long").groupBy("lang", "kind", "place").agg(
        F.sum("n").alias("n"))
    table = rows.toArrow()
    langs = np.array(table.column("lang").to_pylist(), object)
    names = sorted(set(langs))
    code = np.searchsorted(names, langs) if names else np.zeros(0, int)
    kind, place, n = (table.column(c).to_numpy() for c in ("kind", "place", "n"))
    grams, letters = np.zeros((len(names), 1 << BITS)), np.zeros((len(NAMES), len(names)))
    grams[code[kind == 0], place[kind == 0]] = n[kind == 0]
    letters[place[kind == 1], code[kind == 1]] = n[kind == 1]
    total = grams.sum(1, keepdims=True)
    log_p = np.log((grams + smoothing) / (total + smoothing * (1 << BITS))).astype(np.float32)
    return Model(names, log_p, letters >= share * np.maximum(letters.sum(0, keepdims=True), 1))


def _words(texts: list[str], model: Model):
    """Word scores (word, language), first and last position (in its text), text number, letters, and whether any
    language is written in the word's script; scores of other words keep no language out."""
    place, at, script, begins, offsets = _trigrams(texts)
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros((0, len(model.languages)), np.float32), *(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, bool)
    score = np.empty((len(start), len(model.languages)), np.float32)
    for k, log_p in enumerate(model.log_p):
        score[:, k] = np.add.reduceat(log_p[place], start)
    able = model.uses[script[start]]
    some = able.any(1)
    score[some[:, None] & ~able] = -1e6
    last = np.append(start[1:], len(at)) - 1
    text = np.searchsorted(offsets, at[start], "right") - 1
    return score, at[start] - offsets[text], at[last] + 1 - offsets[text], text, last - start + 1, some


def viterbi(score: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each row of ``score`` (row, label) if a change of label inside a text costs ``penalty``.

    Rows of a text are consecutive; ``sizes`` has the number of rows of each text.  All texts advance together,
    the longest first, so that those still going are a prefix.  Ties go to the smaller label.
    """
    order = np.argsort(-sizes, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    going = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), "left")
    stays = np.ones(score.shape, bool)
    source = np.zeros(len(score), np.int32)
    best = np.zeros((len(sizes), score.shape[1]), np.float32)
    for t, k in enumerate(going):
        row = begin[:k] + t
        if t:
            now = best[:k]
            top = now.max(1)
            stay = now >= (top - penalty)[:, None]
            stays[row], source[row] = stay, now.argmax(1)
            best[:k] = np.where(stay, now - top[:, None], -penalty) + score[row]
        else:
            best[:k] = score[row]
    out = np.zeros(len(score), np.int32)
    label = best.argmax(1).astype(np.int32)
    for t in range(len(going) - 1, -1, -1):
        k = going[t]
        row = begin[:k] + t
        out[row] = label[:k]
        label[:k] = np.where(stays[row, label[:k]], label[:k], source[row])
    return out


def _labelled(texts: list[str], model: Model, penalty: float) -> list[pa.Array]:
    parts = []
    for a, b in runs([len(t) for t in texts], PART):
        score, start, end, text, letters, some = _words(texts[a:b], model)
        parts.append((score, start, end, text + a, letters, some))
    score, start, end, text, letters, some = (np.concatenate(x) for x in zip(*parts))
    n = len(texts)
    label = viterbi(np.where(some[:, None], score, 0), np.bincount(text, minlength=n), penalty)
    votes = np.bincount(text * len(model.languages) + label, letters * some, n * len(model.languages)).reshape(n, -1)
    total, top = np.bincount(text, letters, n), votes.argmax(1)
    names = np.array([*model.languages, "und"], object)
    label = np.where(some, label, len(model.languages))
    strange = np.flatnonzero((votes.max(1) == 0) & (total > 0))
    if len(strange):
        fit = np.zeros((n, len(model.languages)))
        np.add.at(fit, text, score)
        top[strange] = fit[strange].argmax(1)
    predicted = np.where(total > 0, names[top], "und")
    share = np.where(total > 0, votes.max(1) / np.maximum(total, 1), 0.0)
    opens = np.ones(len(text), bool)
    opens[1:] = (text[1:] != text[:-1]) | (label[1:] != label[:-1])
    head = np.flatnonzero(opens)
    tail = np.append(head[1:], len(text))[:len(head)] - 1
    spans = pa.StructArray.from_arrays(
        [pa.array(names[label[head]], pa.string()), pa.array(start[head], pa.int64()), pa.array(end[tail], pa.int64())],
        ["lang", "start", "end"])
    offsets = np.concatenate(([0], np.cumsum(np.bincount(text[head], minlength=n)))).astype(np.int32)
    return [pa.array(predicted, pa.string()), pa.array(share, pa.float64()), pa.ListArray.from_arrays(offsets, spans)]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             penalty: float = 8.0) -> DataFrame:
    """(id, lang_pred, score, spans) of every row of ``docs``; one pass, no shuffle.

    lang_pred is a learned language, or ``und`` with score 0 for null texts and texts without letters (or if nothing
    was learned).  score is the share of all letters that is labelled lang_pred, 0 if no letter is in a learned
    language's script; it does not tell how well a language fits.  spans holds lang and code-point
    positions (end exclusive) of each stretch.  Ties go to the language first in order.  Repeated rows are
    labelled alike; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_p, model.uses))

    def labelled(batches):
        own = Model(*shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if not own.languages:
                texts = [""] * len(texts)
            for a, b in runs([len(t) for t in texts], GROUP):
                out = _labelled(texts[a:b], own if own.languages else NOTHING, penalty)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), *out],
                                                 ["id", "lang_pred", "score", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        labelled, f"id {kind}, lang_pred string, score double, spans array<struct<lang:string,start:long,end:long>>")


NOTHING = Model(["und"], np.zeros((1, 1 << BITS), np.float32), np.ones((len(NAMES), 1), bool))
