"""Runs of periodic words, by a suffix automaton with link-cut access.

A run is a stretch of words with smallest period q that no neighbouring word extends.  The automaton's links make
a tree of all substrings by where they end.  Word after word, the path from the state of the text so far to the
root is accessed and recoloured with the word's number, so every node knows where its substrings ended last.  The
path falls into segments of one colour; the deepest node of a segment with colour j at word i says how long the
texts ending at i and at j are equal (at most), and if that reaches back over the distance i - j, a square ends at
i.  The common length is the extension to the left; the run is reported at the word where it ends.  Since the
colours are the last occurrences, the distance of a run that is repeated enough is its smallest period.

Paths are kept as splay trees (a link-cut tree without cuts of links), so a text of n words takes O(n log n) steps.

Stretches that can hold a run are found first: every three words of a run of p periods stand p - 1 times in the
text.  All else is left out without a look, and no run is lost.  Memory is bounded by the longest such stretch of
one text, not by a batch or partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from auditloom.llm.chars import runs as parts

PART = 1 << 22


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Link and length of each state, and the state of each prefix; state 0 is the root and has link -1.

    Most states have one way on; it is kept in two flat lists, further ones in a table of the state.
    """
    link, length, word, to, ends = [-1], [0], [-1], [0], []
    more: dict[int, dict[int, int]] = {}
    last = 0
    for c in words:
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        word.append(-1)
        to.append(0)
        p, q = last, -1
        while p >= 0:
            if word[p] == c:
                q = to[p]
                break
            if word[p] < 0:
                word[p], to[p] = c, new
            else:
                others = more.setdefault(p, {})
                q = others.get(c, -1)
                if q >= 0:
                    break
                others[c] = new
            p = link[p]
        if q >= 0:
            if length[p] + 1 < length[q]:
                copy = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                word.append(word[q])
                to.append(to[q])
                if q in more:
                    more[copy] = more[q].copy()
                link[q] = copy
                while p >= 0:
                    if word[p] == c and to[p] == q:
                        to[p] = copy
                    elif p in more and more[p].get(c) == q:
                        more[p][c] = copy
                    else:
                        break
                    p = link[p]
                q = copy
            link[new] = q
        ends.append(new)
        last = new
    return link, length, ends


def periodic(words: list[int], least_words: int, least_periods: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least so many words and periods (2 or more), by end."""
    link, length, ends = automaton(words)
    # Nodes are states plus one; 0 is none.  Shallower nodes of a path are to the left.
    up, left, right = [0, *(x + 1 for x in link)], [0] * (len(link) + 1), [0] * (len(link) + 1)
    seen = [-1] * (len(link) + 1)  # of the root of a splay tree: where the substrings of its path ended last
    found, final = [], len(words) - 1

    def rotate(x: int) -> None:
        p = up[x]
        g = up[p]
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        if left[p] == x:
            child = left[p] = right[x]
            right[x] = p
        else:
            child = right[p] = left[x]
            left[x] = p
        if child:
            up[child] = p
        up[p], up[x] = x, g

    for i, state in enumerate(ends):
        x, below = state + 1, 0
        while x:
            top = x
            while left[up[top]] == top or right[up[top]] == top:
                top = up[top]
                if not up[top]:
                    break
            j = seen[top]
            p = up[x]
            while left[p] == x or right[p] == x:
                g = up[p]
                if left[g] == p or right[g] == p:
                    rotate(p if (left[g] == p) == (left[p] == x) else x)
                rotate(x)
                p = up[x]
            if j >= 0:
                size, distance = length[x - 1], i - j
                if (distance <= size and size + distance >= max(least_words, least_periods * distance)
                        and (i == final or words[i + 1] != words[i + 1 - distance])):
                    found.append((i - size - distance + 1, size + distance, distance))
            deeper = right[x]
            if deeper:
                seen[deeper] = j
            right[x] = below
            below, x = x, p
        seen[below] = i
    return found


def stretches(ids: np.ndarray, least_words: int, least_periods: int) -> Iterator[tuple[int, int]]:
    """Ranges of words in which all three words in a row stand as often as in a run."""
    often = min(least_periods - 1, least_words - 2)
    if len(ids) < least_words:
        return
    if often < 2:
        yield 0, len(ids)
        return
    _, pair = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)
    _, triple, n = np.unique(pair[:-1] * len(ids) + ids[2:], return_inverse=True, return_counts=True)
    dense = np.concatenate(([False], n[triple] >= often, [False]))
    edges = np.flatnonzero(dense[1:] != dense[:-1])
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a + 2 >= least_words:
            yield a, b + 2


def word_runs(words: list[bytes], least_words: int = 6, least_periods: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text, by start, then period."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    found = []
    for a, b in stretches(ids, least_words, least_periods):
        found += [(a + s, n, q) for s, n, q in periodic(ids[a:b].tolist(), least_words, least_periods)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, without those that a run holds after its first period."""
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        steps[start + period] += 1
        steps[start + length] -= 1
    return b" ".join(w for w, over in zip(words, np.cumsum(steps).tolist()) if not over) if found else b" ".join(words)


def word_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 6,
                 least_periods: int = 4) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row of ``docs``; one pass, no shuffle.

    Words are stretches without ASCII white space.  runs: array of (start, length, period) of all runs of
    ``least_words`` words and ``least_periods`` periods or more, in words from 0, by start, then period.  collapsed:
    the words joined by one space, without those after the first period of a run.  Null and empty texts have no
    words, no runs and an empty collapsed text.  Repeated rows are treated alike; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in parts([len(t.as_buffer() or b"") if t.is_valid else 0 for t in texts], PART):
                sizes, every, left = [], [], []
                for text in texts.slice(a, b - a):
                    words = (text.as_py() or b"").split()
                    own = word_runs(words, least_words, least_periods)
                    sizes.append(len(words))
                    every.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                    left.append(collapsed(words, own))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(every, RUNS),
                     pa.array(left, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
