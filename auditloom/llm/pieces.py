"""SentencePiece encoding and decoding with a given vocabulary.

An Aho-Corasick automaton over the bytes of the pieces drives one pass of Viterbi over a text: after each byte
the output links name every piece that ends there, longest first, and each relaxes the best score of that
position.  No piece of the vocabulary holds a space mark after another character, and none a line feed, so the
best segmentation of a text is that of its words side by side; the words of a block of texts are segmented
once each, all advancing together in numpy arrays.

Characters without a piece of their own fall back to byte pieces.  A literal space mark (U+2581) does so too,
so that decoding gives back exactly the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession, functions as F

from auditloom.llm.chars import runs

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, LITERAL = "▁".encode(), b"\xf8\xf9\xfa"  # the literal mark stands as three bytes that UTF-8 lacks
WORDS = re.compile(rb" *[^ \n]+| +|\n")
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6  # kinds of pieces in a model file
BLOCK = 1_000_000
FALLBACK = 10.0  # a character without a piece costs this much more than the worst piece


class Vocabulary:
    """Pieces, scores and kinds of a model file, in the order of their ids."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int]):
        self.pieces, self.scores, self.kinds = pieces, scores, kinds
        for p, k in zip(pieces, kinds):
            if k in (NORMAL, USER) and (not re.fullmatch("▁*[^▁\n]*", p) or not p):
                raise ValueError(f"piece {p!r} holds a space mark or a line feed inside")
        if sum(k == BYTE for k in kinds) != 256:
            raise ValueError("a vocabulary with 256 byte pieces is needed")

    @classmethod
    def read(cls, path: str = MODEL) -> Vocabulary:
        """From a model file that the driver can open; it is small and goes to the executors as a broadcast."""
        from sentencepiece import sentencepiece_model_pb2 as pb
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        return cls([p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type for p in model.pieces])


class Automaton:
    """Dense Aho-Corasick automaton over the bytes of the pieces."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        children: list[dict[int, int]] = [{}]
        piece = [-1]
        normal = [i for i, k in enumerate(v.kinds) if k in (NORMAL, USER)]
        for i in normal:
            node = 0
            for b in v.pieces[i].encode():
                at = children[node].get(b)
                if at is None:
                    at = children[node][b] = len(children)
                    children.append({})
                    piece.append(-1)
                node = at
            piece[node] = i
        n = len(children)
        self.goto = np.zeros((n, 256), np.uint16 if n <= 1 << 16 else np.int32)
        fail, order = np.zeros(n, np.int32), [0]
        for node in order:  # grows while it is walked: breadth first
            row, back = self.goto[node], fail[node]
            if node:
                row[:] = self.goto[back]
            for b, child in children[node].items():
                fail[child] = row[b] if node else 0
                row[b] = child
                order.append(child)
        self.first = np.zeros(n, np.int32)  # the longest piece that ends in a state, as its node; 0: none
        self.next = np.zeros(n, np.int32)
        self.single = np.zeros(n, bool)  # a piece of one character ends here
        sizes = np.array([len(v.pieces[i].encode()) if i >= 0 else 0 for i in piece], np.int32)
        for node in order[1:]:
            self.next[node] = self.first[fail[node]]
            own = piece[node] >= 0
            self.first[node] = node if own else self.next[node]
            self.single[node] = own and len(v.pieces[piece[node]]) == 1 or self.single[self.next[node]]
        self.piece, self.size = np.array(piece, np.int32), sizes
        self.score = np.array([v.scores[i] if i >= 0 else 0.0 for i in piece])
        self.fallback = min((v.scores[i] for i in normal), default=0.0) - FALLBACK
        self.byte_id = np.zeros(256, np.int32)
        for i, k in enumerate(v.kinds):
            if k == BYTE:
                self.byte_id[int(v.pieces[i][1:-1], 16)] = i
        self.byte_id[list(LITERAL)] = self.byte_id[list(MARK)]
        self.goes_on = np.array([0x80 <= b < 0xC0 or b in LITERAL[1:] for b in range(256)] + [False])

    def segment(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all words, one after another, and the number of pieces of each word.

        Of segmentations with equal scores the one with the longer last piece is taken, from the end on.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        begin = (np.cumsum(sizes) - sizes)[order]
        flat = np.frombuffer(b"".join(words), np.uint8)
        base = begin + order  # a word of n bytes has n + 1 positions
        best = np.full(len(flat) + len(words), -np.inf)
        best[base] = 0.0
        ids, steps = np.zeros(len(best), np.int32), np.ones(len(best), np.int32)
        going = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), "left")
        state, lead = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
        for t, k in enumerate(going):
            byte = flat[begin[:k] + t]
            state[:k] = self.goto[state[:k], byte]
            now = state[:k]
            to = base[:k] + t + 1
            ids[to] = self.byte_id[byte]
            lead[:k] = np.where(self.goes_on[byte], lead[:k], t)
            follows = np.full(k, 256)
            more = going[t + 1] if t + 1 < len(going) else 0
            follows[:more] = flat[begin[:more] + t + 1]
            at, node = np.arange(k), self.first[now]
            while True:
                some = node > 0
                at, node = at[some], node[some]
                if not len(at):
                    break
                value = best[to[at] - self.size[node]] + self.score[node]
                better = value > best[to[at]]
                hit, won = to[at[better]], node[better]
                best[hit], ids[hit], steps[hit] = value[better], self.piece[won], self.size[won]
                node = self.next[node]
            bare = np.flatnonzero(~self.goes_on[follows] & ~self.single[now])
            value = best[base[bare] + lead[bare]] + self.fallback
            better = value > best[to[bare]]
            hit = to[bare[better]]
            best[hit], ids[hit], steps[hit] = value[better], self.byte_id[byte[bare[better]]], 1
        counts, at, taken = np.zeros(len(words), np.int64), sizes[order].copy(), []
        live = np.flatnonzero(at)
        while len(live):
            spot = base[live] + at[live]
            taken.append((live, ids[spot]))
            counts[live] += 1
            at[live] -= steps[spot]
            live = live[at[live] > 0]
        in_order = np.zeros(len(words), np.int64)
        in_order[order] = counts
        ends = np.cumsum(in_order)[order] - 1
        out = np.zeros(int(counts.sum()), np.int32)
        for k, (live, found) in enumerate(taken):
            out[ends[live] - k] = found
        return out, in_order


def _flat(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Slices of ``values`` one after another."""
    shift = starts - (np.cumsum(sizes) - sizes)
    return values[np.repeat(shift, sizes) + np.arange(sizes.sum())]


def encode_batch(automaton: Automaton, batch: pa.Array) -> Iterator[pa.ListArray]:
    """Piece ids of texts (binary), in blocks; null for null."""
    for a, b in runs(pc.binary_length(batch).fill_null(0).to_pylist(), BLOCK):
        texts = batch.slice(a, b - a).to_pylist()
        words, number = [], np.zeros(b - a, np.int64)
        for i, t in enumerate(texts):
            if t:
                own = WORDS.findall(b" " + t.replace(MARK, LITERAL))
                number[i] = len(own)
                words += own
        coded = pa.array(words, pa.large_binary()).dictionary_encode()
        distinct = [w.replace(b" ", MARK) for w in coded.dictionary.to_pylist()]
        index = coded.indices.to_numpy()
        ids, counts = automaton.segment(distinct)
        each = counts[index]
        flat = _flat(ids, (np.cumsum(counts) - counts)[index], each)
        ends = np.concatenate(([0], np.cumsum(each)))[np.cumsum(number)]
        offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32),
                           mask=np.array([t is None for t in texts] + [False]))
        yield pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))


_SHARED: dict = {}


def _own(shared, make):
    """What a worker process makes of a broadcast vocabulary, made once."""
    pieces, scores, kinds = shared.value
    key = hash((tuple(pieces), tuple(scores), tuple(kinds))), make
    if key not in _SHARED:
        _SHARED[key] = make(Vocabulary(pieces, scores, kinds))
    return _SHARED[key]


def encode(spark: SparkSession, text: Column, vocabulary: Vocabulary) -> Column:
    """Piece ids of a text column as array<int>, with a space mark before the first word as the model asks.

    Null gives null, an empty text no piece.  Whole texts, whatever their length.
    """
    shared = spark.sparkContext.broadcast((vocabulary.pieces, vocabulary.scores, vocabulary.kinds))

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _own(shared, Automaton)
        for batch in batches:
            yield from encode_batch(automaton, batch)  # in parts: nothing of a batch's size is held

    return encoded(text.cast("binary"))


class Texts:
    """Bytes of every piece, for decoding."""

    def __init__(self, v: Vocabulary):
        def text(piece: str, kind: int) -> bytes:
            if kind == BYTE:
                return bytes([int(piece[1:-1], 16)])
            return {UNKNOWN: " ⁇ ".encode()}.get(kind, piece.replace("▁", " ").encode()
                                                     if kind in (NORMAL, USER) else b"")
        all_of = [text(p, k) for p, k in zip(v.pieces, v.kinds)]
        self.flat = np.frombuffer(b"".join(all_of), np.uint8)
        self.size = np.array([len(t) for t in all_of], np.int64)
        self.start = np.cumsum(self.size) - self.size


def decode_batch(texts: Texts, batch: pa.ListArray) -> Iterator[pa.Array]:
    """Texts of lists of ids, in blocks; a leading space goes.  Bytes that are no UTF-8 become U+FFFD."""
    sizes = batch.value_lengths().fill_null(0).to_numpy()
    for a, b in runs(sizes.tolist(), BLOCK // 2):
        part = batch.slice(a, b - a)
        ids = part.flatten().to_numpy(zero_copy_only=False)
        flat = _flat(texts.flat, texts.start[ids], texts.size[ids]).tobytes()
        ends = np.concatenate(([0], np.cumsum(texts.size[ids])))[np.concatenate(([0], np.cumsum(sizes[a:b])))]
        known = part.is_valid().to_pylist()
        yield pa.array([flat[s + (flat[s:s + 1] == b" "):e].decode(errors="replace") if ok else None
                        for s, e, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), known)], pa.string())


def decode(spark: SparkSession, pieces: Column, vocabulary: Vocabulary) -> Column:
    """The text of a column of piece ids; the exact inverse of ``encode``.

    Null gives null, no pieces the empty text.  Ids must be ids of the vocabulary without null items.
    """
    shared = spark.sparkContext.broadcast((vocabulary.pieces, vocabulary.scores, vocabulary.kinds))

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        texts = _own(shared, Texts)
        for batch in batches:
            yield from decode_batch(texts, batch)

    return decoded(pieces)


@cache
def vocabulary(path: str = MODEL) -> Vocabulary:
    return Vocabulary.read(path)
