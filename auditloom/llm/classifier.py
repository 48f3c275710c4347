"""Quality classifier: supervised subword embeddings.

A document's features are its words, its pairs of neighbouring words and the character trigrams of its words,
each hashed to one of 2 ** BITS places with a learned vector.  The document is the mean of the vectors of its
features, and a softmax layer gives the chances of both labels.  A pair of words is hashed from the difference
of the words' hashes, so that every word followed by itself is one feature.

Vectors and layer are trained by stochastic gradient descent in numpy: the training sample is cut into shards,
every Spark task walks its shards from the current model, and the mean of their models starts the next round.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from auditloom.functions.session import materialise
from auditloom.llm.chars import code_points, mixed, runs
from auditloom.llm.langid import bounded

BITS = 15
DIM = 16
PART = 500_000  # code points worked on at once
SPACE = np.zeros(0x110000, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
STEP = np.uint64(0x100000001B3)


@dataclass
class Model:
    vectors: np.ndarray  # (place, dim)
    layer: np.ndarray  # (dim, 2)
    bias: np.ndarray  # (2,)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Place and text number of every feature of the texts."""
    flat, offsets = code_points(texts)
    space = SPACE[flat]
    chars = np.where(space, 0, flat).astype(np.uint64)
    at = np.flatnonzero(~space)
    if not len(at):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    before = np.where(at > 0, chars[at - 1], 0)
    trigram = mixed(chars[at] << np.uint64(42) ^ before << np.uint64(21) ^ chars[at + 1], BITS)
    text = np.searchsorted(offsets, at, "right") - 1
    start = np.flatnonzero(before == 0)
    inside = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
    powers = np.multiply.accumulate(np.full(int(inside.max()) + 1, STEP, np.uint64))
    word = np.add.reduceat(chars[at] * powers[inside], start)
    of_word = text[start]
    pair = np.flatnonzero(of_word[1:] == of_word[:-1])
    salt = np.uint64(0x5851F42D4C957F2D)
    return (np.concatenate([trigram, mixed(word, BITS), mixed((word[pair + 1] - word[pair]) ^ salt, BITS)]),
            np.concatenate([text, of_word, of_word[pair]]))


def _bags(batches):
    """Per labelled document: distinct places and their shares."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in runs([len(t) for t in texts], PART):
            place, text = features(texts[a:b])
            key, n = np.unique(text << BITS | place, return_counts=True)
            doc = key >> BITS
            total = np.bincount(doc, n, b - a)
            ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=b - a)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("mark").slice(a, b - a), batch.column("label").slice(a, b - a),
                 pa.ListArray.from_arrays(ends, pa.array((key & ((1 << BITS) - 1)).astype(np.int32))),
                 pa.ListArray.from_arrays(ends, pa.array((n / total[doc]).astype(np.float32)))],
                ["mark", "label", "places", "shares"])


def _sum_rows(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of ``values`` with equal keys, and the keys."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return np.add.reduceat(values[order], start, axis=0), keys[start]


def descend(model: Model, labels, places: list[np.ndarray], shares: list[np.ndarray], rate: float,
            batch: int = 32) -> Model:
    """One pass of minibatch gradient descent over documents, with steps scaled by the gradients seen (AdaGrad)."""
    vectors, layer, bias = model.vectors.copy(), model.layer.copy(), model.bias.copy()
    seen, seen_layer = np.full(len(vectors), 1e-8, np.float32), 1e-8
    for a in range(0, len(labels), batch):
        own = slice(a, min(a + batch, len(labels)))
        sizes = np.array([len(p) for p in places[own]])
        place, share = np.concatenate(places[own]), np.concatenate(shares[own])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        mean = np.zeros((len(sizes), DIM), np.float32)
        some = np.flatnonzero(sizes)
        if len(some):
            begin = (np.cumsum(sizes) - sizes)[some]
            mean[some] = np.add.reduceat(vectors[place] * share[:, None], begin, axis=0)
        z = mean @ layer + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(sizes)), labels[own]] -= 1
        back = (p @ layer.T).astype(np.float32)
        grown = mean.T @ p / len(sizes)
        seen_layer += float((grown ** 2).mean())
        layer -= (rate * grown / np.sqrt(seen_layer)).astype(np.float32)
        bias -= rate * p.mean(0).astype(np.float32)
        if len(place):
            g, at = _sum_rows(back[doc] * share[:, None], place)
            seen[at] += (g ** 2).mean(1)
            vectors[at] -= rate * g / np.sqrt(seen[at])[:, None]
    return Model(vectors, layer, bias)


def _packed(m: Model) -> bytes:
    return np.concatenate([m.vectors.ravel(), m.layer.ravel(), m.bias]).astype(np.float32).tobytes()


def _unpacked(data) -> Model:
    x = np.frombuffer(data, np.float32)
    n = (1 << BITS) * DIM
    return Model(x[:n].reshape(-1, DIM).copy(), x[n:n + 2 * DIM].reshape(DIM, 2).copy(), x[-2:].copy())


def _walk(shared, rate: float):
    """A function that walks a shard from the broadcast model and gives the new one."""
    def walked(shard):
        t = shard.sort_by("mark")
        label, places, shares = (t.column(c).to_pylist() for c in ("label", "places", "shares"))
        m = descend(_unpacked(shared.value), np.array(label), [np.array(x, np.int32) for x in places],
                    [np.array(x, np.float32) for x in shares], rate)
        return pa.table({"n": [t.num_rows], "model": pa.array([_packed(m)], pa.binary())})
    return walked


def train(docs: DataFrame, labels: DataFrame, label_col: str, max_docs: int = 6_000, rounds: int = 8,
          shards: int = 4, rate: float = 0.2) -> Model:
    """A model of label 1 against 0, from ``docs`` (doc_id, text) and ``labels`` (doc_id, ``label_col``).

    Learned from at most ``max_docs`` labelled rows, chosen by a hash of doc_id, so the labels that are sent
    to the documents are bounded; null labels are left out, and of repeated ids the highest label counts.
    Shards and their order are fixed by the hash, so that the same rows give the same model.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(label_col).cast("int").alias("label"))
    chosen = F.broadcast(bounded(known, max_docs))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(chosen, "doc_id").select(
        F.xxhash64(F.lit(7), "doc_id", "text").alias("mark"), "label", "text")
    bags = materialise(rows.mapInArrow(_bags, "mark long, label int, places array<int>, shares array<float>"),
                       "classifier-bags")
    spark = docs.sparkSession
    rng = np.random.default_rng(1)
    model = Model(((rng.random((1 << BITS, DIM)) - 0.5) / DIM).astype(np.float32),
                  ((rng.random((DIM, 2)) - 0.5) / DIM).astype(np.float32), np.zeros(2, np.float32))
    for k in range(rounds):
        shared, step = spark.sparkContext.broadcast(_packed(model)), rate * (1 - k / rounds)
        parts = bags.groupBy(F.pmod("mark", F.lit(shards))).applyInArrow(
            _walk(shared, step), "n long, model binary").collect()  # one model of fixed size for each shard
        if not parts:
            break
        total = sum(p.n for p in parts)
        summed = sum(np.frombuffer(p.model, np.float32).astype(np.float64) * (p.n / total)
                     for p in sorted(parts, key=lambda p: (p.n, bytes(p.model))))
        model = _unpacked(summed.astype(np.float32).tobytes())
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row of ``docs``: the chance of label 1, between 0 and 1.

    Null and empty texts have no features and get the chance that the bias gives.  One pass without shuffle;
    repeated rows score alike; other columns are not read.  As the layer is linear, the mean of the vectors
    through it is the mean of each vector through it, which is looked up.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    lean = (model.vectors @ (model.layer[:, 1] - model.layer[:, 0])).astype(np.float64)
    shared = docs.sparkSession.sparkContext.broadcast((lean, float(model.bias[1] - model.bias[0])))

    def scored(batches):
        lean, bias = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            out = np.zeros(len(texts))
            for a, b in runs([len(t) for t in texts], PART):
                place, text = features(texts[a:b])
                n = np.bincount(text, minlength=b - a)
                out[a:b] = np.bincount(text, lean[place], b - a) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(1 / (1 + np.exp(-(out + bias))))],
                                             ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        scored, f"id {kind}, score double")
