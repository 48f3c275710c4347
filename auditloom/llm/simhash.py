"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments (22, 21 and 21 bits).  If two fingerprints differ in at most
two bits, one segment is equal in both (pigeonhole) and the next one differs in at most two bits.  The perfect
(23,12) Golay code sends each 23-bit word to one codeword within distance 3; the codewords reached from a word
and from all words one bit away are its keys (one or six).  Two words at distance two have a word between them
whose codeword both reach, so they share a key.  A candidate key therefore joins an equal segment with a
codeword index of the next one, about 16 keys a fingerprint, and misses no link.

Fingerprints that meet no other one in any key are done.  The others are verified without pairs: each is sent
to the 65 words within one bit of it, and those that meet in a word are within two bits of each other.  At most
65 fingerprints can meet in a word, so no group grows with the data, and all links are found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from auditloom.functions.session import materialise
from auditloom.llm.components import connected

SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, bits)
GOLAY = 0xC75  # generator x^11+x^10+x^6+x^5+x^4+x^2+1
BLOCK = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _blocks(text: bytes) -> Iterator[list[bytes]]:
    """Lower-cased (A-Z only) words of a text, a block of about 1 MB at a time."""
    at = 0
    while at < len(text):
        cut = SPACE.search(text, at + BLOCK) if at + BLOCK < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end].lower().split()
        at = end


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash over shingles of ``width`` words: bit set if set in over half of the XXH64 hashes; none: 0."""
    bits, n, words = np.zeros(64, np.int64), 0, []
    for block in _blocks(text or b""):
        words += block
        count = len(words) - width + 1
        if count > 0:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
            h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, count)
            for k in range(0, count, 1 << 16):
                part = np.unpackbits(h[k:k + (1 << 16)].view(np.uint8), bitorder="little")
                bits += part.reshape(-1, 64).sum(0, dtype=np.int64)
            n, words = n + count, words[count:]
    if not n and words:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
        bits, n = np.unpackbits(h.view(np.uint8), bitorder="little").astype(np.int64), 1
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0])


def _fingerprinted(batches):
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the 64-bit fingerprint as a long."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        _fingerprinted, f"id {kind}, fp long")


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and the high 11 bits by the generator, and the error word of each remainder."""
    def rest(v: int) -> int:
        for k in range(22, 10, -1):
            if v >> k & 1:
                v ^= GOLAY << (k - 11)
        return v
    low = np.array([rest(v) for v in range(1 << 12)], np.int32)
    high = np.array([rest(v << 12) for v in range(1 << 11)], np.int32)
    ones = [1 << k for k in range(23)]
    errors = np.zeros(1 << 11, np.int32)
    for word in [0, *ones, *(a | b for a in ones for b in ones if a < b),
                 *(a | b | c for a in ones for b in ones for c in ones if a < b < c)]:
        errors[rest(word)] = word
    return low, high, errors


def codeword_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword within distance 3 of each 23-bit word."""
    low, high, errors = _syndromes()
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and key of every candidate key of the fingerprints (int64)."""
    rows, keys = [], []
    parts = [((fps.view(np.uint64) >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    for i in range(3):
        j = (i + 1) % 3
        flips = np.concatenate(([0], 1 << np.arange(SEGMENTS[j][1])))
        index = np.sort(codeword_index((parts[j][:, None] ^ flips).astype(np.int32)), axis=1)
        first = np.ones(index.shape, bool)
        first[:, 1:] = index[:, 1:] != index[:, :-1]
        row, col = np.nonzero(first)
        rows.append(row)
        keys.append(i << 40 | parts[i][row] << 12 | index[row, col].astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches):
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        for k in range(0, len(fps), 20_000):
            row, key = golay_keys(fps[k:k + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[k:k + 20_000][row])], ["key", "fp"])


def links(fps: DataFrame) -> DataFrame:
    """(a, b): a star of links for every word in which distinct fingerprints (``fp``) meet.

    Together the stars connect exactly the fingerprints that chains of links of at most two bits connect.
    """
    keyed = materialise(fps.mapInArrow(_keyed, "key long, fp long"), "golay-keys")
    shared = keyed.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("key")
    candidates = keyed.join(shared, "key", "left_semi").select("fp").distinct()
    near = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.expr("fp").bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    met = candidates.select("fp", F.explode(near).alias("word")).groupBy("word").agg(
        F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return met.select("a", F.explode("all").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component, kept) of every row of ``docs``.

    component: least id reachable over fingerprints that differ in at most two bits, a row's own included;
    kept: the row has that id.  Null and empty texts have fingerprint 0 and are linked like any other.  Null ids
    are never a component's least id unless it has no other; then the component is null and its rows are kept.
    Rows with equal ids are kept or left together.  Other columns of ``docs`` are not read.
    """
    prints = materialise(fingerprints(docs, id_col, text_col), "simhash")
    first = materialise(prints.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    roots = connected(links(first.select("fp")))
    joined = materialise(first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = joined.groupBy("root").agg(F.min("first").alias("component"))
    known = materialise(joined.join(least, "root").select("fp", "component"), "simhash-components")
    return prints.join(known, "fp").select("id", "fp", "component",
                                           F.col("id").eqNullSafe(F.col("component")).alias("kept"))
