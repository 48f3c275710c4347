"""Texts of an Arrow batch as flat numpy arrays of code points, and the stated train/held-out split."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import Column, functions as F

WORD = r"[^\x20\x09-\x0D]+"


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents whose crc32(doc_id as text) mod 3 is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def learned_from(doc_id: str = "doc_id") -> Column:
    """True for documents that may be learned from; a null id may not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 != 1, F.lit(False))


def runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items whose sizes add up to ``most`` or that hold one item."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by a line feed, and where each text starts (one more at the end)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    flat = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
    return flat, np.concatenate(([0], np.cumsum(sizes)))


@cache
def lower_letters() -> np.ndarray:
    """For each code point its lower-case form if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def mixed(key: np.ndarray, bits: int) -> np.ndarray:
    """Top ``bits`` of a multiplicative hash of 64-bit keys, as indices."""
    key = key ^ (key >> np.uint64(31))
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)
