"""Hashed word and character n-gram features of whole batches of tokens."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .runtime import clean

#: Marks put around a token before its n-grams are taken (code points that no text uses).
LEFT, RIGHT = 0x10FFFE, 0x10FFFF


def ngrams(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the tokens' features, and to which token each belongs.

    A token's features are the whole token and its n-grams, marks included, of
    the given sizes; a token always has at least the first.
    """
    size = end - begin
    wide = size + 2
    first = np.cumsum(wide) - wide
    flat = np.empty(int(wide.sum()), np.uint32)
    inner = np.repeat(first + 1 - (np.cumsum(size) - size), size) + np.arange(size.sum())
    flat[inner] = codes[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    flat[first], flat[first + wide - 1] = LEFT, RIGHT
    salt = tv.salts()[flat]
    token = np.repeat(np.arange(len(begin)), wide)
    room = np.repeat(first + wide, wide) - np.arange(len(flat))
    which, found = [np.arange(len(begin))], [tv.hashes(flat, first + 1, first + wide - 1, seed=1)]
    for n in sizes:
        at = np.flatnonzero(room >= n)
        h = np.zeros(len(at), np.uint64)
        for j in range(n):
            h += salt[at + j] * tv.POWERS[j]
        which.append(token[at])
        found.append(tv.mix(h + np.uint64(n)))
    return (np.concatenate(found) % np.uint64(buckets)).astype(np.int64), np.concatenate(which)


def training_rows(labelled: DataFrame, rows: int, chars: int, seed: int = 7) -> list[tuple[int, str, object]]:
    """A bounded, reproducible sample of (doc_id, text, label): at most `rows` rows and `chars` characters.

    Rows are taken in the order of a hash of doc_id, then of their text and
    label, until either bound is met; the same table always gives the same
    sample, whatever its partitions. At least one row is taken.
    """
    key = [F.xxhash64(F.lit(seed), "doc_id").alias("o"), F.col("doc_id"), F.xxhash64("text", F.col("label").cast("string")).alias("h")]
    sized = labelled.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).select(*key, F.length(F.coalesce("text", F.lit(""))).alias("n"), "label", "text")
    heads = sized.select("o", "doc_id", "h", "n").orderBy("o", "doc_id", "h").limit(rows).collect()
    total, taken = 0, 0
    for r in heads:
        total += r["n"]
        if total > chars and taken:
            break
        taken += 1
    if not taken:
        return []
    last = F.struct(*(F.lit(heads[taken - 1][c]).cast("long").alias(c) for c in ("o", "doc_id", "h")))
    got = sized.where(F.struct("o", F.col("doc_id").cast("long").alias("doc_id"), "h") <= last).orderBy("o", "doc_id", "h").limit(taken)
    return [(r["doc_id"], r["text"] or "", r["label"]) for r in got.select("doc_id", "text", "label").collect()]


def remainder(by: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo `by`; null where the id is null."""
    return F.crc32(F.col(column).cast("string")) % by


def documents(docs: DataFrame) -> DataFrame:
    return clean(docs, "doc_id", "text")
