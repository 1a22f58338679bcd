"""Quality classifier: learned hashed word and character n-gram vectors, averaged per document, softmax output.

Trained by stochastic gradient descent in numpy on a bounded sample of labelled
rows. A document's vector is an average, so what a feature adds to the logit is
one number, worked out once after training; scoring adds these numbers up over
the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .runtime import boxed, chunks, ready, trim, unboxed
from .subwords import documents, ngrams, remainder, training_rows

THRESHOLD = 0.3
#: Bounds of the training sample.
ROWS, CHARS = 4000, 16_000_000


@dataclass(frozen=True)
class Shape:
    """Sizes of the model: n-gram sizes, feature buckets, vector width, passes over the sample, step size, seed."""

    sizes: tuple[int, ...] = (3, 4)
    buckets: int = 1 << 17
    width: int = 8
    epochs: int = 8
    rate: float = 0.3
    batch: int = 32
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """What each bucket adds to the logit of label 1, the bias, and the shape."""

    adds: np.ndarray
    bias: float
    shape: Shape


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points, begin and end of each run without white space, and each text's first token (one more at the end)."""
    codes, starts = tv.points(texts)
    begin, end = tv.spans(tv.classes()[codes] != tv.SPACE)
    return codes, begin, end, np.append(np.searchsorted(begin, starts), len(begin))


def pairs(h: np.ndarray, cut: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the word pairs, and to which text each belongs.

    A word after itself is the same feature for all words, and so is a pair
    that its text has had before: repetition is learned once, not word by word.
    """
    if len(h) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    at = np.flatnonzero(text[:-1] == text[1:])
    own = tv.mix(h[at] * tv.POWERS[1] + h[at + 1])
    found = (own % np.uint64(buckets)).astype(np.int64)
    key = own + tv.mix(text[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    found[order[1:][key[order[1:]] == key[order[:-1]]]] = 1
    found[h[at] == h[at + 1]] = 0
    return found, text[at]


def features(texts: list[str], shape: Shape) -> list[tuple[np.ndarray, np.ndarray]]:
    """For training: each text's buckets and their shares of its features, as small as they can be, since all texts' stay in memory."""
    out = []
    for a, b in chunks(texts):
        codes, begin, end, cut = tokens(texts[a:b])
        own, token = ngrams(codes, begin, end, shape.sizes, shape.buckets)
        two, text = pairs(tv.hashes(codes, begin, end), cut, shape.buckets)
        doc = np.concatenate([np.repeat(np.arange(b - a), np.diff(cut))[token], text])
        found, times = np.unique(doc * shape.buckets + np.concatenate([own, two]), return_counts=True)
        edge = np.searchsorted(found, np.arange(b - a + 1) * shape.buckets)
        for i in range(b - a):
            n = times[edge[i] : edge[i + 1]]
            out.append(((found[edge[i] : edge[i + 1]] - i * shape.buckets).astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    return out


def train(rows: list[tuple[int, str, object]], shape: Shape = Shape()) -> Model:
    """Gradient descent with steps scaled by past gradients. Without rows every score is one half."""
    rng = np.random.default_rng(shape.seed)
    vectors = rng.uniform(-1, 1, (shape.buckets, shape.width)) / shape.width
    out, bias = np.zeros((2, shape.width)), np.zeros(2)
    past, past_out, past_bias = np.full(vectors.shape, 1e-6), np.full(out.shape, 1e-6), np.full(2, 1e-6)
    truth = np.array([int(y) for *_, y in rows], np.int64)
    known = features([t for _, t, _ in rows], shape)
    for _ in range(shape.epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), shape.batch):
            own = order[k : k + shape.batch]
            at = np.concatenate([known[i][0] for i in own])
            share = np.concatenate([known[i][1] for i in own])
            doc = np.repeat(np.arange(len(own)), [len(known[i][0]) for i in own])
            gathered = vectors[at] * share[:, None]
            mean = np.stack([np.bincount(doc, gathered[:, j], len(own)) for j in range(shape.width)], axis=1)
            logit = mean @ out.T + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), truth[own]] -= 1
            p /= len(own)
            back = (p @ out)[doc] * share[:, None]
            used, where = np.unique(at, return_inverse=True)
            step = np.stack([np.bincount(where, back[:, j], len(used)) for j in range(shape.width)], axis=1)
            past[used] += step**2
            vectors[used] -= shape.rate * step / np.sqrt(past[used])
            for value, seen, g in ((out, past_out, p.T @ mean), (bias, past_bias, p.sum(axis=0))):
                seen += g**2
                value -= shape.rate * g / np.sqrt(seen)
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]), shape)


def score_texts(texts: list[str], model: Model, memo: tv.Memo) -> np.ndarray:
    """Probability of label 1 for each whole text."""
    scores = np.empty(len(texts))
    for a, b in chunks(texts):
        codes, begin, end, cut = tokens(texts[a:b])
        h = tv.hashes(codes, begin, end)

        def make(at: np.ndarray, codes=codes, begin=begin, end=end) -> np.ndarray:
            own, token = ngrams(codes, begin[at], end[at], model.shape.sizes, model.shape.buckets)
            return np.stack([np.bincount(token, model.adds[own], len(at)), np.bincount(token, minlength=len(at))], axis=1)

        rows = memo.get(h, make) if len(h) else np.zeros((0, 2), np.float32)
        two, text = pairs(h, cut, model.shape.buckets)
        total = np.concatenate(([0], np.cumsum(rows[:, 0], dtype=np.float64)))[cut]
        count = np.concatenate(([0], np.cumsum(rows[:, 1], dtype=np.float64)))[cut]
        n = np.diff(count) + np.bincount(text, minlength=b - a)
        logit = (np.diff(total) + np.bincount(text, model.adds[two], b - a)) / np.maximum(n, 1) + model.bias
        scores[a:b] = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
    return scores


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = ROWS, chars: int = CHARS, shape: Shape = Shape()) -> Model:
    """Train on a bounded sample of the labelled documents whose crc32(doc_id) mod 5 is not 0.

    Labels other than 0 and 1 and null ones are left out; of several labels of
    a document the smallest counts. The sample is drawn from the labels first,
    so the documents are scanned once and nothing of them is shuffled.
    """
    one = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("label")).where(remainder(5) != 0)
    order = F.xxhash64(F.lit(7), "doc_id")
    heads = one.select(order.alias("o")).orderBy("o").limit(2 * rows).agg(F.max("o").alias("o")).first()
    if heads["o"] is None:
        return train([], shape)
    some = one.where(order <= F.lit(heads["o"]))  # 2 * rows labels at most
    model = train(training_rows(documents(docs).join(F.broadcast(some), "doc_id"), rows, chars), shape)
    trim()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score to all columns of docs but the text's copy. Null and empty texts score what the model gives an empty one."""
    spark = ready(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)  # a table of `buckets` numbers, whatever the corpus
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, memo = sent.value, tv.Memo(2, bits=19)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            got = pa.array(score_texts(texts, known, memo), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; a null doc_id counts as not held out."""
    scored = score(documents(docs), fit(docs, labels))
    return scored.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, all columns of docs kept."""
    scored = score(boxed(docs, "text"), fit(docs, labels))
    return unboxed(scored.where(F.col("score") >= threshold), docs.columns, "text")
