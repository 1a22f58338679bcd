"""Coarse inverted lists with product-quantised residuals, and blocks of bounded size over them.

The index is fitted on a bounded sample and codes every vector. Lists are
dealt into blocks of about BLOCK vectors: small lists share a block, a large
one is split over several by a hash of the id. A query visits the blocks that
hold lists it probes. A block and a bounded batch of its queries make one
group, so no task ever holds a whole list or all queries of one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import bounded_sample, clean, keep, ready

#: Lists grow with the square root of the number of vectors up to LISTS, and the rows that the index is fitted on with the
#: lists: at least SAMPLE, PER_LIST for each list, so 98,304 at most. Codewords of a subspace; vectors and queries of a group.
SAMPLE, PER_LIST, LISTS, WORDS = 10_000, 24, 4096, 256
BLOCK, BATCH = 8192, 8192
#: Dimensions of a subspace.
WIDE = 4


def sound(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, all components finite, not all zero."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors(table: DataFrame) -> list[DataFrame]:
    """vec_id and embedding of the rows that take part, once each: a DataFrame for each dimension, as vectors of two dimensions have no product."""
    rows = clean(table, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & sound(F.col("embedding")))
    rows = keep(rows.withColumn("dim", F.size("embedding")).distinct(), "vectors")
    dims = sorted(r["dim"] for r in rows.select("dim").distinct().collect())
    return [rows.where(F.col("dim") == d).drop("dim") for d in dims]


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to those of c, less what does not depend on c."""
    return (c * c).sum(axis=1) - 2 * x @ c.T


def closest(x: np.ndarray, c: np.ndarray, step: int = 4096) -> np.ndarray:
    """Which row of c is nearest each row of x, some rows at a time."""
    return np.concatenate([nearest(x[a : a + step], c).argmin(axis=1) for a in range(0, len(x), step)])


def means(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's k-means; a centre that loses all its points takes the place of a random one."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = closest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(c))])
    return c


@dataclass(frozen=True)
class Index:
    """Coarse centroids, codebooks (one per subspace), where subspaces begin, lists to probe, whether vectors are brought to length 1, and what they are divided by otherwise."""

    centroids: np.ndarray
    books: list[np.ndarray]
    cuts: np.ndarray
    probes: int
    unit: bool
    scale: float = 1.0

    def ready(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float64)
        return x / np.linalg.norm(x, axis=1, keepdims=True) if self.unit else x / self.scale

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's list, residual codes, and the distance of what they stand for from the vector itself."""
        own = nearest(x, self.centroids).argmin(axis=1)
        rest = x - self.centroids[own]
        codes, left = np.empty((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for m, book in enumerate(self.books):
            part = rest[:, self.cuts[m] : self.cuts[m + 1]]
            codes[:, m] = nearest(part, book).argmin(axis=1)
            left += ((part - book[codes[:, m]]) ** 2).sum(axis=1)
        return own, codes, np.sqrt(left)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each subspace, the inner products of the queries with its codewords."""
        return [(q[:, self.cuts[m] : self.cuts[m + 1]] @ book.T).astype(np.float32) for m, book in enumerate(self.books)]

    def approach(self, q: np.ndarray, tables: list[np.ndarray], lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries with coded vectors, from the tables: queries as they are, vectors as their codes say."""
        out = np.take((q @ self.centroids.T).astype(np.float32), lists, axis=1)
        for m, table in enumerate(tables):
            out += np.take(table, codes[:, m], axis=1)
        return out


def fit(rows: DataFrame, number: int, *, unit: bool, probing: Callable[[np.ndarray, np.ndarray], int], seed: int = 5) -> Index | None:
    """Fit on a bounded sample (the vectors with the smallest hash of their id); None without rows."""
    lists = max(1, min(LISTS, int(number**0.5 / 2)))
    most = max(SAMPLE, PER_LIST * lists)
    hashed = bounded_sample(rows, "vec_id", most).select("vec_id", "embedding", F.xxhash64("vec_id", "embedding").alias("h"))
    got = hashed.orderBy("h", "vec_id").limit(most).collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["vec_id"], r["h"]))
    x = np.array([r["embedding"] for r in got], np.float64)
    if unit:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    scale = 1.0 if unit else 2.0 ** np.floor(np.log2(np.abs(x).max()))  # a power of two, so nothing is rounded
    x /= scale
    c = means(x, min(lists, len(x)), seed)
    rest = x - c[closest(x, c)]
    dim = x.shape[1]
    cuts = np.linspace(0, dim, max(1, -(-dim // WIDE)) + 1).astype(int)
    books = [means(rest[:, a:b], WORDS, seed + m) for m, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return Index(c, books, cuts, min(len(c), max(1, probing(x, c))), unit, float(scale))


def coded(rows: DataFrame, index: Index, *, probe_all: bool) -> DataFrame:
    """rows (vec_id, embedding, ...) with list, code, err, and probes (of queries only, unless probe_all)."""
    spark = ready(rows.sparkSession)
    sent = spark.sparkContext.broadcast(index)  # LISTS centroids and WORDS codewords a subspace at most, whatever the corpus
    names = rows.columns
    at = names.index("embedding")
    asks = None if probe_all else names.index("asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = known.ready(np.asarray(batch.column(at).flatten()).reshape(batch.num_rows, -1))
            own, codes, err = known.encode(x)
            far = -(x @ known.centroids.T) if not known.unit else nearest(x, known.centroids)
            order = np.argsort(far, axis=1, kind="stable")[:, : known.probes].astype(np.int32)
            if known.unit:
                order[:, 0] = own
            some = np.ones(len(x), bool) if asks is None else np.asarray(batch.column(asks).to_numpy(zero_copy_only=False), bool)
            probes = [p if ok else np.zeros(0, np.int32) for p, ok in zip(order, some, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err + 1e-5), pa.array(probes, pa.list_(pa.int32()))], names=[*names, "list", "code", "err", "probes"])

    schema = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("code", T.BinaryType()), T.StructField("err", T.DoubleType()), T.StructField("probes", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema)


def grouped(rows: DataFrame, lists: int, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """work(members, queries) for each block and batch of its queries; rows come from `coded`."""
    counts = {r["list"]: r["n"] for r in rows.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most LISTS rows
    first, parts, block, room = [], [], 0, BLOCK
    for i in range(lists):
        n = counts.get(i, 0)
        if n > room and room < BLOCK:
            block, room = block + 1, BLOCK
        first.append(block)
        parts.append(max(1, -(-n // BLOCK)))
        if parts[-1] > 1:
            block, room = block + parts[-1], BLOCK
        else:
            room -= n
    begin, many = F.lit(first), F.lit(parts)
    place = F.xxhash64("vec_id")
    members = rows.withColumn("block", F.get(begin, F.col("list")) + F.pmod(place, F.get(many, F.col("list")).cast("long")).cast("int"))
    visits = F.array_distinct(F.flatten(F.transform("probes", lambda p: F.sequence(F.get(begin, p), F.get(begin, p) + F.get(many, p) - 1))))
    asking = rows.where(F.size("probes") > 0).withColumn("block", F.explode(visits))
    load = keep(asking.groupBy("block").agg(F.ceil(F.count("*") / BATCH).cast("int").alias("batches")), "load")
    asking = asking.join(load, "block").withColumn("batch", F.pmod(place, F.col("batches").cast("long")).cast("int")).drop("batches")
    members = members.join(load, "block").withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1))).drop("batches")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(left, right)

    asking = asking.select(*(F.col(c).alias(c) for c in asking.columns))
    return members.groupBy("block", "batch").cogroup(asking.groupBy("block", "batch")).applyInArrow(run, schema)


def matrix(table: pa.Table, column: str) -> np.ndarray:
    """A column of equally long lists or byte strings as a matrix."""
    data = table.column(column).combine_chunks()
    if pa.types.is_binary(data.type):
        return np.frombuffer(b"".join(data.to_pylist()), np.uint8).reshape(len(data), -1)
    return np.asarray(data.flatten()).reshape(len(data), -1)
