"""Approximate nearest neighbours by inner product: inverted lists, product-quantised residuals, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import pq
from .runtime import bounded_sample, keep

EVERY, TOP = 20, 20
#: Vectors of a block that are scored exactly for each query at least; beyond them all that the codes' error leaves in question.
RERANK = 200
#: Queries whose true neighbours are looked up among all rows, and the share of those that must lie in probed lists.
ASKED, COVER = 200, 0.98


def probing(rows: DataFrame, index: pq.Index, top: int = TOP, asked: int = ASKED) -> int:
    """The fewest lists, by centroid's inner product, that hold COVER of the exact neighbours of some queries among all rows.

    The queries are those with the smallest hash of their id, as other rows
    may be quite unlike them. Each task keeps their best rows and hands on in
    which place of the query's order the list of each lies.
    """
    got = bounded_sample(rows.where("asks"), "vec_id", asked).orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(asked).select("vec_id", "embedding").collect()
    if not got:
        return 1
    names, q = np.array([r["vec_id"] for r in got], np.int64), np.array([r["embedding"] for r in got], np.float64)
    sent = rows.sparkSession.sparkContext.broadcast((index, names, q))  # `asked` queries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names, q = sent.value
        best = np.full((len(q), top), -np.inf)
        lists = np.zeros((len(q), top), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1)
            score = q @ x.T
            score[names[:, None] == batch.column(0).to_numpy()[None, :]] = -np.inf
            k = min(top, len(x))
            at = np.argpartition(-score, k - 1, axis=1)[:, :k]
            own = pq.closest(known.ready(x), known.centroids)
            every, where = np.concatenate([best, np.take_along_axis(score, at, axis=1)], axis=1), np.concatenate([lists, own[at]], axis=1)
            top_of = np.argsort(-every, axis=1, kind="stable")[:, :top]
            best, lists = np.take_along_axis(every, top_of, axis=1), np.take_along_axis(where, top_of, axis=1)
        place = np.empty((len(q), len(known.centroids)), np.int64)
        np.put_along_axis(place, np.argsort(-(known.ready(q) @ known.centroids.T), axis=1, kind="stable"), np.arange(len(known.centroids))[None, :], axis=1)
        row, col = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(best[row, col]), pa.array(place[row, lists[row, col]].astype(np.int32))], names=["query", "score", "place"])

    found = rows.select("vec_id", "embedding").mapInArrow(run, "query int, score double, place int")
    nearest = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "place"))).where(F.col("r") <= top)
    need = np.sort([r["place"] for r in nearest.select("place").collect()])  # asked x top at most
    return int(need[min(len(need) - 1, int(COVER * len(need)))]) + 1 if len(need) else 1


def search(table: DataFrame, *, every: int = EVERY, top: int = TOP, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: of each vector whose id is divisible by `every` its `top` nearest others.

    Score is the inner product of the original vectors in double precision,
    ties go to the smaller vec_id. Vectors that are null, empty, zero or hold
    null or non-finite components and rows without vec_id take no part; each
    dimension has an index of its own; rows that repeat an id and its vector
    count once.
    """
    schema = "query_id long, vec_id long, score double"
    parts = [found_in(rows, every, top, rerank) for rows in pq.vectors(table)]
    found = reduce(DataFrame.unionByName, parts, table.sparkSession.createDataFrame([], schema)) if len(parts) != 1 else parts[0]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def found_in(rows: DataFrame, every: int, top: int, rerank: int) -> DataFrame:
    """query_id, vec_id, score: the best of each block for the queries among vectors of one dimension."""
    rows = rows.withColumn("asks", F.col("vec_id") % every == 0)
    number = rows.count()
    index = pq.fit(rows, number, unit=False, probing=lambda x, c: 1)
    schema = "query_id long, vec_id long, score double"
    if index is None:
        return rows.sparkSession.createDataFrame([], schema)
    index = replace(index, probes=min(len(index.centroids), probing(rows, index, top)))
    sent = rows.sparkSession.sparkContext.broadcast(index)

    def work(members: pa.Table, queries: pa.Table) -> pa.Table:
        known = sent.value
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if members.num_rows and queries.num_rows:
            members = members.sort_by("vec_id")
            ids, x = members.column("vec_id").to_numpy(), pq.matrix(members, "embedding").astype(np.float64)
            lists, codes = members.column("list").to_numpy(), pq.matrix(members, "code")
            names, q, probes = queries.column("vec_id").to_numpy(), pq.matrix(queries, "embedding").astype(np.float64), pq.matrix(queries, "probes")
            coded = known.ready(x)
            slack = members.column("err").to_numpy() + 1e-5 * np.abs(coded).max() * coded.shape[1] ** 0.5
            for a in range(0, len(q), 128):
                part = q[a : a + 128]
                way = part / np.abs(part).max(axis=1, keepdims=True)
                way /= np.linalg.norm(way, axis=1, keepdims=True)
                probed = np.zeros((len(part), len(known.centroids)), bool)
                np.put_along_axis(probed, probes[a : a + 128].astype(np.int64), True, axis=1)
                there = probed[:, lists]
                near = known.approach(way, known.tables(way), lists, codes)
                k = min(max(rerank, top + 1), near.shape[1])
                least = -np.partition(np.where(there, slack - near, np.inf), k - 1, axis=1)[:, k - 1 : k]
                there &= near + slack >= least
                cols = np.flatnonzero(there.any(axis=0))
                score = np.where(there[:, cols], way @ coded[cols].T, -np.inf)
                k = min(top + 1, score.shape[1])
                if k:
                    least = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]  # one more, as the query may be among them; ties of the last one all go on
                    score[score < least - 1e-12 * np.abs(coded).max() * coded.shape[1] ** 0.5] = -np.inf
                row, col = np.nonzero(score > -np.inf)
                col = cols[col]
                other = names[a + row] != ids[col]
                row, col = row[other], col[other]
                score = np.concatenate([(part[row[i : i + 100_000]] * x[col[i : i + 100_000]]).sum(axis=1) for i in range(0, len(row), 100_000)]) if len(row) else np.zeros(0)
                order = np.lexsort((ids[col], -score, row))
                row, col, score = row[order], col[order], score[order]
                begin = np.searchsorted(row, np.arange(len(part)))
                best = np.arange(len(row)) - begin[row] < top
                out.append((names[a + row[best]], ids[col[best]], score[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return pq.grouped(keep(pq.coded(rows, index, probe_all=False), "coded"), len(index.centroids), work, schema)
