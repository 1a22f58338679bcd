"""Exact joins by cosine likeness in a metric space, and leader clustering by them.

Unit vectors lie at Euclidean distance sqrt(2 - 2 cos). A bounded number of
rows are pivots. Each row belongs to its nearest pivot; a pivot's rows are cut
into bands by their distance to it, and bands into blocks of a bounded number
of rows; small bands share a block. By the triangle inequality a row within r of a query lies no nearer
to a pivot than the query less r, and no farther than the query and r; so a
query meets only the blocks whose bands reach into that ring. For the nearest
k, r is the k-th smallest of the ways over the pivots. A task holds one block
and lets the queries pass by it; no group of rows meets whole in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import kept

PIVOTS, BANDS, BLOCK = 32, 16, 8192
#: Groups and pivots together, as what is known of them goes to every task.
MOST_CELLS = 8192
#: Queries held against a block at a time.
STEP = 128
#: Queries that one task lets pass by a block.
PASSING = 250_000
#: Likeness is rounded to so many places before it is compared.
PLACES = 6
SLACK = 1e-6
ROW = "grp string, id long, v array<double>"


def unit(rows: DataFrame, key: str, vector: str, by: str | None = None) -> DataFrame:
    """grp, id, v: vectors of length 1; a group holds one value of `by` and one dimension. Vectors that are null, zero or not finite throughout have no direction and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for grp, key_, v in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                x = np.array([math.nan if e is None else e for e in v], float)
                size = float(np.sqrt((x * x).sum())) if np.isfinite(x).all() and len(x) else 0.0
                if size > 0 and math.isfinite(size):
                    out.append((f"{len(x)}|{grp}", key_, (x / size).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.list_(pa.float64()))], names=["grp", "id", "v"])

    grp = F.lit("") if by is None else F.coalesce(F.col(by).cast("string"), F.lit("\u0000"))
    some = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    return some.select(grp.alias("grp"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, ROW)


def matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors of one dimension as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ y.T)))


@dataclass
class Cells:
    """What all tasks know: pivots by dimension, and of each group its cells (pivot, least and greatest distance, blocks, number) and the first distances to each pivot."""

    pivots: dict[int, np.ndarray]
    edges: dict[tuple[str, int], np.ndarray]
    cells: dict[str, np.ndarray]
    first: dict[str, np.ndarray]

    def of(self, grp: str) -> np.ndarray:
        return self.pivots[int(grp.split("|", 1)[0])]


def groups(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, rows, ids, vectors) of a batch with columns grp, id, v."""
    names = np.array(batch.column(0).to_pylist(), object)
    for grp in sorted(set(names.tolist())):
        at = np.flatnonzero(names == grp)
        some = batch.take(pa.array(at))
        yield grp, at, some.column(1).to_numpy(), matrix(some.column(2))


def placed(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rows with the nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, dist = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for grp, at, _, x in groups(batch):
                far = apart(x, pivots[int(grp.split("|", 1)[0])])
                pivot[at], dist[at] = far.argmin(axis=1), far.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(dist)], names=["grp", "id", "v", "pivot", "dist"])

    return rows.mapInArrow(run, ROW + ", pivot int, dist double")


def index(rows: DataFrame, k: int = 0, *, pivots: int = PIVOTS, bands: int = BANDS, block: int = BLOCK) -> tuple[DataFrame, Cells]:
    """The rows (see `unit`) with their blocks as a table, and what queries need to know of them."""
    rows = kept(rows, "unit")
    dims = [r[0] for r in rows.select(F.size("v").alias("n")).distinct().limit(MOST_CELLS + 1).collect()]
    if len(dims) > MOST_CELLS:
        raise ValueError(f"vectors of more than {MOST_CELLS} dimensions")
    some = rows.withColumn("_r", F.row_number().over(Window.partitionBy(F.size("v")).orderBy(F.xxhash64("id"), "id", "grp"))).where(F.col("_r") <= pivots).select("v").collect()
    chosen = {d: np.array([list(r["v"]) for r in some if len(r["v"]) == d]) for d in dims}
    table = kept(placed(rows, chosen), "placed")
    cut = [i / bands for i in range(1, bands)]
    found = table.groupBy("grp", "pivot").agg(F.percentile_approx("dist", cut, 1000).alias("edges")).limit(MOST_CELLS + 1).collect()
    if len(found) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells: fewer groups or pivots are needed")
    edges = {(r["grp"], r["pivot"]): np.unique(r["edges"]) for r in found}
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast(edges)

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [int(np.searchsorted(known.value[g, p], d)) for g, p, d in zip(*(batch.column(c).to_pylist() for c in ("grp", "pivot", "dist")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], names=[*batch.schema.names, "band"])

    table = table.mapInArrow(band, ROW + ", pivot int, dist double, band int")
    stats = table.groupBy("grp", "pivot", "band").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).orderBy("grp", "pivot", "band").collect()  # at most `bands` a cell
    cells: dict[str, list] = {}
    numbers, number, held = [], -1, block
    for r in stats:  # cells that follow one another share a block while it has room, so that a query goes to few blocks
        if r["grp"] not in cells or held + r["n"] > block:
            number, held = number + 1, 0
        held += r["n"]
        parts = -(-r["n"] // block)
        cells.setdefault(r["grp"], []).append((r["pivot"], r["lo"], r["hi"], parts, number))
        numbers.append((r["grp"], r["pivot"], r["band"], number, parts))
    first: dict[str, list] = {}
    if k:
        near = Window.partitionBy("grp", "pivot").orderBy("dist")
        for r in table.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= k + 1).select("grp", "pivot", "dist").collect():  # k + 1 a cell
            first.setdefault(r["grp"], []).append((r["pivot"], r["dist"]))
    places = spark.createDataFrame(numbers, "grp string, pivot int, band int, cell long, blocks long")
    table = table.join(F.broadcast(places), ["grp", "pivot", "band"])  # at most MOST_CELLS x bands rows
    table = table.select("grp", "id", "v", (F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("id"), "blocks")).alias("block"))
    return table, Cells(chosen, edges, {g: np.array(c, float) for g, c in cells.items()}, {g: np.array(c, float) for g, c in first.items()})


def routed(queries: DataFrame, cells: Cells, k: int = 0, radius: float = 0.0) -> DataFrame:
    """The queries (see `unit`) once for each block that they have to meet."""
    sent = queries.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            rows, blocks = [], []
            for grp, at, _, x in groups(batch):
                if grp not in known.cells:
                    continue
                far = apart(x, known.of(grp))
                pivot, lo, hi, parts, number = known.cells[grp].T
                reach = np.full(len(x), radius)
                if k:
                    over, more = known.first[grp].T
                    ways = far[:, over.astype(int)] + more
                    reach = np.sort(np.partition(ways, min(k, ways.shape[1] - 1), axis=1), axis=1)[:, min(k, ways.shape[1] - 1)] if ways.shape[1] > k else np.full(len(x), 3.0)
                own = far[:, pivot.astype(int)]
                near = (own + reach[:, None] + SLACK >= lo) & (own - reach[:, None] - SLACK <= hi)
                at_block = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])  # cells of a block stand together
                i, j = np.nonzero(np.logical_or.reduceat(near, at_block, axis=1))
                j = at_block[j]
                n = parts[j].astype(int)
                part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                rows.append(np.repeat(at[i], n))
                blocks.append(np.repeat(number[j].astype(np.int64) << 32, n) + part)
            if rows:
                rows, blocks = np.concatenate(rows), np.concatenate(blocks)
                for s in range(0, len(rows), 4096):
                    some = batch.take(pa.array(rows[s : s + 4096]))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(blocks[s : s + 4096])], names=["grp", "id", "v", "block"])

    return queries.mapInArrow(run, ROW + ", block long")


def met(queries: DataFrame, table: DataFrame, least: float, k: int, count: int) -> DataFrame:
    """(query, id, likeness) of what meets in the blocks: likeness at least `least`, and the k best of a query in each block if k is given."""
    parts = max(1, -(-count // PASSING))
    here = table.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("side", F.lit(0))
    there = queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("side", F.lit(1))
    both = here.unionByName(there).select("block", "part", "side", "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, own = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            ends = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for s, e in zip(ends[:-1], ends[1:], strict=True):
                here, some = (int(key[s, 0]), int(key[s, 1])), batch.slice(s, e - s)
                if here != at:
                    at, ids, own = here, [], []
                if key[s, 2] == 0:
                    ids.append(some.column(3).to_numpy())
                    own.append(matrix(some.column(4)))
                elif ids:
                    if len(ids) > 1:
                        ids, own = [np.concatenate(ids)], [np.concatenate(own)]
                    yield from pairs(some.column(3).to_numpy(), matrix(some.column(4)), ids[0], own[0])

    def pairs(query: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(query), STEP):
            like = np.round(x[s : s + STEP] @ y.T, PLACES)
            like[query[s : s + STEP, None] == ids[None, :]] = -2
            if k and like.shape[1] > k:
                edge = -np.partition(-like, k - 1, axis=1)[:, k - 1]
                i, j = np.nonzero((like >= edge[:, None]) & (like >= max(least, -1.5)))
                order = np.lexsort((ids[j], -like[i, j], i))
                i, j = i[order], j[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                i, j = i[rank < k], j[rank < k]
            else:
                i, j = np.nonzero(like >= max(least, -1.5))
            yield pa.RecordBatch.from_arrays([pa.array(query[s : s + STEP][i]), pa.array(ids[j]), pa.array(like[i, j])], names=["query", "id", "likeness"])

    return both.repartition("block", "part").sortWithinPartitions("block", "part", "side", "id").mapInArrow(run, "query long, id long, likeness double")


def nearest(queries: DataFrame, rows: DataFrame, k: int, *, least: float = -1.0, **sizes: int) -> DataFrame:
    """query, id, likeness, rank: for each query (see `unit`) the k rows of its group most like it, the same id left out, ties to the smaller id."""
    table, cells = index(rows, k, **sizes)
    queries = kept(queries, "queries")
    found = met(routed(queries, cells, k=k), table, least, k, queries.count())
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("likeness"), "id")))
    return ranked.where(F.col("rank") <= k)


def within(rows: DataFrame, least: float, **sizes: int) -> DataFrame:
    """(query, id, likeness): all ordered pairs of rows of one group that are alike by at least `least`."""
    table, cells = index(rows, **sizes)
    rows = kept(rows, "queries")
    return met(routed(rows, cells, radius=math.sqrt(max(0.0, 2 - 2 * least)) + 1e-3), table, least, 0, rows.count())


def leaders(rows: DataFrame, least: float, **sizes: int) -> DataFrame:
    """id, leader: in order of id a row joins the first leader that it is like, and is a leader itself if there is none.

    Taken in turns that would be one long loop. But a row that is like no
    earlier undecided one leads whatever the others do, and what is like an
    earlier leader follows; so each round decides all such rows at once, until
    none is undecided. Then each follower takes the first leader it is like.
    """
    rows = kept(rows, "rows")
    links = kept(within(rows, least, **sizes).where("id < query").select(F.col("id").alias("a"), F.col("query").alias("b")), "links")
    live, leading = links, None
    while True:
        if live.isEmpty():
            break
        later = live.select(F.col("b").alias("id")).distinct()
        now = live.select(F.col("a").alias("id")).distinct().join(later, "id", "left_anti")
        follow = live.join(now.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        follow = kept(follow if leading is None else follow.unionByName(leading), "followers")
        leading = follow
        live = kept(live.join(follow.withColumnRenamed("id", "a"), "a", "left_anti").join(follow.withColumnRenamed("id", "b"), "b", "left_anti").join(now.withColumnRenamed("id", "a"), "a", "left_anti"), "live")
    if leading is None:
        return rows.select("id", F.col("id").alias("leader"))
    first = links.join(leading.distinct().withColumnRenamed("id", "a"), "a", "left_anti").groupBy("b").agg(F.min("a").alias("leader"))
    return rows.select("id").join(first.withColumnRenamed("b", "id"), "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))
