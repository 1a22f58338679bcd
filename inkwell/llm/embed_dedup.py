"""Near-duplicate embeddings: product-quantised inverted lists find candidates, exact cosines decide."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pq
from .runtime import clean, components, keep

COSINE = 0.9
#: Share of vectors turned by the greatest angle still linked that must stay within the probed lists.
COVER = 0.995


def probing(x: np.ndarray, c: np.ndarray, cosine: float = COSINE, seed: int = 3) -> int:
    """The fewest nearest lists that hold COVER of the sample's vectors after a random turn by arccos(cosine)."""
    rng = np.random.default_rng(seed)
    x = x[:4000]
    turn = rng.normal(size=x.shape)
    turn -= (turn * x).sum(axis=1, keepdims=True) * x
    turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-12)
    moved = cosine * x + (1 - cosine**2) ** 0.5 * turn
    far = pq.nearest(x, c)
    own = pq.nearest(moved, c).argmin(axis=1)
    place = np.sort((far < far[np.arange(len(x)), own][:, None]).sum(axis=1))
    return int(place[min(len(place) - 1, int(COVER * len(place)))]) + 1


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the given ones connect, at most one for each node."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    at, to = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[at], root[to])
        new = root.copy()
        np.minimum.at(new, root[at], low)
        np.minimum.at(new, root[to], low)
        np.minimum.at(new, at, low)
        np.minimum.at(new, to, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def links(table: DataFrame, *, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of the table.

    Pairs found by the index are held against the exact cosine in double
    precision. Equal vectors are joined first and stand as one with a weight,
    so a vector with many copies costs no more than one. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing;
    each dimension has an index of its own. Rows that repeat an id get
    the same result; a null id gets no component and is kept.
    """
    every = clean(table, "vec_id")
    parts = [linked(rows, cosine) for rows in pq.vectors(table)]
    if not parts:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    by_id = reduce(DataFrame.unionByName, parts).groupBy("vec_id").agg(F.max("n_links").cast("long").alias("n_links"), F.min("component_id").alias("component_id"))
    out = every.join(by_id, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def linked(rows: DataFrame, cosine: float) -> DataFrame:
    """vec_id, n_links, component_id of vectors of one dimension."""
    spark = rows.sparkSession
    named = keep(rows.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight")), "distinct")
    number = named.count()
    index = pq.fit(named, number, unit=True, probing=lambda x, c: probing(x, c, cosine))
    if index is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    sent = spark.sparkContext.broadcast(index)

    def work(members: pa.Table, queries: pa.Table) -> pa.Table:
        known = sent.value
        kind, left, right = [], [], []

        def put(k: int, a: np.ndarray, b: np.ndarray) -> None:
            kind.append(np.full(len(a), k, np.int32))
            left.append(a.astype(np.int64))
            right.append(b.astype(np.int64))

        if members.num_rows and queries.num_rows:
            members = members.sort_by([("list", "ascending"), ("vec_id", "ascending")])
            ids, x = members.column("vec_id").to_numpy(), known.ready(pq.matrix(members, "embedding"))
            lists, codes, err = members.column("list").to_numpy(), pq.matrix(members, "code"), members.column("err").to_numpy()
            weight, back = members.column("weight").to_numpy(), pq.matrix(members, "probes")
            names, q, probes = queries.column("vec_id").to_numpy(), known.ready(pq.matrix(queries, "embedding")), pq.matrix(queries, "probes")
            home, load = queries.column("list").to_numpy(), queries.column("weight").to_numpy()
            one, two = [], []
            for at in np.unique(lists):
                lo, hi = np.searchsorted(lists, [at, at + 1])
                asking = np.flatnonzero((probes == at).any(axis=1))
                for a in range(0, len(asking), 512):
                    part = asking[a : a + 512]
                    near = known.approach(q[part], known.tables(q[part]), lists[lo:hi], codes[lo:hi])
                    row, col = np.nonzero(near + err[lo:hi] >= cosine)
                    row, col = part[row], col + lo
                    other = names[row] != ids[col]
                    row, col = row[other], col[other]
                    for i in range(0, len(row), 100_000):
                        r, k = row[i : i + 100_000], col[i : i + 100_000]
                        ok = (q[r] * x[k]).sum(axis=1) >= cosine
                        one.append(r[ok])
                        two.append(k[ok])
            row, col = (np.concatenate(one), np.concatenate(two)) if one else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            if len(row):
                mine = np.bincount(row, weight[col], len(names))
                blind = ~(back[col] == home[row][:, None]).any(axis=1)
                theirs = np.bincount(col[blind], load[row[blind]], len(ids))
                put(0, names[mine > 0], mine[mine > 0])
                put(0, ids[theirs > 0], theirs[theirs > 0])
                put(1, *forest(names[row], ids[col]))
        return pa.table({n: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), t) for n, v, t in (("kind", kind, pa.int32()), ("a", left, pa.int64()), ("b", right, pa.int64()))})

    found = keep(pq.grouped(keep(pq.coded(named, index, probe_all=True), "coded"), len(index.centroids), work, "kind int, a long, b long"), "found")
    counts = found.where("kind = 0").groupBy("a").agg(F.sum("b").cast("long").alias("linked"))
    reached = components(found.where("kind = 1").select("a", "b"))
    whole = named.join(counts, F.col("vec_id") == F.col("a"), "left").join(reached, F.col("vec_id") == F.col("id"), "left")
    told = whole.select("embedding", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return rows.join(told, "embedding").select("vec_id", "n_links", "component_id")
