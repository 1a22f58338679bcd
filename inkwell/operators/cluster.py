"""Archetypes: assignment to centres, description, medoids, blending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import compare as cp

#: Most groups whose centres are held as literals in a plan.
MOST_CENTRES = 1024


def centroids(rows: DataFrame, by: str, vector: str, dims: int) -> DataFrame:
    """Mean vector of each group, one aggregation over the components."""
    means = [F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(dims)]
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.array(*means).alias("centre"))


def held(centres: DataFrame, by: str) -> list[tuple[int, list[float]]]:
    """Centres as plain values; their number is bounded and checked."""
    rows = centres.select(by, "centre").orderBy(by).limit(MOST_CENTRES + 1).collect()
    if len(rows) > MOST_CENTRES:
        raise ValueError(f"more than {MOST_CENTRES} centres")
    return [(r[by], list(r["centre"])) for r in rows]


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def nearest(vector: Column, centres: list[tuple[int, list[float]]], places: int | None = None) -> Column:
    """(distance, key) of the nearest centre, the smallest key of equals: an expression, no join. places: distances are rounded before they are compared."""
    far = lambda c: distance(vector, F.lit(c)) if places is None else F.round(distance(vector, F.lit(c)), places)
    return F.array_min(F.array(*(F.struct(far(c).alias("distance"), F.lit(k).alias("key")) for k, c in centres)))


def medoids(rows: DataFrame, by: str, key: str, vector: str, dims: int) -> DataFrame:
    """The row of each group that lies nearest its centre."""
    centres = centroids(rows, by, vector, dims)
    far = rows.join(centres.select(by, "centre"), by).withColumn("_d", F.round(distance(F.col(vector), F.col("centre")), 9))
    best = far.groupBy(by).agg(F.min(F.struct("_d", key)).alias("_b"))
    return best.select(by, F.col(f"_b.{key}").alias(key), F.round("_b._d", 6).alias("distance"))


def top_k(rows: DataFrame, key: str, vector: str, query: list[float], k: int, least: float | None = None) -> DataFrame:
    """The k rows most like one query vector by cosine: a scan and a bounded heap per task."""
    scored = rows.select(key, F.round(cp.cosine(F.col(vector), F.lit(query)), 6).alias("similarity"))
    scored = scored if least is None else scored.where(F.col("similarity") >= least)
    return scored.orderBy(F.desc("similarity"), key).limit(k)


def standardised(rows: DataFrame, dims: list[str], key: str, out: str = "features") -> DataFrame:
    """key and the columns as a vector, each less its mean and by its population deviation, rounded; a column that does not vary is 0."""
    stats = rows.agg(*(x for d in dims for x in (F.avg(d).alias(f"m_{d}"), F.stddev_pop(d).alias(f"s_{d}")))).first()
    parts = [F.round((F.col(d) - F.lit(stats[f"m_{d}"] or 0.0)) / F.lit(stats[f"s_{d}"]), 6) if stats[f"s_{d}"] else F.lit(0.0) for d in dims]
    return rows.select(key, F.array(*parts).alias(out))


def farthest_first(rows: DataFrame, key: str, vector: str, k: int) -> list[tuple[int, list[float]]]:
    """Up to k centres: the row with the smallest key, then in turn the one farthest from all before it, ties to the smaller key; fewer if no row is apart."""
    if k > MOST_CENTRES:
        raise ValueError(f"more than {MOST_CENTRES} centres")
    first = rows.agg(F.min(F.struct(key, vector)).alias("m")).first()["m"]
    centres = [(0, list(first[vector]))] if first is not None and first[key] is not None else []
    while centres and len(centres) < k:
        far = rows.select(F.struct((-F.round(nearest(F.col(vector), centres)["distance"], 6)).alias("d"), F.col(key), F.col(vector)).alias("x")).agg(F.min("x").alias("m")).first()["m"]
        if far["d"] == 0:
            break
        centres.append((len(centres), list(far[vector])))
    return centres


def lloyd(rows: DataFrame, key: str, vector: str, centres: list[tuple[int, list[float]]], rounds: int) -> tuple[list[tuple[int, list[float]]], list[float]]:
    """The centres after a fixed number of rounds, and the sum of squared distances before each and after the last.

    A round is one aggregate: every row goes to its nearest centre, ties to
    the smaller number, and a centre moves to the mean of its rows; one without
    rows stays. Distances and means are rounded, so other orders of summing
    give the same.
    """
    inertia = []
    for r in range(rounds + 1 if centres else 0):
        n = F.col("_n")
        placed = rows.select(vector, nearest(F.col(vector), centres, 9).alias("_n"))
        means = [F.round(F.avg(F.get(vector, F.lit(i))), 6) for i in range(len(centres[0][1]))]
        got = placed.groupBy(n["key"].alias("key")).agg(F.array(*means).alias("centre"), F.sum(F.pow(n["distance"], 2)).alias("inertia")).collect()  # a row for each centre
        inertia.append(sum(g["inertia"] for g in got))
        if r < rounds:
            moved = {g["key"]: list(g["centre"]) for g in got}
            centres = [(i, moved.get(i, c)) for i, c in centres]
    return centres, inertia
