"""Joins by likeness and by range: the nearest row of the same key, and rows whose sizes lie in a band."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import compare as cp


def nearest_join(queries: DataFrame, rows: DataFrame, by: str, vector: str, query: str, key: str, k: int = 1, least: float = -1.0) -> DataFrame:
    """For each query row the k rows of the same `by` most like it by cosine, itself left out: (query, key, similarity, rank).

    An equi-join on `by`; of one nearest row a maximum is kept, combined on
    the map side, of several a ranking that drops the rest before it is sorted.
    """
    left = queries.select(F.col(by).alias("_by"), F.col(query).alias("_q"), F.col(vector).alias("_a"))
    right = rows.select(F.col(by).alias("_by"), F.col(key).alias("_k"), F.col(vector).alias("_b"))
    both = left.join(right, "_by").where(F.col("_q") != F.col("_k")).select("_q", "_k", F.round(cp.cosine(F.col("_a"), F.col("_b")), 6).alias("_s")).where(F.col("_s") >= least)
    if k == 1:
        best = both.groupBy("_q").agg(F.min(F.struct((-F.col("_s")).alias("d"), "_k")).alias("_m"))
        return best.select(F.col("_q").alias(query), F.col("_m._k").alias(key), (-F.col("_m.d")).alias("similarity"), F.lit(1).alias("rank"))
    order = Window.partitionBy("_q").orderBy(F.desc("_s"), "_k")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("_q").alias(query), F.col("_k").alias(key), F.col("_s").alias("similarity"), "rank")


def band_join(left: DataFrame, right: DataFrame, size: str, low: float, high: float, by: str | None = None) -> DataFrame:
    """Pairs whose right size lies in [low, high] times the left one, both positive: columns of both sides, the right ones after `_r`.

    Sizes are put into buckets by their logarithm, as wide as the band, so a
    band meets few buckets: an equi-join, not a comparison of all pairs.
    """
    width = math.log(high / low)

    def bucket(c: Column) -> Column:
        return F.floor(F.ln(c) / width).cast("long")

    one = left.where(F.col(size) > 0).withColumn("_at", F.explode(F.sequence(bucket(F.col(size) * (low * (1 - 1e-9))), bucket(F.col(size) * (high * (1 + 1e-9))))))
    two = right.where(F.col(size) > 0).select(*(F.col(c).alias(f"_r{c}") for c in right.columns), bucket(F.col(size)).alias("_to"))
    on = F.col("_at") == F.col("_to")
    if by:
        on = on & (F.col(by) == F.col(f"_r{by}"))
    ratio = F.col(f"_r{size}") / F.col(size)
    return one.join(two, on).where((ratio >= low) & (ratio <= high)).drop("_at", "_to")
