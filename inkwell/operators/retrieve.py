"""Lookups by tier, band and name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def length_score(ratio: Column) -> Column:
    """How well a candidate's length suits, best at 1.1 times the input's."""
    return F.exp(-0.5 * F.pow((ratio - 1.1) / 0.2, 2))


def best_by(rows: DataFrame, by: str, score: Column, *keys: str) -> DataFrame:
    """The row of each group with the highest score, of equals the one with the smallest keys: one aggregate."""
    best = rows.groupBy(by).agg(F.min(F.struct((-score).alias("_s"), *keys)).alias("_b"))
    return best.select(by, *(F.col(f"_b.{k}").alias(k) for k in keys), F.round(-F.col("_b._s"), 6).alias("score"))


def first_tier(rows: DataFrame, by: str, tier: Column, k: int, *order: str) -> DataFrame:
    """Of each group the first k rows of its lowest tier that has any."""
    ranked = rows.withColumn("tier", tier).where(F.col("tier").isNotNull())
    lowest = ranked.groupBy(by).agg(F.min("tier").alias("_t"))
    kept = ranked.join(lowest, by).where(F.col("tier") == F.col("_t")).drop("_t")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def lookup(names: DataFrame, profiles: DataFrame) -> DataFrame:
    """dna of each asked name: the exact profile, else one equal but for case (the first by name), else an empty string."""
    low = profiles.groupBy(F.lower("name").alias("_low")).agg(F.min(F.struct("name", "dna")).alias("_any"))
    exact = profiles.select(F.col("name").alias("_name"), F.col("dna").alias("_exact"))
    found = names.join(exact, F.col("asked") == F.col("_name"), "left").join(low, F.lower("asked") == F.col("_low"), "left")
    return found.select("asked", F.coalesce("_exact", F.col("_any.dna"), F.lit("")).alias("dna"), (F.col("_exact").isNotNull() | F.col("_any").isNotNull()).alias("known"))
