"""Seeded weighted draws.

Each row gets a number from a digest of seed and id, so a rerun draws the same
rows whatever the partitions. The row with the smallest -ln(u) / weight is drawn
with probability weight / sum of weights, the k smallest are a weighted sample
without replacement; smallest values merge, so tasks hand on k rows a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Candidates that a draw is made from, and drawn ids that are not drawn again yet.
TOP, HISTORY = 5, 3


def uniform(seed: str, *ids: Column) -> Column:
    """A number between 0 and 1 (neither) from the digest of seed and ids: 52 bits of it."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *(i.cast("string") for i in ids)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def order(weight: Column, u: Column) -> Column:
    """By what drawn rows are ordered; null without a positive weight, which is never drawn."""
    return F.when(weight > 0, -F.ln(u) / weight)


def one(rows: DataFrame, by: list[str], key: str, weight: Column, seed: str) -> DataFrame:
    """One row's key for each group, drawn by weight: one aggregate."""
    rows = rows.withColumn("_o", order(weight, uniform(seed, *(F.col(b) for b in by), F.col(key)))).where(F.col("_o").isNotNull())
    return rows.groupBy(*by).agg(F.min(F.struct("_o", key))[key].alias(key))


def sample(rows: DataFrame, by: list[str], key: str, weight: Column, k: int, seed: str) -> DataFrame:
    """k rows of each group drawn by weight without replacement, with their rank; Spark limits groups in each task before it shuffles."""
    rows = rows.withColumn("_o", order(weight, uniform(seed, *(F.col(b) for b in by), F.col(key)))).where(F.col("_o").isNotNull())
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("_o", key))).where(F.col("rank") <= k).drop("_o")


def nearest_sizes(rows: DataFrame, by: str, size: str, key: str, k: int) -> DataFrame:
    """by, size, near: for each size that a group has, the k rows (distance, key, size) nearest in size, ties by key.

    The k first keys of each size are kept. As every size has a row, the k
    nearest rows lie among the k sizes before and behind it, so the window
    runs over sizes, not over rows.
    """
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(by, size).orderBy(key))).where(F.col("_r") <= k)
    cells = first.groupBy(by, size).agg(F.collect_list(key).alias("_k"))
    about = Window.partitionBy(by).orderBy(size).rowsBetween(-k, k)
    met = cells.withColumn("_m", F.collect_list(F.struct(F.col(size).alias("size"), F.col("_k").alias("keys"))).over(about))
    flat = F.flatten(F.transform("_m", lambda m: F.transform(m["keys"], lambda x: F.struct(F.abs(m["size"] - F.col(size)).alias("distance"), x.alias("key"), m["size"].alias("size")))))
    return met.select(by, size, F.slice(F.array_sort(flat), 1, k).alias("near"))


def drawn_in_turn(rows: DataFrame, by: str, turn: str, candidates: str, top: int = TOP, history: int = HISTORY) -> DataFrame:
    """by and `drawn`, the keys drawn for a group's turns in order: of the candidates (key, score, u; best first) not among the last `history` drawn ones the `top` best, one of them by weight.

    If all were drawn of late, the history is forgotten. A turn without candidates draws null.
    """
    steps = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(candidates).alias("c")))).alias("_t"))
    kind = "struct<late: array<bigint>, out: array<bigint>>"
    start = F.struct(F.array().cast("array<bigint>").alias("late"), F.array().cast("array<bigint>").alias("out")).cast(kind)

    def choice(late: Column, c: Column) -> Column:
        return F.array_min(F.transform(F.slice(F.filter(c, lambda x: ~F.array_contains(late, x["key"])), 1, top), lambda x: F.struct(order(x["score"], x["u"]).alias("o"), x["key"].alias("key"))))["key"]

    def step(a: Column, t: Column) -> Column:
        fresh = F.exists(t["c"], lambda x: ~F.array_contains(a["late"], x["key"]))
        late = F.when(fresh, a["late"]).otherwise(F.array().cast("array<bigint>"))
        key = choice(late, t["c"]).cast("bigint")
        kept = F.concat(F.when(F.size(late) >= history, F.slice(late, 2, history)).otherwise(late), F.when(key.isNotNull(), F.array(key)).otherwise(F.array().cast("array<bigint>")))
        return F.struct(kept.alias("late"), F.concat(a["out"], F.array(key)).alias("out")).cast(kind)

    return steps.select(by, F.aggregate("_t", start, step, lambda a: a["out"]).alias("drawn"))
