"""Weighted draws: frequencies, reruns, merging, turns with a history."""

from __future__ import annotations

import hashlib
import math
import random

from pyspark.sql import functions as F

from inkwell.operators import draw as dr


def u(*ids) -> float:
    return (int(hashlib.md5("|".join(map(str, ids)).encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def test_frequencies_follow_the_weights(spark):
    weights = {1: 1.0, 2: 2.0, 3: 5.0, 4: 0.0, 5: 2.0}
    rows = spark.range(10_000).select(F.col("id").alias("g"), F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in weights.items()))).alias("x")).select("g", "x.*")
    got = {r["k"]: r["n"] for r in dr.one(rows, ["g"], "k", F.col("w"), "s").groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert 4 not in got and sum(got.values()) == 10_000
    for k, n in got.items():
        p = weights[k] / 10
        assert abs(n - 10_000 * p) < 5 * math.sqrt(10_000 * p * (1 - p)), (k, n)


def test_reruns_and_partitions_draw_the_same(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"), (F.col("id") % 7 + 0.5).alias("w"))
    draws = [sorted(map(tuple, dr.sample(rows.repartition(n), ["g"], "k", F.col("w"), 20, "s").select("g", "k", "rank").collect())) for n in (1, 5, 11)]
    assert draws[0] == draws[1] == draws[2] and len(draws[0]) == 60
    want = sorted((-math.log(u("s", 0, k)) / (k % 7 + 0.5), k) for k in range(0, 3000, 3))[:20]
    assert [k for g, k, r in sorted(draws[0], key=lambda x: (x[0], x[2])) if g == 0] == [k for _, k in want]
    assert dr.one(rows, ["g"], "k", F.lit(0.0), "s").count() == 0


def test_nearest_sizes_equal_all_pairs(spark):
    rng = random.Random(2)
    known = [(rng.choice("ab"), rng.choice([1, 2, 3, 9, 10, 40]) if rng.random() < 0.7 else rng.randrange(60), i) for i in range(120)]
    got = dr.nearest_sizes(spark.createDataFrame(known, "g string, n int, k long"), "g", "n", "k", 6).collect()
    for r in got:
        assert [(x["distance"], x["key"]) for x in r["near"]] == sorted((abs(n - r["n"]), k) for g, n, k in known if g == r["g"])[:6]


def test_turns_remember_the_last_draws(spark):
    rng = random.Random(7)
    lists = [[(k, rng.choice([1.0, 0.5, 0.25]), rng.random()) for k in rng.sample(range(9), rng.randrange(0, 8))] for _ in range(40)]
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate(lists)], "g int, i int, c array<struct<key: long, score: double, u: double>>")
    late: list[int] = []
    want = []
    for c in lists:
        if all(k in late for k, *_ in c):
            late = []
        some = [x for x in c if x[0] not in late][: dr.TOP]
        key = min((-math.log(v) / s, k) for k, s, v in some)[1] if some else None
        want.append(key)
        late = [*late, key][-dr.HISTORY :] if key is not None else late
    assert dr.drawn_in_turn(rows, "g", "i", "c").first()["drawn"] == want
