"""Loops around a generator: who is asked, and how plans grow."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import generate as gn


def test_only_open_rows_are_asked_and_plans_stay_small(spark):
    asked: list[int] = []
    plans: list[int] = []

    def attempt(live, r):
        asked.append(live.count())
        plans.append(len(live._jdf.queryExecution().optimizedPlan().toString()))
        return live.withColumn("left", F.col("left") - 1).withColumn("tries", F.col("tries") + 1)

    rows = spark.range(60).select("id", (F.col("id") % 4).alias("left"), F.lit(0).alias("tries"))
    got = {r["id"]: (r["left"], r["tries"]) for r in gn.frontier(rows, 6, attempt, F.col("left") > 0).collect()}
    assert asked == [45, 30, 15] and max(plans) - min(plans) < 20  # numbers of columns grow a digit
    assert got == {i: (0, i % 4) for i in range(60)}
    cut = gn.frontier(rows, 2, attempt, F.col("left") > 0)
    assert sorted(r["left"] for r in cut.collect()) == [0] * 45 + [1] * 15
    assert gn.frontier(rows.limit(0), 2, attempt, F.col("left") > 0).count() == 0
