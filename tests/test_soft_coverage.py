"""Coverage by letters against all pairs of words, and on turns of many words."""

from __future__ import annotations

import random
import time
from math import sqrt

import pytest
from pyspark.sql import functions as F

from inkwell.functions import judge as jd


def triples(w):
    return {f"#{w}#"[i : i + 3] for i in range(len(w))}


def alike(a, b):
    return len(a & b) / sqrt(len(a) * len(b))


def covered(spark, rows):
    x = jd.soft_coverage(F.col("a"), F.col("b"))
    return [None if r.x is None else (r.x.coverage, r.x.missing) for r in spark.createDataFrame(rows, "id int, a string, b string").coalesce(1).select("id", x.alias("x")).orderBy("id").collect()]


def test_all_pairs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("xyzé") for _ in range(rng.randint(3, 14)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60))), " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(60)]
    for (_, a, b), got in zip(rows, covered(spark, rows)):
        a, b = sorted(set(a.split())), [triples(w) for w in set(b.split())]
        missing = [w for w in a if not any(alike(triples(w), t) > 0.7 for t in b)]
        assert got == (None if not a else (pytest.approx(1.0 - len(missing) / len(a)), missing))


def test_edges(spark):
    assert covered(spark, [(1, "river", None), (2, None, "river"), (3, "", "river"), (4, "river", ""), (5, "river banks", "rivers")]) == [(1.0, []), None, None, (0.0, ["river"]), (0.5, ["banks"])]


def test_many_words(spark):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(4000)) for _ in range(2)]
    covered(spark, [(1, "one two", "three four")])
    began = time.time()
    assert len(covered(spark, [(1, *texts)])[0][1]) > 3900
    assert time.time() - began < 15  # 16 million pairs of words, of which few share a triple
