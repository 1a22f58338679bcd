"""Long sentences and texts of many equal words cost their length; values are held against plain ones."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from inkwell.functions import annotate as an
from inkwell.operators import measure as ms

WORDS = ["stone", "ran", "the", "went", "we", "old", "slept", "of"]


def test_triples_equal_plain_ones(spark):
    kinds = {"stone": "NOUN", "we": "NOUN", "old": "NOUN", "ran": "VERB", "went": "VERB", "slept": "VERB"}
    rng = random.Random(3)
    texts = [[rng.choice(WORDS) for _ in range(rng.randrange(0, 12))] for _ in range(200)]

    def plain(t):
        near = lambda ws: [w for w in ws if kinds.get(w) == "NOUN"]
        return ["|".join([(near(t[:i]) or [""])[-1], w, (near(t[i + 1 :]) or [""])[0]]) for i, w in enumerate(t) if kinds.get(w) == "VERB"]

    got = [r["x"] for r in spark.createDataFrame([(" ".join(t),) for t in texts], "t string").select(an.triples(F.col("t")).alias("x")).collect()]
    assert got == [plain(t) for t in texts]


def test_triples_of_a_long_sentence(spark):
    rows = spark.createDataFrame([("stone ran " * 10_000,)], "t string")
    began = time.perf_counter()
    assert rows.select(F.size(an.triples(F.col("t"))).alias("n")).first()["n"] == 10_000
    assert time.perf_counter() - began < 15


def test_distance_to_the_nearest_verb(spark):
    rng = random.Random(4)
    texts = [[rng.choice(WORDS) for _ in range(rng.randrange(1, 15))] for _ in range(100)] + [["stone", "ran"] * 10_000]
    verbs = [[i for i, w in enumerate(t) if w in ("ran", "went", "slept")] for t in texts]
    want = [sum(min(abs(v - i) for v in vs) if len(t) < 100 else i % 2 == 0 for i in range(len(t))) / len(t) if vs else 0.0 for t, vs in zip(texts, verbs, strict=True)]
    rows = spark.createDataFrame([(i, " ".join(t) + ".") for i, t in enumerate(texts)], "i int, paragraph string")
    began = time.perf_counter()
    got = {r["i"]: r["complexity"] for r in ms.paragraph_features(rows, 1).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want)
    assert time.perf_counter() - began < 30
