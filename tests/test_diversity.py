"""How new structures are, against all pairs of paragraphs, and in a long text."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.operators import sequence as sq

ROWS = "doc_id int, pos int, opener string, lengths array<string>, types array<string>"


def overlap(a, b):
    return sum(x == y for x, y in zip(a, b)) / max(len(a), len(b)) if a and b else 0.0


def alike(x, y):
    if x == y:
        return 1.0
    n, m = len(x[1]), len(y[1])
    return (1.0 - abs(n - m) / max(n, m, 1)) * 0.15 + 0.35 * ((x[0] or "none").lower() == (y[0] or "none").lower()) + overlap(x[1], y[1]) * 0.15 + overlap(x[2], y[2]) * 0.35


def made(rng, most):
    n = rng.randint(0, most)
    return rng.choice(["The", "the", "But", "none", None]), [rng.choice(["short", "long", "1:short"]) for _ in range(n)], [rng.choice("abcd") for _ in range(n)]


def test_all_pairs(spark):
    rng = random.Random(8)
    rows = [(d, i, *made(rng, 4)) for d in range(12) for i in range(d * 5)]
    got = {(r.doc_id, r.pos): r.diversity for r in sq.diversity(spark.createDataFrame(rows, ROWS)).collect()}
    assert len(got) == len(rows)
    for d, i, *x in rows:
        assert abs(got[d, i] - (1.0 - max((alike(x, y) for e, j, *y in rows if e == d and j < i), default=0.0))) < 2e-6


def test_long_text(spark):
    rng = random.Random(9)
    rows = spark.createDataFrame([(1, i, *made(rng, 60)) for i in range(2500)], ROWS)
    sq.diversity(rows.where("pos < 5")).collect()
    began = time.time()
    assert len(sq.diversity(rows).collect()) == 2500
    assert time.time() - began < 30


def test_strip(spark):
    edges = spark.createDataFrame([(" \t\n\x0b\f\ra b\r\n ",), ("a  ",), (" \n",), ("",), (None,)], "t string")
    assert [r[0] for r in edges.select(tx.strip(F.col("t"))).collect()] == ["a b", "a  ", "", "", None]  # the second as in SQL
