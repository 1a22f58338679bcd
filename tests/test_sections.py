"""Sections of a text read as a map, in time that grows with the text."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from inkwell.functions import asking as ak


def test_last_of_equal_names_counts(spark):
    texts = ["", "no section", "## A\none\n## B\ntwo\n## A\nthree", "## \nbare\n## C", "before\n## X\n  a\nb \n## Y\n\n## X\n", None]
    got = [r["m"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ak.sections(F.col("t")).alias("m")).collect()]
    assert got == [{}, {}, {"B": "two", "A": "three"}, {"": "bare", "C": ""}, {"Y": "", "X": ""}, None]


def test_many_sections_take_linear_time(spark):
    text = "\n".join(f"## P{i % 3}\nbody {i}" for i in range(20_000))
    began = time.perf_counter()
    assert spark.createDataFrame([(text,)], "t string").select(ak.sections(F.col("t")).alias("m")).first()["m"] == {f"P{i % 3}": f"body {i}" for i in range(20_000)}
    assert time.perf_counter() - began < 20
