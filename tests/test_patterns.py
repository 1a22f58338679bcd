"""Patterns on their worst shapes: Java's matcher must neither run out of stack nor take the square of the length."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from inkwell.functions import annotate as an
from inkwell.functions import compare as cp
from inkwell.functions import feedback as fb
from inkwell.functions import gates as gt
from inkwell.functions import rewrite as rw
from inkwell.functions import text as tx

UNITS = [" ", "a", "A", "1", ".", "'", '"', "\n", "\r", "a ", "Aa ", "a-", '"a', "'\\", '\\"', "(A", "(Aa, ", "[^1", "NP", "R", "RJ", "DR", "NCN", "{a", "X", "!", "1. "]
PATTERNS = [rw.SPANS, rw.MARKS, rw.BLANKS + "$", *rw.AUTHOR_YEAR, f"(?:{rw.BLANKS})?+" + rw.AUTHOR_YEAR[0], rw.NUMBERED, rw.CONTROL, gt.EDGES, an.RUN, cp.QUOTE, cp.CITATION, rf"^\s++|{tx.run(r'\s')}$", tx.run("[.!?]") + r"\s++", r"([.!?])\s+", tx.WORD]


def took(spark, pattern: str, unit: str, length: int) -> float:
    found = spark._jvm.java.util.regex.Pattern.compile(pattern)
    text = "x" + unit * (length // len(unit)) + "\u0002"
    began = time.perf_counter()
    found.matcher(text).replaceAll("")
    return time.perf_counter() - began


@pytest.mark.parametrize("pattern", PATTERNS)
def test_long_runs_take_linear_time(spark, pattern):
    for unit in UNITS:
        assert took(spark, pattern, unit, 100_000) < 3, unit


@pytest.mark.parametrize("pattern", [rw.SPANS, an.RUN])
def test_a_million_characters_need_no_stack(spark, pattern):
    for unit in ["a", "'", "'\\", "\\\"", "NP", "NCN", "DR"]:
        assert took(spark, pattern, unit, 1_000_000) < 20, unit


def test_long_quotes_and_brackets_leave_the_session_alive(spark):
    texts = ["it's " + "word " * 40_000 + "it's", "'" + "\\'" * 100_000, "[" * 100_000, "{" * 100_000 + "}", "a" + "." * 100_000 + "b", "x" + " " * 200_000 + "y", "nouns " * 30_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    out = rows.select(F.length(rw.clean_generated(c)).alias("a"), F.length(fb.json_text(c)).alias("b"), F.size(fb.json_list(c)).alias("c"), gt.anchors(c).alias("d"), F.size(an.phrases(F.substring(c, 1, 3000))).alias("e")).collect()
    assert len(out) == len(texts) and out[0]["a"] == len(texts[0])


def test_quotes_that_end_in_a_backslash(spark):
    """A backslash takes the next character with it, so such a quote goes on to the next mark."""
    got = spark.createDataFrame([('"a\\" , b" , c',), ('"a , b\\',)], "t string").select(F.regexp_extract("t", rw.SPANS, 0).alias("q")).collect()
    assert [r["q"] for r in got] == ['"a\\" , b"', ""]


def test_outermost_json_equals_the_plain_pattern(spark):
    import re

    texts = ['x {"a": [1]} y', "] [1, 2] }", "} {", "[{]}", "a [b {c} d", "{[}", "", "[1] {2}"]
    got = [r["o"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fb.outermost(F.col("t")).alias("o")).collect()]
    want = [(m.group(0) if (m := re.search(r"(?s)\{.*\}|\[.*\]", t)) else "") for t in texts]
    assert got == want
