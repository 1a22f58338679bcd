"""What many conditions look at is worked out once for a row: its pattern stands once in the plan."""

from __future__ import annotations

import pytest

from inkwell.plans import QUERIES

SF = "/root/testdata/sf0.001"
SENTENCES, TOKENS = r"([.!?])\s+", r"[\p{L}\p{N}_]+"


@pytest.mark.parametrize(("name", "pattern"), [("rhetoric_heuristic", SENTENCES), ("context_index", TOKENS), ("tagged_words", TOKENS), ("structure_tags", TOKENS), ("repeated_bigrams", TOKENS)])
def test_pattern_stands_once(spark, name, pattern):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(pattern) == 1
