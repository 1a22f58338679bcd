"""Templates with ids of several parts."""

from __future__ import annotations

from inkwell.plans import choices


def test_templates_with_composed_ids_are_curated(spark):
    body = "The [NP] is [ADJ] because [CLAUSE]."
    rows = spark.createDataFrame([(f"12-0-{i}", body) for i in range(8)], "id string, template string")
    by_number = spark.createDataFrame([(i, body) for i in range(8)], "id int, template string")
    got = [(r["score"], r["valid"], r["kept"]) for r in choices.curate_templates(rows).orderBy("id").collect()]
    assert got == [(r["score"], r["valid"], r["kept"]) for r in choices.curate_templates(by_number).orderBy("id").collect()]
    assert [g[0] for g in got] == [3, 1, 2, 3, 4, 5, 3, 1]
