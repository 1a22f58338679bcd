"""Search where queries are unlike the rows, norms differ widely, or components are far from 1."""

from __future__ import annotations

import numpy as np
import pytest

from inkwell.llm import ann


def rows(kind: str) -> np.ndarray:
    rng = np.random.default_rng(3)
    n, d = 6000, 32
    centres = rng.normal(size=(20, d))
    if kind == "queries apart":
        x = centres[rng.integers(0, 20, n)] + rng.normal(size=(n, d)) * 0.05
        x[::20] = rng.normal(size=(n // 20, d))
    elif kind == "norms apart":
        x = rng.normal(size=(n, d)) * np.exp(3 * rng.normal(size=(n, 1)))
    else:
        x = rng.normal(size=(n, d)) * 1e30
    return x


@pytest.mark.parametrize("kind", ["queries apart", "norms apart", "large"])
def test_recall_on_other_rows(spark, kind):
    x = rows(kind)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found: dict[int, set[int]] = {}
    for r in ann.search(table).select("query_id", "vec_id").collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    score = x[::20] @ x.T
    score[np.arange(len(score)), np.arange(0, len(x), 20)] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    hits = sum(len(found[20 * i] & set(b.tolist())) for i, b in enumerate(best))
    assert hits >= 0.9 * best.size, hits / best.size
