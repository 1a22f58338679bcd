"""Archetypes by fixed rounds: seeds, inertia, ties."""

from __future__ import annotations

import numpy as np

from inkwell.operators import cluster as cu


def test_inertia_falls_and_centres_equal_plain_rounds(spark):
    rng = np.random.default_rng(5)
    x = np.round(np.concatenate([rng.normal(m, 1, size=(40, 3)) for m in (0, 6, -6)]), 6)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").cache()
    seeds = cu.farthest_first(rows, "id", "v", 4)
    chosen = [0]
    while len(chosen) < 4:
        far = np.round(np.sqrt(((x[:, None] - x[chosen][None]) ** 2).sum(axis=2)).min(axis=1), 6)
        chosen.append(int(np.argmax(far)))
    assert [c for _, c in seeds] == [x[i].tolist() for i in chosen]
    centres, inertia = cu.lloyd(rows, "id", "v", seeds, 5)
    own = x[chosen]
    for _ in range(5):
        at = np.round(np.sqrt(((x[:, None] - own[None]) ** 2).sum(axis=2)), 9).argmin(axis=1)
        own = np.array([np.round(x[at == k].mean(axis=0), 6) if (at == k).any() else own[k] for k in range(4)])
    assert np.allclose([c for _, c in centres], own, atol=2e-6)
    assert len(inertia) == 6 and all(b <= a + 1e-3 for a, b in zip(inertia, inertia[1:], strict=False)) and inertia[-1] < inertia[0]


def test_few_and_equal_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, v array<double>")
    assert cu.farthest_first(same, "id", "v", 3) == [(0, [1.0, 2.0])] and cu.farthest_first(same.limit(0), "id", "v", 3) == []
    assert cu.lloyd(same, "id", "v", [(0, [1.0, 2.0]), (1, [9.0, 9.0])], 2)[0] == [(0, [1.0, 2.0]), (1, [9.0, 9.0])]
    flat = cu.standardised(spark.createDataFrame([(1, 2.0, 1.0), (2, 2.0, 3.0)], "id long, a double, b double"), ["a", "b"], "id")
    assert sorted(r["features"] for r in flat.collect()) == [[0.0, -1.0], [0.0, 1.0]]
