"""Metric joins and leaders against comparing all with all."""

from __future__ import annotations

import numpy as np
import pytest

from inkwell.operators import metric as me


def frame(spark, x: np.ndarray, labels: int):
    odd = [(9000, None, 0), (9001, [0.0] * x.shape[1], 0), (9002, [1.0, 2.0], 0), (9003, [float("nan")] * x.shape[1], 0), (9004, [2.0, 4.0], 0)]
    return spark.createDataFrame([(i, [float(v) for v in r], i % labels) for i, r in enumerate(x)] + odd, "id long, v array<double>, label int")


def vectors(kind: str) -> np.ndarray:
    rng = np.random.default_rng(3)
    if kind == "clusters":
        return np.repeat(rng.normal(size=(12, 6)), 30, axis=0) + rng.normal(size=(360, 6)) * 0.1
    if kind == "copies":
        return np.concatenate([np.repeat(rng.normal(size=(1, 6)), 150, axis=0), rng.normal(size=(150, 6))])
    return rng.normal(size=(300, 6))


@pytest.mark.parametrize("kind", ["clusters", "copies", "random"])
def test_nearest_equal_all_pairs(spark, kind):
    x = vectors(kind)
    rows = me.unit(frame(spark, x, 2), "id", "v", by="label")
    got: dict[int, list] = {}
    for r in me.nearest(rows, rows, 4, pivots=7, bands=3, block=20).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["id"], r["likeness"]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    like = np.round(u @ u.T, 6)
    for q in range(len(x)):
        want = sorted((-like[q, i], i) for i in range(len(x)) if i != q and i % 2 == q % 2)[:4]
        assert [i for _, i, _ in sorted(got[q])] == [i for _, i in want], q
    assert [i for _, i, _ in got[9002]] == [9004] and got[9004][0][1:] == (9002, 1.0) and not {9000, 9001, 9003} & set(got)


def test_blocks_are_pruned(spark):
    rows = me.kept(me.unit(frame(spark, vectors("clusters"), 1), "id", "v"), "t")
    table, cells = me.index(rows, 3, pivots=12, bands=2, block=20)
    blocks = table.select("block").distinct().count()
    assert me.routed(rows, cells, k=3).count() < 0.4 * rows.count() * blocks
    assert me.met(me.routed(rows, cells, radius=2.0), table, -1.0, 0, 1).count() == 360 * 359 + 2


@pytest.mark.parametrize("kind", ["clusters", "copies", "random"])
def test_leaders_equal_taking_turns(spark, kind):
    x = vectors(kind)[:200]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want, known = {}, []
    for i in range(len(u)):
        like = [j for j in known if round(float(u[i] @ u[j]), 6) >= 0.7]
        want[i] = like[0] if like else i
        if not like:
            known.append(i)
    got = {r["id"]: r["leader"] for r in me.leaders(me.unit(frame(spark, x, 1), "id", "v"), 0.7, pivots=6, bands=3, block=16).collect()}
    assert {i: got[i] for i in want} == want and got[9004] == 9002 == got[9002]


def test_empty_tables(spark):
    none = me.unit(frame(spark, vectors("random"), 1).limit(0), "id", "v")
    assert me.nearest(none, none, 3).count() == 0 and me.leaders(none, 0.7).count() == 0


def test_small_cells_share_a_block(spark):
    rows = me.kept(me.unit(frame(spark, np.random.default_rng(5).normal(size=(600, 6)), 1), "id", "v"), "t")
    table, cells = me.index(rows, 3)
    assert table.select("block").distinct().count() == 2  # one for each dimension
    assert me.routed(rows, cells, k=3).count() == rows.count()
