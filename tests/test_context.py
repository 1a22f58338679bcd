"""Nearest contexts by cell against comparing all with all, and templates by hand."""

from __future__ import annotations

import random
from collections import Counter
from itertools import product

from pyspark.sql import functions as F

from inkwell.operators import context as ct

VALUES = [["first", "middle", "last"], ["first", "middle", "last"], ["Simple", "Compound", "Complex", "Fragment"], ["Positive", "Negative", "Neutral"], ["short", "medium", "long"]]


def invented(rng: random.Random, n: int, cells: int) -> list[tuple]:
    known = rng.sample(list(product(*VALUES)), cells)
    return [(rng.randrange(40), i // 3, i % 3, *rng.choice(known), " ".join(rng.choice(["the", "river", "quickly", "ran", "of", "beautiful"]) for _ in range(rng.randrange(0, 14)))) for i in range(n)]


def plain_template(tags: list[list[str]], target: int) -> list[str]:
    tags = [t for t in tags if t]
    fill = lambda n: [ct.FILL[i % 5] for i in range(n)]
    if not tags:
        return fill(target)
    mean = sum(map(len, tags)) // len(tags)
    n = target if abs(target - mean) <= ct.CLOSE else mean
    out = []
    for i in range(n):
        here = [t[i] for t in tags if i < len(t)]
        out.append(Counter(here).most_common(1)[0][0] if here else ct.OPENING[min(i, 2)])
    return out[:target] + fill(target - n)


def test_nearest_contexts_and_templates_equal_all_pairs(spark):
    rng = random.Random(5)
    for n, cells in ((400, 60), (30, 30), (4, 2)):
        rows = list({r[:3]: r for r in invented(rng, n, cells)}.values())
        frame = spark.createDataFrame(rows, "doc_id long, para_idx int, sent_idx int, para_pos string, sent_pos string, previous_type string, sentiment string, length string, sentence string")
        tags = {tuple(r)[:3]: r["tags"] for r in frame.select(*ct.ID, ct.an.tags(F.col("sentence")).alias("tags")).collect()}
        for r in ct.statistical_templates(frame, frame).collect():
            own = next(x for x in rows if x[:3] == tuple(r)[:3])
            want = sorted((sum(a != b for a, b in zip(own[3:8], x[3:8], strict=True)), x[:3]) for x in rows if x[:3] != own[:3])[:5]
            assert [tuple(x) for x in r["nearest"]] == [x for _, x in want] and r["distances"] == [d for d, _ in want]
            assert r["template"] == plain_template([tags[x] for _, x in want], len(own[8].split()))


def test_index_is_bounded(spark):
    rows = [(i, 0, 0, *(v[i % len(v)] for v in VALUES), "the river ran") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, para_idx int, sent_idx int, para_pos string, sent_pos string, previous_type string, sentiment string, length string, sentence string")
    index = ct.cell_index(frame, 5)
    assert index.groupBy("mask", "key").count().agg(F.max("count")).first()[0] == 6
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "One. Two two! " * 3)], "doc_id long, text string")
    got = ct.contexts(docs).collect()
    assert {r["doc_id"] for r in got} == {3} and [r["sent_pos"] for r in sorted(got, key=lambda r: r["sent_idx"])][::5] == ["first", "last"]
