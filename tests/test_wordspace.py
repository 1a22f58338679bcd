"""Word vectors against a plain computation, and likeness by them."""

from __future__ import annotations

import hashlib
import math
import random
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.operators import wordspace as ws
from inkwell.sources.shared import CLEANUP, shared_dir

FRAMES = ["the {} drove along the wet road to town", "she parked her {} near the old bridge", "a {} needs fuel and four good wheels", "the driver of the {} turned left"]
OTHER = ["the {} was baked with flour and butter", "they ate the {} with honey for breakfast", "a warm {} smelled sweet on the table"]


def plain(texts: list[str]) -> dict[str, tuple[int, list[int]]]:
    counts: Counter = Counter()
    for t in texts:
        w = t.lower().split()
        for i in range(len(w)):
            for j in range(max(0, i - ws.WINDOW), min(len(w), i + ws.WINDOW + 1)):
                if i != j:
                    counts[w[i], w[j]] += 1
    totals: Counter = Counter()
    for (a, _), n in counts.items():
        totals[a] += n
    whole = float(sum(totals.values()))
    out = {a: (n, [0] * ws.WIDTH) for a, n in totals.items()}
    for (a, b), n in counts.items():
        w = math.floor(max(0.0, math.log((n * whole) / (float(totals[a]) * float(totals[b])))) * ws.MICRO + 0.5)
        for j, digit in enumerate(hashlib.md5(b.encode()).hexdigest()):
            out[a][1][j] += w if digit < "8" else -w
    return out


def corpus() -> list[str]:
    rng = random.Random(4)
    return [rng.choice(FRAMES).format(rng.choice(["car", "automobile"])) for _ in range(120)] + [rng.choice(OTHER).format(rng.choice(["cake", "bread"])) for _ in range(120)] + ["alone", "go go go"]


def test_vectors_equal_plain_computation(spark):
    texts = corpus()
    frame = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string").select(tx.tokens(F.col("text")).alias("tokens"))
    want = plain(texts)
    got = {r["word"]: (r["total"], r["vector"]) for r in ws.vectors(frame).collect()}
    assert got.keys() == want.keys() and "alone" not in got
    for word, (total, vector) in want.items():
        assert got[word][0] == total and all(abs(a - b) <= 40 for a, b in zip(got[word][1], vector, strict=True)), word


def test_words_of_like_use_meet(spark):
    space = ws.vectors(spark.createDataFrame([(t,) for t in corpus()], "text string").select(tx.tokens(F.col("text")).alias("tokens"))).cache()
    v = {r["word"]: r["u"] for r in space.select("word", ws.unit(F.col("vector")).alias("u")).collect()}
    like = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=True))
    assert like("car", "automobile") > 0.8 and like("cake", "bread") > 0.8 and like("car", "cake") < 0.5
    rows = spark.createDataFrame([(1, ["car", "road"], ["automobile", "road"]), (2, ["car"], ["bread"]), (3, ["unseen", "car"], ["unseen"]), (4, ["car"], None), (5, [], ["car"])], "id long, a array<string>, b array<string>")
    got = {r["id"]: (r["n"], r["missing"]) for r in ws.coverage(rows, "id", F.col("a"), F.col("b"), space, 0.6).collect()}
    assert got == {1: (2, []), 2: (1, ["car"]), 3: (2, ["car"]), 4: (1, ["car"]), 5: (0, [])}


def test_totals_are_not_broadcast(spark):
    """A vocabulary times its parts passes through the driver if it is."""
    counted = spark.createDataFrame([("a", "b", 2), ("b", "a", 2), ("a", "a", 4)], "word string, near string, n long")
    totals = counted.groupBy("word").agg(F.sum("n").alias("total"))
    joined = ws.with_total(counted, totals, "word", "near", "tw")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["word"], r["near"], r["tw"]) for r in joined.collect()) == [("a", "a", 6), ("a", "b", 6), ("b", "a", 2)]


def shuffle_files(spark) -> set[str]:
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p.name for d in dirs for p in Path(d).rglob("shuffle_*.data")}


def test_many_chunks_and_buckets_equal_plain_computation(spark):
    """Frequent words are dealt out by the words they meet, and chunks and buckets are added up."""
    texts = corpus()
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3).select(tx.tokens(F.col("text")).alias("tokens"))
    got = {r["word"]: (r["total"], r["vector"]) for r in ws.vectors(frame, chunk=50, bucket=100).collect()}
    want = plain(texts)
    assert got.keys() == want.keys()
    for word, (total, vector) in want.items():
        assert got[word][0] == total and all(abs(a - b) <= 40 for a, b in zip(got[word][1], vector, strict=True)), word


def test_no_pairs_stay_on_the_disk(spark):
    """Shuffle files of counting go with each turn, and no table has a row for each pair."""
    rng = random.Random(5)
    texts = [(" ".join(f"w{rng.randrange(300)}" for _ in range(400)),) for _ in range(20)]
    before, tables = shuffle_files(spark), set(Path(shared_dir(spark).removeprefix("file:")).rglob("*.parquet"))
    ws.vectors(spark.createDataFrame(texts, "text string").select(F.split("text", " ").alias("tokens")))
    assert spark.conf.get(CLEANUP) == "false"
    for _ in range(50):
        left = shuffle_files(spark) - before
        if len(left) <= 12:
            break
        time.sleep(0.1)
    assert len(left) <= 12, left
    made = set(Path(shared_dir(spark).removeprefix("file:")).rglob("*.parquet")) - tables
    assert made and max(pq.read_metadata(p).num_rows for p in made) <= 3000


def left_by(spark, df) -> int:
    """Shuffle bytes on the disk when df has been written."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    now = lambda: sum(p.stat().st_size for d in dirs for p in Path(d).rglob("shuffle_*.data"))
    before = now()
    df.write.format("noop").mode("overwrite").save()
    return now() - before


def test_words_of_rows_carry_their_vectors_in_turns(spark):
    """What is left to do when coverage and means return shuffles no vectors, and every row is there."""
    space = ws.vectors(spark.createDataFrame([(t,) for t in corpus()], "text string").select(tx.tokens(F.col("text")).alias("tokens")))
    rows = spark.range(3000).select("id", F.split(F.lit("the car drove along the wet road"), " ").alias("a"), F.split(F.lit("the automobile turned left"), " ").alias("b"))
    covered = ws.coverage(rows, "id", F.col("a"), F.col("b"), space, 0.6)
    assert left_by(spark, covered) < 100_000 and covered.count() == 3000
    assert {(r["n"], tuple(r["missing"])) for r in covered.collect()} == {(7, tuple(covered.first()["missing"]))}
    sums = ws.means(rows, ["id"], F.col("a"), space)
    vector = {r["word"]: r["vector"] for r in space.collect()}
    want = [sum(v) for v in zip(*(vector[w] for w in "the car drove along the wet road".split()), strict=True)]
    assert left_by(spark, sums) < 100_000 and sums.count() == 3000 and {tuple(r["vector"]) for r in sums.collect()} == {tuple(want)}


def test_vectors_of_some_words_are_those_of_all(spark):
    frame = spark.createDataFrame([(t,) for t in corpus()], "text string").select(tx.tokens(F.col("text")).alias("tokens"))
    some = spark.createDataFrame([("car",), ("the",), ("car",), ("unseen",), ("alone",), (None,)], "word string")
    every = {tuple(r) for r in ws.vectors(frame).selectExpr("word", "total", "to_json(vector)").collect()}
    assert {tuple(r) for r in ws.vectors(frame, only=some, bucket=100).selectExpr("word", "total", "to_json(vector)").collect()} == {r for r in every if r[0] in ("car", "the")}


def test_packed_numbers_come_back():
    for numbers in ([], [0], [1, 255, 256], [-1, -(2**63), 2**63 - 1], list(range(1000))):
        assert ws.unpacked(ws.packed(np.array(numbers, np.int64))).tolist() == numbers
