"""Shared plumbing: shared-folder tables, bounded samples, distributed ranks and components."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_libc = ctypes.CDLL(None)
ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and keep Arrow batches small enough for long texts."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session's spark.checkpoint.dir where it is set. Else the folder set on
    the context, else one beside the warehouse; a temporary folder serves only
    a local master, where all threads see the same disk.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if context.master.startswith("local"):
        made = tempfile.mkdtemp(prefix="inkwell-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        context.setCheckpointDir(made)
        return made
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_inkwell"


def keep(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends, lost executors cost nothing.

    The table stays until the cleaner of the cluster removes it, as
    the result that a caller holds may still read it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/inkwell-{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns cannot clash with an operator's own."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def bounded_sample(df: DataFrame, key: str, most: int, seed: int = 7) -> DataFrame:
    """Rows of df whose key is among at most `most` sampled keys.

    Keys are compared by their hash against the hash of the last one taken, so
    nothing but one number is shipped and the scan stays a plain filter.
    """
    order = F.xxhash64(F.lit(seed), F.col(key))
    last = df.where(F.col(key).isNotNull()).select(order.alias("_o")).distinct().orderBy("_o").limit(most).agg(F.max("_o")).first()[0]
    return df.where(F.col(key).isNotNull() & (order <= F.lit(last))) if last is not None else df.limit(0)


def running(df: DataFrame, group: list[str], order: list[Column], amount: Column, out: str, rows: int, per: int = 20_000, hashed: tuple[Column, Column] | None = None) -> DataFrame:
    """Exclusive running sum of `amount` inside each group, without one task per group.

    Rows of a group are dealt into cells by the leading bits of a hash of the
    order columns; cells are numbered in hash order, so the running sum of a
    row is the sum of its group's earlier cells plus that inside its cell. The
    order of rows is therefore (hash, order columns): fixed, and the same in
    each run. A cell holds about `per` rows whatever the size of its group.
    `rows` is the number of rows of df, from which the number of cells follows.
    hashed: another hash, and the same as a number from 0 to 1 in its order.
    """
    cells = max(1, -(-rows // per))
    h, unit = hashed or (F.xxhash64(*order), F.xxhash64(*order).cast("double") / F.lit(2.0**64) + 0.5)
    cell = F.least(F.floor(unit * cells), F.lit(cells - 1)).cast("int")
    df = df.withColumn("_h", h).withColumn("_cell", cell).withColumn("_amount", amount)
    named = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    sums = df.groupBy(*named, F.col("_cell").alias("_c")).agg(F.sum("_amount").alias("_sum"))
    keys = [f"_g{i}" for i in range(len(group))]
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    # a table of known size: Spark can see at planning time whether it is small, before it shuffles df for the join
    sums = keep(sums.select(*keys, "_c", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_cellstart")), "cells")
    on = F.col("_cell") == F.col("_c")
    for g, k in zip(group, keys, strict=True):
        on = on & F.col(g).eqNullSafe(F.col(k))
    joined = df.join(sums, on, "left").drop("_c", *keys)
    inside = Window.partitionBy(*group, "_cell").orderBy("_h", *order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_amount").over(inside), F.lit(0)) + F.col("_cellstart")
    return joined.withColumn(out, start.cast("long")).drop("_h", "_cell", "_amount", "_cellstart")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of the undirected edges (a, b); component is the smallest id reachable.

    Each round points every node at its smallest neighbour, follows the
    pointers to their roots by doubling, and contracts the edges to roots. A
    round leaves at most half of the nodes that still have edges. Every round's
    tables are written to the shared folder; nothing but counts reaches the
    driver.
    """
    live = keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        if live.isEmpty():
            break
        both = live.union(live.select("b", "a"))
        to = keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("root")), "roots")
        while True:
            up = to.select(F.col("id").alias("_i"), F.col("root").alias("_r"))
            on = to.join(up, to["root"] == up["_i"], "left").select("id", F.coalesce("_r", "root").alias("root"), (F.coalesce("_r", "root") != F.col("root")).alias("moved"))
            on = keep(on, "roots")
            moved = not on.where("moved").isEmpty()
            to = on.drop("moved")
            if not moved:
                break
        up = to.select(F.col("id").alias("_i"), F.col("root").alias("_r"))
        if labels is None:
            labels = to
        else:
            labels = keep(labels.join(up, labels["root"] == up["_i"], "left").select("id", F.coalesce("_r", "root").alias("root")), "labels")
        at_a = live.join(up, live["a"] == up["_i"]).select(F.col("_r").alias("a"), "b")
        at_b = at_a.join(up, at_a["b"] == up["_i"]).select("a", F.col("_r").alias("b"))
        live = keep(at_b.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.sparkSession.createDataFrame([], "id long, component long")
    return labels.select("id", F.col("root").alias("component"))


def trim() -> None:
    """Give freed memory back to the system where the C library can, as workers live on from stage to stage."""
    give_back = getattr(_libc, "malloc_trim", None)
    if give_back:
        give_back(0)


def chunks(texts: list, most: int = 250_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` characters each, so that work arrays stay small; a longer text is its own range. Memory is trimmed at the end."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n + 1
    if begin < len(texts):
        yield begin, len(texts)
    trim()


def boxed(docs: DataFrame, *used: str) -> DataFrame:
    """The used columns, and all others in one struct `_rest`, so that no name of theirs can clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*(F.col(f"`{c}`") for c in used), (F.struct(*rest) if rest else F.lit(None).cast("int")).alias("_rest"))


def unboxed(df: DataFrame, columns: list[str], *used: str) -> DataFrame:
    """What was boxed, in the order of `columns`."""
    return df.select(*(F.col(f"`{c}`") if c in used else F.col("_rest")[c].alias(c) for c in columns))
