"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

Every source has a weight schedule over training time 0 to 1, piecewise linear.
Its integral is the share of the source's tokens that training has asked for
by then; a document that begins at some share of them is due at the time where
the integral reaches that share. Documents are sorted by that time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import boxed, clean, keep, running, unboxed

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: Schedules as (time, weight) knots: falling, even, rising.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: A word: a run without blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, *, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, rank (from 0), weight, target.

    Sources by code point, null last, take the weights in turn and divide
    share x all sizes by weight. A target stops at most x its source's size;
    what lies above is divided anew. In order of cap by weight the sources
    that stop come first, so one ordered pass over the sources finds them.
    """
    by = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    every = Window.partitionBy()
    ranked = by.withColumn("rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    level = every.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every) * share
    steps = capped.select("*", (total - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("_left"), F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)).alias("_weights"))
    stops = steps.withColumn("_stops", F.col("cap") / F.col("weight") <= F.col("_left") / F.col("_weights"))
    going = F.when(~F.col("_stops"), F.col("cap") / F.col("weight"))
    first = F.min(F.when(~F.col("_stops"), F.struct(going.alias("r"), F.col("rank"), (F.col("_left") / F.col("_weights")).alias("level")))).over(every)
    target = F.when(F.col("_stops"), F.col("cap").cast("double")).otherwise(F.col("weight") * first["level"])
    return stops.select("source", "source_size", "rank", "weight", target.alias("target"))


def due(share: Column, rank: Column, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> Column:
    """The time at which the integral of the source's schedule reaches this share of its whole."""
    found: Column = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        parts, whole = [], sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False))
        before = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            area = (t1 - t0) * (w0 + w1) / 2
            parts.append((before, t0, t1, w0, (w1 - w0) / (t1 - t0)))
            before += area
        time: Column = F.lit(None).cast("double")
        for start, t0, t1, w0, slope in parts:  # the last part that begins at or before the demand
            r = share * whole - start
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * r, F.lit(0.0)))
            time = F.when(share * whole >= start, F.least(F.lit(t0) + F.when(r > 0, F.lit(2.0) * r / (F.lit(w0) + root)).otherwise(0.0), F.lit(t1))).otherwise(time)
        found = F.when(rank % len(schedules) == k, time).otherwise(found)
    return found


def assign(sized: DataFrame, *, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> DataFrame:
    """Adds source_size, target, taken, rank and takes to rows that have doc_id, source and size.

    takes: array of (pass, words, position) for each pass over the source that
    takes words of the document. A source's documents follow each other in the
    order of md5(doc_id), doc_id, size; passes go round until the target's
    words are taken, so only the last document taken can be taken in part, and
    sizes taken add up to the target's whole part. Rows that are equal take any
    order among themselves. Documents without words are never taken. A null
    source is a source of its own; an empty table gives an empty one.
    """
    number = sized.count()
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    unit = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    placed = running(sized, ["source"], [F.col("doc_id"), F.col("size")], F.col("size"), "_before", number, hashed=(digest, unit))
    by = keep(targets(sized, weights=weights, share=share, most=most), "targets").withColumnRenamed("source", "_source")
    joined = placed.join(by, placed["source"].eqNullSafe(by["_source"]), "left").drop("_source", "weight")

    def taking(k: int) -> Column:
        begin = F.col("_before") + k * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.floor("target").cast("long") - begin, F.col("size")))
        return F.struct(F.lit(k).alias("pass"), words.cast("long").alias("words"), due(begin / F.greatest(F.col("target"), F.lit(1.0)), F.col("rank"), schedules).alias("position"))

    takes = F.filter(F.array(*(taking(k) for k in range(most))), lambda t: t["words"] > 0)
    taken = joined.withColumn("takes", takes).withColumn("taken", F.aggregate("takes", F.lit(0).cast("long"), lambda a, t: a + t["words"]))
    return taken.drop("_before")


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, passes, position (null if not taken), in range-sorted order of position."""
    sized = keep(clean(docs, "doc_id", "source", "text").select("doc_id", "source", sizes(docs).alias("size")), "sizes")
    out = assign(sized).select("doc_id", "size", "source_size", "target", "taken", F.size("takes").alias("passes"), F.get("takes", F.lit(0))["position"].alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id", "size")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix in training order, one row for each time one is taken; a document taken in part keeps its first words."""
    used = ["doc_id", "source", "text"]
    one = assign(boxed(docs, *used).withColumn("size", sizes(docs))).withColumn("take", F.explode("takes"))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("take.words").cast("int")), "")
    text = F.when(F.col("take.words") < F.col("size"), part).otherwise(F.col("text"))
    whole = one.repartitionByRange("take.position", "doc_id", "take.pass").sortWithinPartitions("take.position", "doc_id", "take.pass").withColumn("text", text)
    out = unboxed(whole, docs.columns, *used)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM by_source),
capped AS (SELECT *, CAST(CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, source_size * 2 AS cap FROM ranked),
steps AS (SELECT *, (sum(source_size) OVER ()) * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
  sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM capped),
stops AS (SELECT *, cap / weight <= remaining / weights AS stopped FROM steps),
targets AS (SELECT source, source_size, rank, CASE WHEN stopped THEN CAST(cap AS DOUBLE) ELSE weight * (SELECT remaining / weights FROM stops WHERE NOT stopped ORDER BY cap / weight, rank LIMIT 1) END AS target FROM stops),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized),
taking AS (SELECT doc_id, size, source_size, target, rank, before,
  greatest(0, least(CAST(floor(target) AS BIGINT) - before, size)) AS first, greatest(0, least(CAST(floor(target) AS BIGINT) - before - source_size, size)) AS second
  FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.source),
shares AS (SELECT *, CAST(CASE WHEN first > 0 THEN before ELSE before + source_size END AS DOUBLE) / greatest(target, 1.0) AS share FROM taking)
SELECT doc_id, size, source_size, target, CAST(first + second AS BIGINT) AS taken, CAST((first > 0)::INT + (second > 0)::INT AS INT) AS passes,
  CASE WHEN first + second > 0 THEN round(least(CASE rank % 3 WHEN 0 THEN 2.0 * share / (1.5 + sqrt(greatest(2.25 - 2.0 * share, 0.0))) WHEN 1 THEN 2.0 * share / (1.0 + sqrt(1.0)) ELSE 2.0 * share / (0.5 + sqrt(greatest(0.25 + 2.0 * share, 0.0))) END, 1.0), 6) END AS position
FROM shares
"""
