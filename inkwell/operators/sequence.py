"""Operators over the order of words, sentences and paragraphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as lx
from ..functions import text as tx


def runs(items: Column) -> Column:
    """(item, n) of each distinct item of a list of strings that it has more than once; one sort, then one pass."""

    def cut(xs: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(xs) - 1), lambda i: (i == 0) | (F.get(xs, i) != F.get(xs, i - 1)))
        each = tx.let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(xs, i).alias("item"), (F.coalesce(F.get(at, k + 1), F.size(xs)) - i).cast("long").alias("n"))))
        return F.when(F.size(xs) < 2, F.array().cast("array<struct<item: string, n: bigint>>")).otherwise(F.filter(each, lambda x: x["n"] > 1))

    return tx.let(F.sort_array(items), cut)


def repeated_grams(docs: DataFrame, n: int, key: str = "doc_id", *, content: bool = False) -> DataFrame:
    """n-grams that a text has more than once, without connectors; content: none with a function word. Counted within the row: nothing is shuffled."""

    def cut(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1)))
        if content:
            starts = F.filter(starts, lambda i: ~reduce(lambda a, b: a | b, (F.get(t, i + k - 1).isin(lx.STOPS) for k in range(n))))
        return F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " ")))

    found = F.explode_outer(runs(tx.let(tx.tokens(F.col("text")), cut))).alias("_r")
    return docs.select(key, found).where("_r IS NOT NULL").select(key, F.col("_r.item").alias("phrase"), F.col("_r.n").alias("n")).where(~tx.has_any(F.col("phrase"), lx.GLUE))  # connectors last: few phrases come again


def proximal(docs: DataFrame, key: str = "doc_id", reach: int = 10) -> DataFrame:
    """Words that are no function words and come again within `reach` words, with the least gap, once per text.

    (word, place) pairs are sorted within the row, so that uses of a word are
    neighbours there: nothing is shuffled.
    """
    kind = "array<struct<word: string, gap: bigint>>"
    placed = F.filter(F.transform(tx.tokens(F.col("text")), lambda w, i: F.struct(w.alias("word"), i.alias("pos"))), lambda x: ~x["word"].isin(lx.STOPS))

    def gaps(xs: Column) -> Column:
        near = F.filter(F.sequence(F.lit(1), F.size(xs) - 1), lambda i: (F.get(xs, i)["word"] == F.get(xs, i - 1)["word"]) & (F.get(xs, i)["pos"] - F.get(xs, i - 1)["pos"] <= reach))
        return F.when(F.size(xs) < 2, F.array().cast(kind)).otherwise(F.transform(near, lambda i: F.struct(F.get(xs, i)["word"].alias("word"), (F.get(xs, i)["pos"] - F.get(xs, i - 1)["pos"]).cast("long").alias("gap"))))

    def least(xs: Column) -> Column:
        return F.filter(xs, lambda x, i: (i == 0) | (x["word"] != F.get(xs, i - 1)["word"]))

    found = tx.let(F.sort_array(tx.let(F.sort_array(placed), gaps)), least)
    return docs.select(key, F.explode(found).alias("_g")).select(key, F.col("_g.word").alias("word"), F.col("_g.gap").alias("least_gap"))


def budget(tokens: DataFrame, allowed: int, distance: int, restricted: list[str] = lx.RESTRICTED) -> DataFrame:
    """doc_id, pos, word, status of each restricted token (doc_id, pos, token): FORBIDDEN beyond the allowance, else CLUSTERING_VIOLATION near an earlier use."""
    rows = tokens.select("doc_id", "pos", F.lower("token").alias("word")).where(F.col("word").isin(restricted))
    order = Window.partitionBy("doc_id", "word").orderBy("pos")
    seen = F.row_number().over(order) - 1
    near = F.coalesce(F.col("pos") - F.lag("pos").over(order) < distance, F.lit(False))
    return rows.withColumn("used", seen).withColumn("status", F.when(F.col("used") >= allowed, "FORBIDDEN").when(near, "CLUSTERING_VIOLATION").otherwise("ALLOWED"))


def opener_penalties(paragraphs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """What an opener costs at each paragraph (doc_id, pos, opener): 1 up to the threshold of its share so far, then falling."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("doc_id", "opener").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    share = F.count("*").over(same) / F.greatest(F.count("*").over(before), F.lit(1))
    return paragraphs.withColumn("share", F.when(F.col("opener").isNull(), 0.0).otherwise(share)).withColumn("penalty", F.when(F.col("share") <= threshold, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (F.col("share") - threshold) * 2.0)))


def placed(items: Column) -> Column:
    """Each item with its place, so that lists agree where these are equal."""
    return F.filter(F.transform(items, lambda x, i: F.concat(i.cast("string"), F.lit(":"), x)), lambda x: x.isNotNull())


def pattern_overlap(a: Column, b: Column, n: Column, m: Column) -> Column:
    """Places that agree, by the longer list; a and b are `placed`, n and m are the lists' sizes."""
    return F.when((n == 0) | (m == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(n, m))


def rhythm_shape(opener: Column, lengths: Column, types: Column) -> Column:
    """A structure as `rhythm_similarity` takes it."""
    return F.struct(F.lower(F.coalesce(opener, F.lit("none"))).alias("opener"), F.size(lengths).alias("n"), placed(lengths).alias("lengths"), F.size(types).alias("m"), placed(types).alias("types"))


def rhythm_similarity(a: Column, b: Column, best: Column | None = None) -> Column:
    """0.15 number of sentences, 0.35 opener, 0.15 lengths, 0.35 types; each side is a `rhythm_shape`. Given a best one so far, the greater: lists are compared only where their sizes leave a chance."""
    opener = (a["opener"] == b["opener"]).cast("double")
    count = 1.0 - F.abs(a["n"] - b["n"]) / F.greatest(a["n"], b["n"], F.lit(1))
    alike = count * 0.15 + opener * 0.35 + pattern_overlap(a["lengths"], b["lengths"], a["n"], b["n"]) * 0.15 + pattern_overlap(a["types"], b["types"], a["m"], b["m"]) * 0.35
    if best is None:
        return alike
    most = count * 0.3 + opener * 0.35 + F.least(a["m"], b["m"]) / F.greatest(a["m"], b["m"], F.lit(1)) * 0.35
    return F.when(most + 1e-9 < best, best).otherwise(F.greatest(best, alike))


def diversity(maps: DataFrame) -> DataFrame:
    """How new each paragraph's structure is among all paragraphs of its text before it: 0 if the same was there.

    maps: doc_id, pos, opener, lengths, types. A text is held once, as the list
    of its structures; only the first of equal ones is compared, with the first
    ones before it.
    """
    texts = maps.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "opener", "lengths", "types"))).alias("p"))

    def shaped(x: Column) -> Column:
        own = F.struct(x["opener"].alias("opener"), x["lengths"].alias("lengths"), x["types"].alias("types"))
        return F.struct(x["pos"].alias("pos"), F.to_json(own, {"ignoreNullFields": "false"}).alias("same"), rhythm_shape(x["opener"], x["lengths"], x["types"]).alias("shape"))

    def judge(p: Column) -> Column:
        def split(order: Column) -> Column:
            new = F.transform(order, lambda x, k: F.struct(x["i"].alias("i"), ((k == 0) | (x["same"] != F.get(order, k - 1)["same"])).alias("new")))
            return tx.let(new, lambda o: F.concat(seen(o), tx.let(F.transform(F.sort_array(F.transform(F.filter(o, lambda x: x["new"]), lambda x: x["i"])), lambda i: F.get(p, i)), compared)))

        def seen(o: Column) -> Column:
            return F.transform(F.filter(o, lambda x: ~x["new"]), lambda x: F.struct(F.get(p, x["i"])["pos"].alias("pos"), F.lit(0.0).alias("diversity")))

        def compared(q: Column) -> Column:
            most = lambda x, k: F.aggregate(F.slice(q, F.lit(1), k), F.lit(0.0), lambda best, y: rhythm_similarity(y["shape"], x["shape"], best))
            return F.transform(q, lambda x, k: F.struct(x["pos"].alias("pos"), F.round(1.0 - most(x, k), 6).alias("diversity")))

        return tx.let(F.sort_array(F.transform(p, lambda x, i: F.struct(x["same"].alias("same"), i.alias("i")))), split)

    return texts.select("doc_id", F.explode_outer(tx.let(F.transform("p", shaped), judge)).alias("x")).select("doc_id", "x.pos", "x.diversity")


def packed(lengths: Column, limit: Column) -> Column:
    """Greedy packing in order: a sentence joins its group while the group stays within the limit."""
    step = lambda a, n: F.when((F.size(a["out"]) > 0) & (a["last"] + n <= limit), F.struct(F.concat(F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1), F.array(a["last"] + n)).alias("out"), (a["last"] + n).alias("last"))).otherwise(F.struct(F.concat(a["out"], F.array(n)).alias("out"), n.alias("last")))
    return F.aggregate(lengths, F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("last")), step, lambda a: a["out"])


def transitions(rows: DataFrame, by: list[str], order: list[str], state: str, per: str) -> DataFrame:
    """Row-normalised counts of consecutive states within each sequence `by`, per `per`."""
    after = F.lead(state).over(Window.partitionBy(*by).orderBy(*order))
    counts = rows.select(per, F.col(state).alias("src"), after.alias("tgt")).where(F.col("tgt").isNotNull()).groupBy(per, "src", "tgt").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(per, "src"))
    return counts.withColumn("p", F.round(F.col("n") / total, 8))
