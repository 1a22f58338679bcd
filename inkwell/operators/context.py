"""Contexts of sentences, an index of them by cell, and templates from the nearest ones.

A context has five discrete fields, so all contexts of a corpus fall into a few
hundred cells whatever its size. Two contexts are as far apart as the number of
fields in which they differ. Each cell stands under all 32 masks of its fields,
a masked field being any value; what stands under the same mask with the same
values is near by so much at least. Of each mask only the first contexts are
kept, which is enough for an exact search: whatever is left out has as many
before it that are no farther. So no context is compared with every other.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import annotate as an
from ..functions import classify as cl
from ..functions import text as tx

FIELDS = ("para_pos", "sent_pos", "previous_type", "sentiment", "length")
ID = ("doc_id", "para_idx", "sent_idx")
#: Contexts that make a template.
NEAREST = 5
#: How far target and mean length may lie apart, tags of places that no context has, tags that fill a template up.
CLOSE = 5
OPENING, FILL = ["DET", "ADJ", "NOUN"], ["DET", "ADJ", "NOUN", "VERB", "ADP"]


def place(idx: Column, n: Column) -> Column:
    return F.when(idx == 0, "first").when(idx == n - 1, "last").otherwise("middle")


def contexts(docs: DataFrame) -> DataFrame:
    """A row for every sentence: its id (doc_id, para_idx, sent_idx), the fields of its context, the sentence. The type before a paragraph's first sentence is Simple."""
    paras = docs.select("doc_id", tx.paragraphs(F.col("text")).alias("_p")).select("doc_id", F.size("_p").alias("_n"), F.posexplode_outer("_p").alias("para_idx", "_q")).where("para_idx IS NOT NULL")
    own = paras.select("doc_id", "para_idx", place(F.col("para_idx"), F.col("_n")).alias("para_pos"), F.transform(tx.sentences(F.col("_q")), lambda s: tx.let(tx.tokens(s), lambda t: F.struct(s.alias("s"), cl.syntax_of(t).alias("type"), cl.sentiment_of(t).alias("mood")))).alias("_s"))
    each = own.select("doc_id", "para_idx", "para_pos", "_s", F.posexplode_outer("_s").alias("sent_idx", "_x")).where("sent_idx IS NOT NULL")
    before = F.coalesce(F.get("_s", F.col("sent_idx") - 1)["type"], F.lit("Simple"))
    s = F.col("_x.s")
    return each.select(*ID, "para_pos", place(F.col("sent_idx"), F.size("_s")).alias("sent_pos"), before.alias("previous_type"), F.col("_x.mood").alias("sentiment"), cl.length_category(F.size(tx.words(s))).alias("length"), s.alias("sentence"))


def first_of(rows: DataFrame, group: list[str], k: int) -> DataFrame:
    """The k rows of each group with the smallest ids; Spark limits the groups in each task before it shuffles them."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*ID))).where(F.col("_r") <= k).drop("_r")


def masked(rows: DataFrame) -> DataFrame:
    """Each row once under every mask, as (mask, key): the fields that count, and their values."""
    masks = [m for n in range(len(FIELDS) + 1) for m in combinations(range(len(FIELDS)), n)]
    keys = F.array(*(F.struct(F.lit(sum(1 << i for i in m)).alias("mask"), F.concat_ws("|", *(F.col(FIELDS[i]) for i in m)).alias("key")) for m in masks))
    return rows.withColumn("_m", F.explode(keys)).withColumns({"mask": F.col("_m.mask"), "key": F.col("_m.key")}).drop("_m")


def cell_index(corpus: DataFrame, k: int = NEAREST) -> DataFrame:
    """mask, key and the k + 1 first contexts under them, with the tags of their sentences; of a size that the fields bound, not the corpus."""
    cells = first_of(corpus, list(FIELDS), k + 1)
    tagged = cells.select(*ID, *FIELDS, an.tags(F.col("sentence")).alias("tags"))
    return first_of(masked(tagged), ["mask", "key"], k + 1)


def nearest(cells: DataFrame, index: DataFrame, k: int = NEAREST) -> DataFrame:
    """For each cell (a row of FIELDS, and what else it has) the array `near` of its k + 1 nearest contexts (distance, id, tags), nearest first, ties by id."""
    theirs = index.select("mask", "key", *ID, *(F.col(f).alias(f"_{f}") for f in FIELDS), "tags")
    met = masked(cells).join(theirs, ["mask", "key"])
    apart = sum((F.when(F.col(f) != F.col(f"_{f}"), 1).otherwise(0) for f in FIELDS), F.lit(0))
    one = met.select(*cells.columns, F.struct(apart.alias("distance"), F.struct(*ID).alias("id"), "tags").alias("_c"))
    return one.groupBy(*cells.columns).agg(F.slice(F.array_sort(F.array_distinct(F.collect_list("_c"))), 1, k + 1).alias("near"))  # 32 masks of k + 1 each


def built(templates: Column, target: Column) -> Column:
    """The template of these tags for a sentence of so many words; see `merged` and `fitted`."""
    return tx.let(merged(templates), lambda m: fitted(m, target))


def merged(templates: Column, most: Column | None = None) -> Column:
    """(mean, tags): the mean length of the templates that have tags (null without any), and at each place (of the first `most`, if told) their most frequent tag, of equals the one of the nearer context."""

    def best(here: Column) -> Column:
        return F.array_max(F.transform(here, lambda t, j: F.struct(F.size(F.filter(here, lambda u: u == t)).alias("n"), (-j).alias("j"), t.alias("tag"))))["tag"]

    def at(xs: Column, i: Column) -> Column:
        return tx.let(F.filter(F.transform(xs, lambda t: F.get(t, i)), lambda t: t.isNotNull()), best)

    def whole(xs: Column) -> Column:
        mean = F.floor(F.aggregate(xs, F.lit(0), lambda a, t: a + F.size(t)) / F.nullif(F.size(xs), F.lit(0))).cast("int")
        longest = F.coalesce(F.array_max(F.transform(xs, F.size)), F.lit(0))
        n = longest if most is None else F.least(longest, most)
        return F.struct(mean.alias("mean"), F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: at(xs, i))).otherwise(F.array().cast("array<string>")).alias("tags"))

    return tx.let(F.filter(templates, lambda t: F.size(t) > 0), whole)


def fitted(m: Column, target: Column) -> Column:
    """A merged template as long as the target if that is close to the mean, filled up or cut to it then; without tags it is all filling."""
    filled = lambda n: F.slice(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.element_at(F.array(*map(F.lit, FILL)), i % len(FILL) + 1)), F.lit(1), F.greatest(n, F.lit(0)))
    opening = lambda i: F.get(F.array(*map(F.lit, OPENING)), F.least(i, F.lit(len(OPENING) - 1)))

    def cut(n: Column) -> Column:
        own = F.least(n, target)
        tags = F.transform(F.sequence(F.lit(0), F.greatest(own - 1, F.lit(0))), lambda i: F.coalesce(F.get(m["tags"], i), opening(i)))
        return F.concat(F.slice(tags, F.lit(1), own), filled(target - n))

    n = F.when(F.abs(target - m["mean"]) <= CLOSE, target).otherwise(m["mean"])
    return F.when(m["mean"].isNull(), filled(target)).otherwise(tx.let(n, cut))


def statistical_templates(targets: DataFrame, corpus: DataFrame, k: int = NEAREST) -> DataFrame:
    """For every target sentence the ids of its k nearest contexts in the corpus, itself left out, and the template of tags they make.

    Both are rows of `contexts`. Cells, not sentences, are searched: the join
    with the sentences is by cell, with a table of at most 324 rows that goes to
    every task. A cell has k + 2 templates at most, one without each of its
    k + 1 nearest contexts and one of the first k, so they are merged by cell too.
    """
    words = F.size(tx.words(F.col("sentence")))
    cells = targets.groupBy(*FIELDS).agg(F.max(words).alias("_most"))
    near = nearest(cells, cell_index(corpus, k), k)

    def without(j: Column) -> Column:
        left = F.slice(F.filter(F.col("near"), lambda c, i: i != j), 1, k)
        return tx.let(left, lambda n: F.struct(F.transform(n, lambda c: c["id"]).alias("nearest"), F.transform(n, lambda c: c["distance"]).alias("distances"), merged(F.transform(n, lambda c: c["tags"]), F.col("_most")).alias("m")))

    made = near.select(*FIELDS, F.transform("near", lambda c: c["id"]).alias("_ids"), F.transform(F.sequence(F.lit(-1), F.size("near") - 1), without).alias("_made"))
    rows = targets.join(F.broadcast(made), list(FIELDS), "left")
    own = F.get("_made", F.coalesce(F.array_position("_ids", F.struct(*ID)), F.lit(0)).cast("int"))
    none = F.array().cast("array<array<string>>")
    return rows.withColumn("_t", own).select(*ID, *FIELDS, F.coalesce("_t.nearest", F.array()).alias("nearest"), F.coalesce("_t.distances", F.array()).alias("distances"), fitted(F.coalesce("_t.m", merged(none)), words).alias("template"))
