"""Likeness by meaning: word vectors of the corpus, coverage, recall and replacement by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import annotate as an
from ..functions import compare as cp
from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import metric as me
from ..operators import wordspace as ws
from ..sources.shared import kept
from .made import MET, SENTS_OF, met
from .pairs import content_sql
from .registry import query, table, tokens_sql

#: How like a word, and a sentence, must be to count as kept; what stands for a word that the palette has nothing like.
WORD_LIKE, SENTENCE_LIKE, REPLACED_LIKE = 0.6, 0.7, 0.3
PALETTE = 200

SIGNS = "[" + ", ".join(f"CAST(sum(CASE WHEN md5(near)[{j + 1}] < '8' THEN w ELSE -w END) AS BIGINT)" for j in range(ws.WIDTH)) + "]"
SPACE = f"""tok AS (SELECT row, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT row_number() OVER () AS row, {tokens_sql("text")} AS t FROM documents)),
cooc AS (SELECT word, near, CAST(count(*) AS BIGINT) AS n FROM (SELECT a.w AS word, b.w AS near FROM tok a JOIN (SELECT *, unnest(range(1, {ws.WINDOW + 1})) AS o FROM tok) b ON a.row = b.row AND a.i = b.i - b.o UNION ALL SELECT b.w, a.w FROM tok a JOIN (SELECT *, unnest(range(1, {ws.WINDOW + 1})) AS o FROM tok) b ON a.row = b.row AND a.i = b.i - b.o) GROUP BY ALL),
totals AS (SELECT word, CAST(sum(n) AS BIGINT) AS total FROM cooc GROUP BY word), whole AS (SELECT CAST(sum(total) AS DOUBLE) AS whole FROM totals),
weighed AS (SELECT c.word, c.near, CAST(floor(greatest(ln((CAST(c.n AS DOUBLE) * whole) / (CAST(a.total AS DOUBLE) * CAST(b.total AS DOUBLE))), 0.0) * {ws.MICRO} + 0.5) AS BIGINT) AS w FROM cooc c JOIN totals a ON a.word = c.word JOIN totals b ON b.word = c.near, whole),
made AS (SELECT word, {SIGNS} AS vector FROM weighed WHERE w > 0 GROUP BY word),
space AS (SELECT t.word, t.total, coalesce(m.vector, list_transform(range({ws.WIDTH}), lambda i: CAST(0 AS BIGINT))) AS vector FROM totals t LEFT JOIN made m ON m.word = t.word)"""
UNIT = "CASE WHEN len(list_filter({v}, lambda x: x <> 0)) > 0 THEN list_transform({v}, lambda x: CAST(x AS DOUBLE)) END"


def space(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """The word vectors of all documents; of the words in `only`, if it is given."""
    return ws.vectors(table(spark, sf_dir, "documents").select(tx.tokens(F.col("text")).alias("tokens")), only=only)


@query(f"WITH {SPACE} SELECT word, total, array_to_string(vector, ' ') AS vector FROM space")
def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its vector."""
    return space(spark, sf_dir).select("word", "total", F.array_join(F.transform("vector", lambda x: x.cast("string")), " ").alias("vector"))


@query(
    f"""WITH {SPACE}, {MET}, w AS (SELECT id, unnest({content_sql("prev")}) AS w FROM met), g AS (SELECT id, unnest({content_sql("text")}) AS g FROM met),
va AS (SELECT w.id, w.w, {UNIT.format(v="s.vector")} AS v FROM w LEFT JOIN space s ON s.word = w.w), vb AS (SELECT g.id, g.g, {UNIT.format(v="s.vector")} AS v FROM g LEFT JOIN space s ON s.word = g.g),
k AS (SELECT va.id, va.w, coalesce(max(CASE WHEN va.w = vb.g OR coalesce(round(list_cosine_similarity(va.v, vb.v), 6), 0) >= {WORD_LIKE} THEN 1 ELSE 0 END), 0) AS kept FROM va LEFT JOIN vb USING (id) GROUP BY va.id, va.w)
SELECT id, round(CAST(sum(kept) AS DOUBLE) / count(*), 6) AS coverage, coalesce(list(w ORDER BY w) FILTER (kept = 0), []) AS missing FROM k GROUP BY id"""
)
def meaning_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each turn's content the next one keeps, words of like use included."""
    rows = met(spark, sf_dir).select("id", cp.content(F.col("prev")).alias("a"), cp.content(F.col("text")).alias("b")).where(F.size("a") > 0)
    words = rows.select(F.explode(F.concat("a", "b")).alias("word"))
    found = ws.coverage(rows, "id", F.col("a"), F.col("b"), space(spark, sf_dir, words), WORD_LIKE)
    return found.select("id", F.round((F.col("n") - F.size("missing")) / F.col("n"), 6).alias("coverage"), "missing")


CONTENT = content_sql("p")
SUMS = "[" + ", ".join(f"CAST(sum(vector[{j + 1}]) AS BIGINT)" for j in range(ws.WIDTH)) + "]"


@query(
    f"""WITH {SPACE}, {MET}, parts AS (SELECT id, side, i, list_extract(l, i) AS p FROM (SELECT id, side, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT id, 'a' AS side, {SENTS_OF.format(x="prev")} AS l FROM met UNION ALL SELECT id, 'b', {SENTS_OF.format(x="text")} FROM met))),
words AS (SELECT id, side, i, p, unnest({CONTENT}) AS w FROM parts), sums AS (SELECT id, side, i, {SUMS} AS vector FROM words JOIN space ON space.word = words.w GROUP BY id, side, i),
v AS (SELECT id, side, i, {UNIT.format(v="vector")} AS v FROM sums),
k AS (SELECT q.id, q.i, coalesce(max(coalesce(round(list_cosine_similarity(x.v, y.v), 6), 0)), 0) AS best FROM parts q LEFT JOIN v x ON x.id = q.id AND x.side = 'a' AND x.i = q.i LEFT JOIN v y ON y.id = q.id AND y.side = 'b' WHERE q.side = 'a' GROUP BY q.id, q.i)
SELECT id, round(CAST(count(*) FILTER (best >= {SENTENCE_LIKE}) AS DOUBLE) / count(*), 6) AS recall, CAST(count(*) AS INTEGER) AS propositions FROM k GROUP BY id"""
)
def meaning_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a turn's sentences the next one has a sentence of like meaning for: sums of word vectors against each other."""
    sides = F.array(F.struct(F.lit("a").alias("side"), tx.sentences(F.col("prev")).alias("l")), F.struct(F.lit("b").alias("side"), tx.sentences(F.col("text")).alias("l")))
    parts = met(spark, sf_dir).select("id", F.explode(sides).alias("s")).select("id", "s.side", F.posexplode("s.l").alias("i", "p"))
    rows = parts.select("id", "side", "i", cp.content(F.col("p")).alias("words"))
    sums = ws.means(rows, ["id", "side", "i"], F.col("words"), space(spark, sf_dir, rows.select(F.explode("words").alias("word"))))
    placed = parts.select("id", "side", "i").join(sums, ["id", "side", "i"], "left").withColumn("v", ws.unit(F.col("vector")))
    lists = [F.collect_list(F.when(F.col("side") == s, F.struct("v"))).alias(s) for s in "ab"]
    kept = F.size(F.filter("a", lambda x: F.exists("b", lambda y: ws.like(x["v"], y["v"]) >= SENTENCE_LIKE)))
    rows = placed.groupBy("id").agg(*lists).where(F.size("a") > 0)
    return rows.select("id", F.round(kept / F.size("a"), 6).alias("recall"), F.size("a").alias("propositions"))


@query()
def meaning_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each content word of the benchmark the palette word of its kind that is used most alike; a general word of the kind where none is.

    The palette: of each kind the most frequent words of all documents. Words
    are numbered by their place in the list of both, which is of bounded size.
    """
    known = space(spark, sf_dir).withColumn("kind", an.tag(F.col("word")))
    fit = known.where(F.col("kind").isin("NOUN", "VERB", "ADJ", "ADV") & ~F.col("word").isin(lx.STOPS) & (F.length("word") > 2))
    palette = fit.withColumn("_r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("total"), "word"))).where(F.col("_r") <= PALETTE).drop("_r")
    asked = table(spark, sf_dir, "benchmark").select(F.explode(cp.content(F.col("text"))).alias("word")).distinct()
    number = lambda df: df.withColumn("id", F.xxhash64("word"))
    queries = kept(number(asked.join(fit, "word")), "asked", lean=True)
    shelf = kept(number(palette), "shelf", lean=True)
    near = me.nearest(me.unit(queries, "id", "vector", by="kind"), me.unit(shelf, "id", "vector", by="kind"), 1, least=REPLACED_LIKE)
    named = near.join(shelf.select("id", F.col("word").alias("replacement")), "id").select(F.col("query").alias("id"), "replacement", "likeness")
    general = F.create_map(*(F.lit(x) for p in (("NOUN", "structure"), ("VERB", "form"), ("ADJ", "clear"), ("ADV", "thus")) for x in p))
    out = queries.select("id", "word", "kind").join(named, "id", "left")
    return out.select("word", "kind", F.coalesce("replacement", general[F.col("kind")]).alias("replacement"), "likeness")
