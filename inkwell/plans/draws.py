"""Queries that draw by weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import draw as dr
from .made import SENTS_OF
from .registry import PARAS, query, table, words_sql
from .stores import LABELS, label_transitions

SEED = "inkwell"


def uniform_sql(*ids: str) -> str:
    return f"((CAST('0x' || substr(md5(concat_ws('|', '{SEED}', {', '.join(f'CAST({i} AS VARCHAR)' for i in ids)})), 1, 13) AS BIGINT) + 0.5) / pow(2.0, 52))"


@query(f"WITH {LABELS}, o AS (SELECT author_id, src, tgt, -ln({uniform_sql('author_id', 'src', 'tgt')}) / p AS o FROM tr WHERE p > 0) SELECT author_id, src, tgt AS next_archetype FROM o QUALIFY row_number() OVER (PARTITION BY author_id, src ORDER BY o, tgt) = 1")
def next_archetype_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archetype drawn to follow each one, by the transition probabilities."""
    return dr.one(label_transitions(spark, sf_dir), ["author_id", "src"], "tgt", F.col("p"), SEED).withColumnRenamed("tgt", "next_archetype")


KEY = "doc_id * 1048576 + para_idx"
TEMPLATES = f"{PARAS}, templates AS (SELECT source, doc_id, para_idx, {KEY} AS key, len({words_sql('paragraph')}) AS words, len({SENTS_OF.format(x='paragraph')}) AS sents FROM paras)"
NEAR = dr.TOP + dr.HISTORY + 1


@query(f"WITH {TEMPLATES}, o AS (SELECT source, key, -ln({uniform_sql('source', 'key')}) / sents AS o FROM templates WHERE sents > 0) SELECT source, key, CAST(row_number() OVER (PARTITION BY source ORDER BY o, key) AS INTEGER) AS rank FROM o QUALIFY rank <= 10")
def template_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten paragraphs of each author, drawn by their number of sentences without replacement."""
    return dr.sample(templates(spark, sf_dir), ["source"], "key", F.col("sents"), 10, SEED).select("source", "key", "rank")


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph as a template: key, words, sentences."""
    rows = tx.paragraph_rows(table(spark, sf_dir, "documents"))
    return rows.select("source", "doc_id", "para_idx", F.expr(KEY).alias("key"), F.size(tx.words(F.col("paragraph"))).alias("words"), F.size(tx.sentences(F.col("paragraph"))).alias("sents"))


SCORE = "0.5 / (1 + abs(c.sents - t.sents)) + 0.5 / (1 + abs(c.words - t.words))"


@query(
    f"""WITH RECURSIVE {TEMPLATES}, w AS (SELECT DISTINCT source, words FROM templates), f AS (SELECT * FROM templates QUALIFY row_number() OVER (PARTITION BY source, words ORDER BY key) <= {NEAR}),
n AS (SELECT w.source, w.words, f.key, f.words AS size, f.sents FROM w JOIN f ON f.source IS NOT DISTINCT FROM w.source QUALIFY row_number() OVER (PARTITION BY w.source, w.words ORDER BY abs(f.words - w.words), f.key) <= {NEAR}),
s AS (SELECT t.doc_id, t.para_idx, c.key, 0.5::DOUBLE / (1 + abs(c.sents - t.sents)) + 0.5::DOUBLE / (1 + abs(c.size - t.words)) AS score, {uniform_sql('t.key', 'c.key')} AS u FROM templates t JOIN n c ON c.source IS NOT DISTINCT FROM t.source AND c.words = t.words WHERE c.key <> t.key),
l AS (SELECT t.doc_id, row_number() OVER (PARTITION BY t.doc_id ORDER BY t.para_idx) AS i, coalesce(x.c, []) AS c FROM templates t LEFT JOIN (SELECT doc_id, para_idx, list({{'key': key, 'score': score, 'u': u}} ORDER BY score DESC, key) AS c FROM s GROUP BY ALL) x ON x.doc_id = t.doc_id AND x.para_idx = t.para_idx),
r AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS late, CAST(NULL AS BIGINT) AS key FROM l
 UNION ALL SELECT doc_id, i, CASE WHEN key IS NULL THEN late ELSE list_append(CASE WHEN len(late) >= {dr.HISTORY} THEN late[2:] ELSE late END, key) END, key
 FROM (SELECT doc_id, i, late, list_sort(list_transform(list_filter(c, lambda x: NOT list_contains(late, x.key))[1:{dr.TOP}], lambda x: {{'o': -ln(x.u) / x.score, 'key': x.key}}))[1].key AS key
 FROM (SELECT l.doc_id, l.i, l.c, CASE WHEN len(list_filter(l.c, lambda x: NOT list_contains(r.late, x.key))) > 0 THEN r.late ELSE CAST([] AS BIGINT[]) END AS late FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1)))
SELECT doc_id, array_to_string(list(coalesce(CAST(key AS VARCHAR), '-') ORDER BY i), ' ') AS drawn FROM r WHERE i > 0 GROUP BY doc_id"""
)
def template_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template drawn for each paragraph of a document in turn, among its author's paragraphs nearest in length, those drawn of late left out."""
    rows = templates(spark, sf_dir)
    known = rows.select("source", "words", F.struct("key", "sents").alias("key"))
    near = dr.nearest_sizes(known, "source", "words", "key", NEAR)
    met = rows.join(near.withColumnsRenamed({"source": "_s", "words": "_w"}), F.col("source").eqNullSafe(F.col("_s")) & (F.col("words") == F.col("_w")))
    score = lambda c: F.lit(0.5) / (1 + F.abs(c["key"]["sents"] - F.col("sents"))) + F.lit(0.5) / (1 + c["distance"])
    others = F.filter("near", lambda c: c["key"]["key"] != F.col("key"))
    scored = F.array_sort(F.transform(others, lambda c: F.struct((-score(c)).alias("s"), c["key"]["key"].alias("key"))))
    listed = F.transform(scored, lambda c: F.struct(c["key"].alias("key"), (-c["s"]).alias("score"), dr.uniform(SEED, F.col("key"), c["key"]).alias("u")))
    drawn = dr.drawn_in_turn(met.select("doc_id", "para_idx", listed.alias("c")), "doc_id", "para_idx", "c")
    return drawn.select("doc_id", F.array_join(F.transform("drawn", lambda k: F.coalesce(k.cast("string"), F.lit("-"))), " ").alias("drawn"))
