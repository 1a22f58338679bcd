"""Inputs made from the supplied tables for operators that take answers, verdicts, drafts, templates and the like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import annotate as an
from ..functions import classify as cl
from ..functions import text as tx
from ..functions.fixture import Made
from .registry import PARAS, SENTS, list_sql, table, tokens_sql, words_sql

TURNS = "turns AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)"
#: Turns with the one before, and an id of their own.
MET = f"{TURNS}, met AS (SELECT conv_id * 1048576 + turn AS id, conv_id, turn, text, prev FROM turns WHERE prev IS NOT NULL AND text IS NOT NULL)"


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the one before it."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", "text", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("prev")).where(F.col("prev").isNotNull())


def met(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).where(F.col("text").isNotNull()).withColumn("id", F.col("conv_id") * 1048576 + F.col("turn"))


def sent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.sentence_rows(table(spark, sf_dir, "documents"))


def para_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.paragraph_rows(table(spark, sf_dir, "documents"))


PARA_ID = "CAST(doc_id AS STRING) || '-' || CAST(para_idx AS STRING)"
SENT_ID = PARA_ID + " || '-' || CAST(sent_idx AS STRING)"


def first(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def letters(c: Column, i: int) -> Column:
    """The letters of a text's i-th word (from 0)."""
    return F.regexp_replace(F.coalesce(F.get(tx.words(c), F.lit(i)), F.lit("")), r"[^\p{L}]", "")


def letters_sql(x: str, i: int) -> str:
    return rf"regexp_replace(coalesce({words_sql(x)}[{i + 1}], ''), '[^\p{{L}}]', '', 'g')"


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    quote = F.concat(F.lit(' "'), first(F.col("prev"), 12), F.lit('"'))
    ref = lambda c: F.concat(F.lit(" [^"), c.cast("string"), F.lit("]"))
    return met(spark, sf_dir).select(
        "id",
        F.concat("prev", quote, ref(F.col("turn")), ref(F.col("conv_id") % 3)).alias("original"),
        F.concat("text", F.when(F.col("conv_id") % 2 == 0, quote).otherwise(""), ref(F.col("conv_id") % 3), ref(F.col("turn") + F.col("conv_id") % 2), F.lit(" (Smith, 2001) and Delft.")).alias("generated"),
    )


#: A turn as the output made from the one before, with citations and a quote some of which stay.
CITED_TURNS = Made(
    "cited",
    f"""{MET}, cited AS (SELECT id, prev || ' "' || prev[1:12] || '" [^' || turn || '] [^' || conv_id % 3 || ']' AS original,
 text || CASE WHEN conv_id % 2 = 0 THEN ' "' || prev[1:12] || '"' ELSE '' END || ' [^' || conv_id % 3 || '] [^' || (turn + conv_id % 2) || '] (Smith, 2001) and Delft.' AS generated FROM met)""",
    _cited,
)

#: All sentences, some begun with a connector.
STARTS = ["However, ", "It is ", "Unless "]
SENT_CASES = Made(
    "cases",
    f"{SENTS}, cases AS (SELECT {SENT_ID} AS id, CASE sent_idx % 5 WHEN 1 THEN 'However, ' WHEN 2 THEN 'It is ' WHEN 3 THEN 'Unless ' ELSE '' END || sentence AS text FROM sents)",
    lambda spark, sf_dir: sent_rows(spark, sf_dir).select(F.expr(SENT_ID).alias("id"), F.concat(F.expr("CASE sent_idx % 5 WHEN 1 THEN 'However, ' WHEN 2 THEN 'It is ' WHEN 3 THEN 'Unless ' ELSE '' END"), "sentence").alias("text")),
)
VOICED_SENTS = Made(
    "voiced",
    f"{SENTS}, voiced AS (SELECT {SENT_ID} AS id, CASE sent_idx % 4 WHEN 1 THEN 'It was painted and ' WHEN 2 THEN 'John: [12] ' WHEN 3 THEN 'It is good the day is ' ELSE '' END || sentence AS text FROM sents)",
    lambda spark, sf_dir: sent_rows(spark, sf_dir).select(F.expr(SENT_ID).alias("id"), F.concat(F.expr("CASE sent_idx % 4 WHEN 1 THEN 'It was painted and ' WHEN 2 THEN 'John: [12] ' WHEN 3 THEN 'It is good the day is ' ELSE '' END"), "sentence").alias("text")),
)
SCALPEL_SENTS = Made(
    "scalpel",
    f"{SENTS}, scalpel AS (SELECT {SENT_ID} AS id, 'Vast, ' || replace(replace(sentence, ' the ', ' profound '), ' of ', ' staggering, ') AS text FROM sents)",
    lambda spark, sf_dir: sent_rows(spark, sf_dir).select(F.expr(SENT_ID).alias("id"), F.concat(F.lit("Vast, "), F.expr("replace(replace(sentence, ' the ', ' profound '), ' of ', ' staggering, ')")).alias("text")),
)
ENDING_PARAS = Made(
    "endings",
    f"{PARAS}, endings AS (SELECT {PARA_ID} AS id, paragraph || CASE para_idx % 3 WHEN 1 THEN ' Ultimately, this is its lesson.' WHEN 2 THEN ' In truth Anna met Bert and Carla in Delft.' ELSE '' END AS paragraph FROM paras)",
    lambda spark, sf_dir: para_rows(spark, sf_dir).select(F.expr(PARA_ID).alias("id"), F.concat("paragraph", F.expr("CASE para_idx % 3 WHEN 1 THEN ' Ultimately, this is its lesson.' WHEN 2 THEN ' In truth Anna met Bert and Carla in Delft.' ELSE '' END")).alias("paragraph")),
)


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = (letters(F.col("prev"), i) for i in range(3))
    kind = F.col("id") % 4
    verdict = (
        F.when(kind == 0, F.concat(F.lit("1. Remove '"), a, F.lit("'.\n2) Fix the end.")))
        .when(kind == 1, F.concat(F.lit("Missing '"), a, F.lit(" "), b, F.lit(" "), c, F.lit("'. Rewrite the entire text.")))
        .when(kind == 2, F.concat(F.lit("The word '"), F.lower(a), F.lit("' is missing.")))
        .otherwise(F.concat(F.lit("Swap '"), b, F.lit("' now. Fine.")))
    )
    return met(spark, sf_dir).select("id", verdict.alias("verdict"), F.col("text").alias("generated"))


A, B, C = (letters_sql("prev", i) for i in range(3))
VERDICT_TURNS = Made(
    "verdicts",
    f"""{MET}, verdicts AS (SELECT id, CASE id % 4 WHEN 0 THEN '1. Remove ''' || {A} || '''.' || chr(10) || '2) Fix the end.' WHEN 1 THEN 'Missing ''' || {A} || ' ' || {B} || ' ' || {C} || '''. Rewrite the entire text.'
 WHEN 2 THEN 'The word ''' || lower({A}) || ''' is missing.' ELSE 'Swap ''' || {B} || ''' now. Fine.' END AS verdict, text AS generated FROM met)""",
    _verdicts,
)
DRAFT_SQL = "id, CAST(conv_id % 11 AS DOUBLE) / 10 AS recall, CAST(turn % 6 AS DOUBLE) / 5 AS prec, CASE WHEN conv_id % 7 = 0 THEN NULL ELSE CAST(id % 10 AS DOUBLE) / 9 END AS fluency, CAST(id % 13 AS DOUBLE) / 12 AS overall"
DRAFT_TURNS = Made(
    "drafts",
    f"{MET}, drafts AS (SELECT {DRAFT_SQL}, len({words_sql('prev')}) AS source_words, len({words_sql('text')}) AS words FROM met)",
    lambda spark, sf_dir: met(spark, sf_dir).selectExpr("*", *_named(DRAFT_SQL)).select("id", "recall", "prec", "fluency", "overall", F.size(tx.words(F.col("prev"))).alias("source_words"), F.size(tx.words(F.col("text"))).alias("words")),
)


def _named(sql: str) -> list[str]:
    """The parts of a select list but the first, which is a plain column."""
    return sql.split(", ")[1:]


FIT_TURNS = Made(
    "fits",
    f"{MET}, fits AS (SELECT id, len({words_sql('text')}) AS words, len({words_sql('prev')}) % 30 AS target, nullif(turn * 5 % 25, 0) AS raw FROM met)",
    lambda spark, sf_dir: met(spark, sf_dir).select("id", F.size(tx.words(F.col("text"))).alias("words"), (F.size(tx.words(F.col("prev"))) % 30).alias("target"), F.expr("nullif(turn * 5 % 25, 0)").alias("raw")),
)
RAW_SQL = """CASE id % 4 WHEN 0 THEN 'Sure.' || chr(10) || 'REWRITE: ' || text || ' , and fell.... then rose "as said , here .." [^4] .' WHEN 1 THEN 'CRITICAL: keep it' || chr(10) || text || ' (Smith, 2001) over Chapter 4 stones .'
 WHEN 2 THEN 'Output: ' || text ELSE '---' || chr(10) || '===' || chr(10) || text || chr(10) || chr(10) || 'other (Jones 12) line ! it ended.' END"""
RAW_TURNS = Made("raw", f"{MET}, raw AS (SELECT id, {RAW_SQL} AS text FROM met)", lambda spark, sf_dir: met(spark, sf_dir).select("id", F.expr(RAW_SQL).alias("text")))
VARIANT_SQL = "CASE id % 3 WHEN 0 THEN 'Here are some:' || chr(10) || 'VAR: ' || text || chr(10) || 'VAR: ' || prev WHEN 1 THEN '1. ' || text || chr(10) || '2) ' || prev || chr(10) || '- Third one.' ELSE text END"
VARIANT_TURNS = Made("variants_raw", f"{MET}, variants_raw AS (SELECT id, {VARIANT_SQL} AS response FROM met)", lambda spark, sf_dir: met(spark, sf_dir).select("id", F.expr(VARIANT_SQL).alias("response")))
ANSWER_SQL = """CASE doc_id % 5 WHEN 0 THEN 'Sure! ```json' || chr(10) || '{"a": ' || doc_id || '}' || chr(10) || '``` done' WHEN 1 THEN concat('plan: {', chr(39), 'a', chr(39), ': True, ', chr(39), 'b', chr(39), ': None, ', chr(39), 'n', chr(39), ': ', doc_id, ',}') WHEN 2 THEN 'no object ' || doc_id
 WHEN 3 THEN 'list ["x' || doc_id || '", "", "y z"] end' ELSE '{broken ' || doc_id || ': [}' END"""
ANSWER_DOCS = Made("answers", f"answers AS (SELECT doc_id AS id, {ANSWER_SQL} AS text FROM documents)", lambda spark, sf_dir: table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(ANSWER_SQL).alias("text")))
SLOT_SENTS = Made(
    "slots",
    f"""{SENTS}, slots AS (SELECT {PARA_ID} AS para_id, sent_idx + 1 AS pos, len({words_sql("sentence")}) AS target_len, CASE WHEN len({words_sql("sentence")}) < 15 THEN 'simple' WHEN len({words_sql("sentence")}) < 25 THEN 'moderate' ELSE 'complex' END AS type, CAST((sent_idx * 7 + doc_id) % 10 AS DOUBLE) / 10 AS similarity FROM sents)""",
    lambda spark, sf_dir: sent_rows(spark, sf_dir).select(F.expr(PARA_ID).alias("para_id"), (F.col("sent_idx") + 1).alias("pos"), F.size(tx.words(F.col("sentence"))).alias("target_len"), cl.slot_type(F.size(tx.words(F.col("sentence")))).alias("type"), F.expr("CAST((sent_idx * 7 + doc_id) % 10 AS DOUBLE) / 10").alias("similarity")),
)
PACK_SENTS = Made(
    "packs",
    f"{SENTS}, packs AS (SELECT {PARA_ID} AS para_id, sent_idx AS pos, CAST(len({words_sql('sentence')}) AS INTEGER) AS words FROM sents)",
    lambda spark, sf_dir: sent_rows(spark, sf_dir).select(F.expr(PARA_ID).alias("para_id"), F.col("sent_idx").alias("pos"), F.size(tx.words(F.col("sentence"))).alias("words")),
)
FOLD_SENTS = Made(
    "skeletons",
    f"{SENTS}, skeletons AS (SELECT {PARA_ID} AS id, sent_idx AS pos, CASE sent_idx % 3 WHEN 1 THEN 'The of and' WHEN 2 THEN 'and of The' ELSE array_to_string({words_sql('sentence')}[1:3], ' ') END AS skeleton FROM sents)",
    lambda spark, sf_dir: sent_rows(spark, sf_dir).select(F.expr(PARA_ID).alias("id"), F.col("sent_idx").alias("pos"), F.when(F.col("sent_idx") % 3 == 1, "The of and").when(F.col("sent_idx") % 3 == 2, "and of The").otherwise(F.array_join(F.slice(tx.words(F.col("sentence")), 1, 3), " ")).alias("skeleton")),
)
SENTS_OF = r"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
CANDIDATE_PARAS = Made(
    "candidates",
    f"{PARAS}, candidates AS (SELECT {PARA_ID} AS id, len({SENTS_OF.format(x='paragraph')}) AS n_sents, CAST(doc_id % 5 + 1 AS INTEGER) AS style, len(regexp_extract_all(paragraph, ',')) AS capacity, len({words_sql('paragraph')}) AS words, doc_id % 4 = 0 AS used FROM paras)",
    lambda spark, sf_dir: para_rows(spark, sf_dir).select(F.expr(PARA_ID).alias("id"), F.size(tx.sentences(F.col("paragraph"))).alias("n_sents"), F.expr("CAST(doc_id % 5 + 1 AS INT)").alias("style"), F.regexp_count("paragraph", F.lit(",")).alias("capacity"), F.size(tx.words(F.col("paragraph"))).alias("words"), (F.col("doc_id") % 4 == 0).alias("used")),
)
TEMPLATE_SENTS = Made(
    "templates",
    rf"{SENTS}, templates AS (SELECT {SENT_ID} AS id, regexp_replace(regexp_replace(sentence, '(^| )(the|of|and|in) [a-z]+', '\1[NP]', 'g'), ', [a-z]+', ' [VP]', 'g') AS template FROM sents)",
    lambda spark, sf_dir: sent_rows(spark, sf_dir).select(F.expr(SENT_ID).alias("id"), F.regexp_replace(F.regexp_replace("sentence", "(^| )(the|of|and|in) [a-z]+", "$1[NP]"), ", [a-z]+", " [VP]").alias("template")),
)
LINE_SQL = "CASE WHEN i % 7 = 0 THEN CAST(i AS VARCHAR) WHEN i % 11 = 0 THEN 'XIV' WHEN i % 5 = 0 THEN 'Introduction' WHEN i % 3 = 1 THEN replace(x, '|', ' ') || ' physi-' ELSE replace(x, '|', ' ') END"
LINE_DOCS = Made(
    "corpus_lines",
    f"corpus_lines AS (SELECT doc_id, i AS line_no, {LINE_SQL} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))",
    lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "x")).select("doc_id", (F.col("k") + 1).alias("line_no"), F.expr(LINE_SQL.replace("VARCHAR", "STRING").replace("i %", "(k + 1) %").replace("CAST(i", "CAST(k + 1")).alias("line")),
)
METRIC_SQL = "doc_id AS id, " + ", ".join(f"CASE WHEN doc_id % {m} = 0 THEN NULL ELSE CAST(doc_id % {d} AS DOUBLE) / {d} END AS {k}" for k, m, d in (("accuracy", 3, 10), ("fluency", 4, 9), ("style", 2, 8), ("thesis_alignment", 5, 7), ("intent_compliance", 6, 6), ("keyword_coverage", 7, 5)))
METRIC_DOCS = Made("metrics", f"metrics AS (SELECT {METRIC_SQL} FROM documents)", lambda spark, sf_dir: table(spark, sf_dir, "documents").selectExpr(*METRIC_SQL.split(", ")))
USE_DOCS = Made(
    "uses",
    f"uses AS (SELECT doc_id, unnest({tokens_sql('text')}) AS token, generate_subscripts({tokens_sql('text')}, 1) AS pos FROM documents)",
    lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.tokens(F.col("text"))).alias("p", "token")).select("doc_id", "token", (F.col("p") + 1).cast("long").alias("pos")),
)


def _rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    rows = para_rows(spark, sf_dir).select("doc_id", F.col("para_idx").alias("pos"), tx.sentences(F.col("paragraph")).alias("s"))
    return rows.select("doc_id", "pos", F.nullif(F.regexp_extract(F.lower(F.get(s, F.lit(0))), tx.WORD, 0), F.lit("")).alias("opener"), F.transform(s, lambda x: tx.let(F.size(F.split(x, r"\s+")), cl.length_category)).alias("lengths"), F.transform(s, cl.syntax_type).alias("types"))


def _rhythm_sql() -> str:
    from ..functions import lexicon as lx
    from .registry import among_sql

    t = tokens_sql("y")
    kind = f"CASE WHEN len({t}) < 4 THEN 'Fragment' WHEN {among_sql(t, lx.COORDINATORS)} > 0 THEN 'Compound' WHEN {among_sql(t, lx.SUBORDINATORS)} > 0 THEN 'Complex' ELSE 'Simple' END"
    size = f"CASE WHEN len({words_sql('y')}) < 10 THEN 'short' WHEN len({words_sql('y')}) < 20 THEN 'medium' ELSE 'long' END"
    return f"{PARAS}, rs AS (SELECT doc_id, para_idx AS pos, {SENTS_OF.format(x='paragraph')} AS s FROM paras), rhythm AS (SELECT doc_id, pos, {tokens_sql('s[1]')}[1] AS opener, list_transform(s, lambda y: {size}) AS lengths, list_transform(s, lambda y: {kind}) AS types FROM rs)"


RHYTHM_PARAS = Made("rhythm", _rhythm_sql(), _rhythm)
TURN_LISTS = Made(
    "turn_lists",
    f"{MET}, turn_lists AS (SELECT id, {SENTS_OF.format(x='prev')} AS before, {SENTS_OF.format(x='text')} AS after FROM met)",
    lambda spark, sf_dir: met(spark, sf_dir).select("id", tx.sentences(F.col("prev")).alias("before"), tx.sentences(F.col("text")).alias("after")),
)


def tag_sql(w: str) -> str:
    rules = " ".join(f"WHEN {f'regexp_matches({w}, {chr(39)}{r}{chr(39)})' if isinstance(r, str) else f'list_contains({list_sql(r)}, {w})'} THEN '{name}'" for name, r in an.RULES)
    return f"CASE {rules} ELSE 'NOUN' END"


TAG_SENTS = Made(
    "tags",
    f"{SENTS}, tagged AS (SELECT doc_id, para_idx, sent_idx, {SENT_ID} AS id, list_transform({tokens_sql('sentence')}, lambda w: {tag_sql('w')}) AS t FROM sents), tags AS (SELECT id, lag(t) OVER (PARTITION BY doc_id, para_idx ORDER BY sent_idx) AS target, t AS actual FROM tagged QUALIFY target IS NOT NULL)",
    lambda spark, sf_dir: para_rows(spark, sf_dir).select("doc_id", "para_idx", F.transform(tx.sentences(F.col("paragraph")), an.tags).alias("t")).select("doc_id", "para_idx", "t", F.posexplode_outer("t").alias("sent_idx", "actual")).where("sent_idx > 0").select(F.expr(SENT_ID).alias("id"), F.get("t", F.col("sent_idx") - 1).alias("target"), "actual"),
)
