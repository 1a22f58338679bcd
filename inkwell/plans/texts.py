"""Queries that split and measure documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import measure as ms
from .registry import PARAS, SENTS, among_sql, list_sql, query, table, tokens_sql, words_sql


def sents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.sentence_rows(table(spark, sf_dir, "documents"))


@query(f"WITH {PARAS} SELECT doc_id, para_idx, paragraph FROM paras")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.paragraph_rows(table(spark, sf_dir, "documents")).select("doc_id", "para_idx", "paragraph")


@query(f"WITH {SENTS} SELECT doc_id, para_idx, sent_idx, sentence FROM sents")
def sentences_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sents(spark, sf_dir).select("doc_id", "para_idx", "sent_idx", "sentence")


@query(f"SELECT doc_id, len({words_sql('text')}) AS ws_words, len({tokens_sql('text')}) AS tokens, len(list_distinct({tokens_sql('text')})) AS types FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", tx.count(tx.words(c)).alias("ws_words"), tx.count(tx.tokens(c)).alias("tokens"), tx.count(F.array_distinct(tx.tokens(c))).alias("types"))


@query(
    f"""WITH {SENTS}, lists AS (SELECT doc_id, para_idx, list(sentence ORDER BY sent_idx) AS s FROM sents GROUP BY doc_id, para_idx),
w AS (SELECT doc_id, para_idx, s, unnest(range(1, greatest(len(s) - 2, 1) + 1)) AS i FROM lists)
SELECT doc_id, para_idx, CAST(i - 1 AS INTEGER) AS window_idx, array_to_string(s[i:i + 2], ' ') AS window_text FROM w"""
)
def windows_s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three sentences, one apart."""
    rows = tx.paragraph_rows(table(spark, sf_dir, "documents"))
    found = F.posexplode(tx.windows(tx.sentences(F.col("paragraph")), 3, 1)).alias("window_idx", "w")
    return rows.select("doc_id", "para_idx", found).select("doc_id", "para_idx", "window_idx", F.array_join("w", " ").alias("window_text"))


@query(
    f"""WITH {SENTS}, lists AS (SELECT doc_id, para_idx, list(sentence ORDER BY sent_idx) AS s FROM sents GROUP BY doc_id, para_idx),
w AS (SELECT doc_id, para_idx, s, unnest(range(1, greatest(len(s) - 2, 1) + 1, 2)) AS i FROM lists)
SELECT doc_id, para_idx, CAST((i - 1) // 2 AS INTEGER) AS fragment_index, array_to_string(s[i:i + 2], ' ') AS fragment FROM w"""
)
def fragments_w3_o1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of three sentences that overlap by one; the last sentence of an even number is left out, as agreed."""
    rows = tx.paragraph_rows(table(spark, sf_dir, "documents"))
    found = F.posexplode(tx.windows(tx.sentences(F.col("paragraph")), 3, 2)).alias("fragment_index", "w")
    return rows.select("doc_id", "para_idx", found).select("doc_id", "para_idx", "fragment_index", F.array_join("w", " ").alias("fragment"))


BURST = """n AS (SELECT source, CAST(len({tok}) AS DOUBLE) AS n FROM sents),
burst AS (SELECT source, count(*) AS n_sentences, avg(n) AS a, stddev_pop(n) AS s FROM n GROUP BY source)""".format(tok=tokens_sql("sentence"))
RHYTHM = "CASE WHEN a > 0 THEN CASE WHEN s / a < 0.4 THEN 'Smooth/Monotonous' WHEN s / a < 0.6 THEN 'Moderate Variation' ELSE 'Jagged/Volatile' END ELSE 'Unknown' END"


@query(f"WITH {SENTS}, {BURST} SELECT source, n_sentences, round(a, 6) AS mean_words, round(CASE WHEN a > 0 THEN s / a ELSE 0.0 END, 6) AS burstiness, {RHYTHM} AS rhythm_desc FROM burst")
def burstiness_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.burstiness(sents(spark, sf_dir))


PUNCT = r"""p AS (SELECT source, count(*) AS n, sum(len(regexp_extract_all(sentence, ';'))) * 100.0::DOUBLE / count(*) AS s, sum(len(regexp_extract_all(sentence, '(?:^|\s)[\x{2014}\x{2013}-](?:\s|$)|[\x{2014}\x{2013}]'))) * 100.0::DOUBLE / count(*) AS d, sum(len(regexp_extract_all(sentence, '!'))) * 100.0::DOUBLE / count(*) AS e FROM sents GROUP BY source)"""
PREFERS = "CASE WHEN greatest(s, d, e) < 1.0 THEN 'Standard' WHEN s = greatest(s, d, e) THEN 'Semicolons' WHEN d = greatest(s, d, e) THEN 'Dashes' ELSE 'Exclamations' END"


@query(f"WITH {SENTS}, {PUNCT} SELECT source, round(s, 2) AS semicolons_per_100, round(d, 2) AS dashes_per_100, round(e, 2) AS exclamations_per_100, {PREFERS} AS punctuation_preference FROM p")
def punctuation_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.punctuation(sents(spark, sf_dir))


@query(
    f"""WITH {SENTS}, n AS (SELECT source, sentence, CAST(len({tokens_sql("sentence")}) AS DOUBLE) AS n FROM sents)
SELECT source, round(avg(n), 4) AS avg_words_per_sentence, round(avg(CASE WHEN regexp_matches(sentence, '[,;]') THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS complexity_ratio, round(stddev_pop(n), 4) AS sentence_length_std_dev FROM n GROUP BY source"""
)
def structure_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.structure(sents(spark, sf_dir))


TOP = """counts AS (SELECT source, {w}, count(*) AS n FROM each GROUP BY source, {w}), ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, {w}) AS rank, sum(n) OVER (PARTITION BY source) AS total FROM counts)"""
OPENERS = f"each AS (SELECT source, opener FROM (SELECT source, {tokens_sql('sentence')}[1] AS opener FROM sents) WHERE opener IS NOT NULL)"


@query(f"WITH {SENTS}, {OPENERS}, {TOP.format(w='opener')} SELECT source, opener, n, CAST(rank AS INTEGER) AS rank, round(CAST(n AS DOUBLE) / CAST(total AS DOUBLE), 8) AS share FROM ranked WHERE rank <= 10")
def opener_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.top_words(ms.openers(sents(spark, sf_dir)), "source", "opener", 10)


@query(
    f"""WITH {SENTS}, {OPENERS}, {TOP.format(w="opener")}, c AS (SELECT source, CAST(count(*) FILTER (list_contains({list_sql(lx.LOGICAL_OPENERS)}, opener)) AS BIGINT) AS logical, CAST(count(*) FILTER (list_contains({list_sql(lx.NARRATIVE_OPENERS)}, opener)) AS BIGINT) AS narrative FROM ranked WHERE rank <= 10 GROUP BY source)
SELECT *, CASE WHEN logical > narrative THEN 'Logical' WHEN narrative > logical THEN 'Narrative' ELSE 'Mixed' END AS opener_pattern FROM c"""
)
def opener_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.opener_pattern(sents(spark, sf_dir))


@query(
    f"""WITH each AS (SELECT source, word FROM (SELECT source, unnest({tokens_sql("text")}) AS word FROM documents) WHERE NOT list_contains({list_sql(lx.STOPS)}, word) AND length(word) > 2), {TOP.format(w="word")}
SELECT source, word, n, CAST(rank AS INTEGER) AS rank, round(CAST(n AS DOUBLE) / CAST(total AS DOUBLE), 8) AS share FROM ranked WHERE rank <= 30"""
)
def keyword_top30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.keywords(table(spark, sf_dir, "documents"))


@query(
    f"""WITH {SENTS}, n AS (SELECT source, len({words_sql("sentence")}) AS n FROM sents), c AS (SELECT source, CASE WHEN n < 10 THEN 'short' WHEN n < 20 THEN 'medium' ELSE 'long' END AS category FROM n)
SELECT source, category, count(*) AS n FROM c GROUP BY source, category"""
)
def length_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(tx.words(F.col("sentence")))
    return sents(spark, sf_dir).select("source", F.when(n < 10, "short").when(n < 20, "medium").otherwise("long").alias("category")).groupBy("source", "category").agg(F.count("*").alias("n"))


@query(
    f"""WITH {SENTS}, t AS (SELECT doc_id, para_idx, sent_idx, max(sent_idx) OVER (PARTITION BY doc_id, para_idx) AS last FROM sents)
SELECT doc_id, para_idx, sent_idx, CASE WHEN sent_idx = 0 THEN 'first' WHEN sent_idx = last THEN 'last' ELSE 'middle' END AS position FROM t"""
)
def position_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each sentence in its paragraph, from the paragraph's own array: no shuffle."""
    rows = tx.paragraph_rows(table(spark, sf_dir, "documents")).withColumn("s", tx.sentences(F.col("paragraph")))
    each = rows.select("doc_id", "para_idx", F.size("s").alias("n"), F.posexplode("s").alias("sent_idx", "sentence"))
    return each.select("doc_id", "para_idx", "sent_idx", F.when(F.col("sent_idx") == 0, "first").when(F.col("sent_idx") == F.col("n") - 1, "last").otherwise("middle").alias("position"))


POV = f"""pov AS (SELECT source, CAST(sum({among_sql(tokens_sql("text"), lx.FIRST_SINGULAR)}) AS BIGINT) AS first_singular, CAST(sum({among_sql(tokens_sql("text"), lx.FIRST_PLURAL)}) AS BIGINT) AS first_plural, CAST(sum({among_sql(tokens_sql("text"), lx.THIRD_PERSON)}) AS BIGINT) AS third_person FROM documents GROUP BY source)"""
PERSON = "CASE WHEN greatest(first_singular, first_plural, third_person) = 0 THEN 'Third Person' WHEN first_singular = greatest(first_singular, first_plural, third_person) THEN 'First Person Singular' WHEN first_plural = greatest(first_singular, first_plural, third_person) THEN 'First Person Plural' ELSE 'Third Person' END"


@query(f"WITH {POV} SELECT *, {PERSON} AS pov FROM pov")
def pov_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.point_of_view(table(spark, sf_dir, "documents"))


@query(
    f"""WITH {SENTS}, {BURST}, {PUNCT}, {POV} SELECT burst.source, n_sentences, round(a, 4) AS mean_words, round(CASE WHEN a > 0 THEN burst.s / a ELSE 0.0 END, 4) AS burstiness, {RHYTHM.replace("s / a", "burst.s / a")} AS rhythm_desc, punctuation_preference, {PERSON} AS pov
FROM burst JOIN (SELECT source, {PREFERS} AS punctuation_preference FROM p) q ON burst.source = q.source JOIN pov ON burst.source = pov.source"""
)
def style_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per author: rhythm, punctuation and person."""
    return ms.profile(sents(spark, sf_dir)).withColumn("mean_words", F.round("mean_words", 4)).withColumn("burstiness", F.round("burstiness", 4))


V = {k: among_sql("t", x) for k, x in (("a", lx.VOICE_FIRST), ("b", lx.VOICE_SECOND), ("c", lx.VOICE_THIRD))}


@query(
    f"""WITH t AS (SELECT conv_id, turn, {tokens_sql("text")} AS t FROM conversations), v AS (SELECT conv_id, turn, {V["a"]} AS a, {V["b"]} AS b, {V["c"]} AS c FROM t)
SELECT conv_id, turn, CASE WHEN greatest(a, b, c) = 0 THEN 'neutral' WHEN a = greatest(a, b, c) THEN '1st' WHEN b = greatest(a, b, c) THEN '2nd' ELSE '3rd' END AS voice FROM v"""
)
def voice_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ms.voice(F.col("text")).alias("voice"))


@query(f"SELECT doc_id, round(CAST({among_sql(tokens_sql('text'), lx.STOPS)} AS DOUBLE) / greatest(len({tokens_sql('text')}), 1), 8) AS stop_ratio FROM documents")
def stopword_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(tx.among(t, lx.STOPS).cast("double") / F.greatest(F.size(t), F.lit(1)), 8).alias("stop_ratio"))


STYLE = rf"""base AS (SELECT doc_id, source, text, {tokens_sql("text")} AS t, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents),
m AS (SELECT doc_id, source, CAST(greatest(len(t), 1) AS DOUBLE) AS n, CAST(greatest(len(s), 1) AS DOUBLE) AS m, CAST(len(regexp_extract_all(text, '[,;:]')) AS DOUBLE) AS marks, CAST({among_sql("t", lx.STOPS)} AS DOUBLE) AS stops,
  coalesce(list_max(list_transform(s, lambda y: {among_sql(tokens_sql("y"), lx.SUBORDINATORS)} + CAST(floor(0.5 * {among_sql(tokens_sql("y"), lx.COORDINATORS)}) AS BIGINT))), 0) AS clauses,
  CAST(len(list_filter(range(1, greatest(len(t), 1)), lambda i: regexp_matches(t[i] || ' ' || t[i + 1], '^(am|is|are|was|were|be|been|being) \S+(ed|en)$'))) AS DOUBLE) AS passive, CAST(greatest({among_sql("t", lx.BE_FORMS)}, 1) AS DOUBLE) AS be, CAST(coalesce(list_sum(list_transform(t, lambda w: length(w))), 0) AS DOUBLE) AS letters FROM base),
style AS (SELECT doc_id, source, greatest(0.0, least(1.0, (n / m - 5.0) / 45.0)) AS length, greatest(0.0, least(1.0, (100.0 * marks / n) / 20.0)) AS marks, stops / n AS stops, greatest(0.0, least(1.0, clauses / 10.0)) AS depth_lex, least(passive / be, 1.0) AS passive_lex, greatest(0.0, least(1.0, (letters / n - 3.0) / 5.0)) AS word_length FROM m)"""
DIMS = ms.DIMENSIONS


@query(f"WITH {STYLE} SELECT doc_id, {', '.join(f'CAST(round({d}, 6) AS DOUBLE) AS {d}' for d in DIMS)} FROM style")
def style_vector_lex(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ms.style_vectors(table(spark, sf_dir, "documents"), "doc_id")
    return rows.select("doc_id", *(F.round(d, 6).alias(d) for d in DIMS))


@query(f"WITH {STYLE} SELECT source, count(*) AS n, {', '.join(f'CAST(round(avg({d}), 6) AS DOUBLE) AS {d}' for d in DIMS)} FROM style GROUP BY source")
def author_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean style vector of each author, over all its documents."""
    return ms.style_vectors(table(spark, sf_dir, "documents"), "source").groupBy("source").agg(F.count("*").alias("n"), *(F.round(F.avg(d), 6).alias(d) for d in DIMS))


PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
QUOTED = PUNCTUATION.replace("'", "''")


@query(f"SELECT doc_id, lower(translate(text, '{QUOTED}', '')) AS normalized FROM documents")
def normalize_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text without ASCII punctuation, in lower case."""
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(F.translate("text", PUNCTUATION, "")).alias("normalized"))
