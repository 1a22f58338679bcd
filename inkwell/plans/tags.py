"""Queries over the word-list tagger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import annotate as an
from ..functions import text as tx
from .made import SENT_CASES, tag_sql
from .registry import SENTS, among_sql, list_sql, over, query, table, tokens_sql, words_sql
from .rules import CASES
from .texts import sents


__all__ = ["tag_sql"]
T = tokens_sql("text")
EACH = f"e AS (SELECT source, doc_id, i, {tag_sql('w')} AS tag FROM (SELECT source, doc_id, unnest({T}) AS w, generate_subscripts({T}, 1) AS i FROM documents))"


@query(f"WITH {EACH}, c AS (SELECT source, tag, count(*) AS n FROM e GROUP BY source, tag) SELECT source, tag, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY source), 8) AS share FROM c")
def pos_distribution_lex(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", F.explode(an.tags(F.col("text"))).alias("tag")).groupBy("source", "tag").agg(F.count("*").alias("n"))
    return rows.join(rows.groupBy("source").agg(F.sum("n").alias("t")), "source").select("source", "tag", "n", F.round(F.col("n") / F.col("t"), 8).alias("share"))


@query(f"WITH {EACH}, n AS (SELECT source, tag AS src, lead(tag) OVER (PARTITION BY doc_id ORDER BY i) AS tgt FROM e), c AS (SELECT source, src, tgt, count(*) AS n FROM n WHERE tgt IS NOT NULL GROUP BY source, src, tgt) SELECT *, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY source, src), 8) AS p FROM c")
def pos_markov_lex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions between tags; pairs come from each text's own array, so only counts are shuffled."""
    from pyspark.sql.window import Window

    pairs = tx.let(an.tags(F.col("text")), lambda t: F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("src"), b.alias("tgt"))))
    counts = table(spark, sf_dir, "documents").select("source", F.explode(pairs).alias("p")).groupBy("source", "p.src", "p.tgt").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source", "src")), 8))


def distinct_sql(*names: str) -> str:
    return f"list_sort(list_distinct(list_filter({T}, lambda w: {tag_sql('w')} IN ({', '.join(repr(n) for n in names)}))))"


@over(
    CASES,
    SENT_CASES,
    f"""SELECT id, {distinct_sql("CCONJ", "SCONJ")} AS conjunctions, {distinct_sql("VERB")} AS verbs, {distinct_sql("NOUN")} AS nouns, {distinct_sql("NOUN", "VERB", "ADJ", "ADV")} AS content, {among_sql(T, an.RELATIVES)} AS relatives, {among_sql(T, an.lx.BE_FORMS)} > 0 AS has_copula,
 ends_with(trim(text), '?') OR coalesce(list_contains({list_sql([*an.QUESTION_AUX, "who", "what", "where", "why", "how", "which", "when"])}, {T}[1]), false) AS asks,
 coalesce(list_contains({list_sql([*an.lx.IMPERATIVE, "go", "see", "make", "take", "leave"])}, {T}[1]) AND NOT list_contains(['i', 'we', 'he', 'she', 'they'], {T}[2]), false) AS commands FROM cases""",
)
def tagged_words(rows: DataFrame) -> DataFrame:
    c = F.col("text")
    tagged = lambda t: F.transform(F.sort_array(F.array_distinct(t)), lambda w: F.struct(w.alias("w"), an.tag(w).alias("k")))
    known = rows.select("id", "text", tx.let(tx.tokens(c), lambda t: F.struct(tagged(t).alias("x"), tx.among(t, an.RELATIVES).alias("relatives"), (tx.among(t, an.lx.BE_FORMS) > 0).alias("has_copula"), F.slice(t, 1, 2).alias("first"))).alias("k"))
    named = lambda *names: F.transform(F.filter("k.x", lambda x: x["k"].isin(*names)), lambda x: x["w"])
    return known.select(
        "id", named("CCONJ", "SCONJ").alias("conjunctions"), named("VERB").alias("verbs"), named("NOUN").alias("nouns"), named("NOUN", "VERB", "ADJ", "ADV").alias("content"),
        "k.relatives", "k.has_copula", an.asks_by(c, F.col("k.first")).alias("asks"), an.commands_by(F.col("k.first")).alias("commands"),
    )


def verbs_sql(s: str) -> str:
    stem = "CASE WHEN regexp_matches(v, '(bb|dd|gg|kk|ll|mm|nn|pp|rr|tt)$') THEN v[1:-2] ELSE v END"
    cut = "regexp_replace(regexp_replace(w, '(ied|ies)$', 'y'), '(ed|ing|es|s)$', '')"
    return f"list_sort(list_distinct(list_filter(list_transform(list_transform(list_filter({tokens_sql(s)}, lambda w: {tag_sql('w')} = 'VERB'), lambda w: {cut}), lambda v: {stem}), lambda w: NOT list_contains({list_sql([*an.COPULAS, 'becom', 'sens'])}, w))))"


@query(
    f"""WITH {SENTS}, v AS (SELECT doc_id, para_idx, sent_idx, {verbs_sql("sentence")} AS v FROM sents), l AS (SELECT *, lag(v) OVER (PARTITION BY doc_id, para_idx ORDER BY sent_idx) AS p FROM v)
SELECT doc_id, para_idx, sent_idx, list_filter(v, lambda x: list_contains(p, x)) AS shared FROM l WHERE p IS NOT NULL AND list_has_any(v, p)"""
)
def action_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbs that a sentence shares with the one before it in its paragraph."""
    rows = tx.paragraph_rows(table(spark, sf_dir, "documents")).withColumn("v", F.transform(tx.sentences(F.col("paragraph")), an.action_verbs))
    pairs = F.zip_with(F.slice("v", F.lit(1), F.greatest(F.size("v") - 1, F.lit(0))), F.slice("v", F.lit(2), F.greatest(F.size("v") - 1, F.lit(0))), F.array_intersect)
    return rows.select("doc_id", "para_idx", F.posexplode(pairs).alias("i", "x")).where(F.size("x") > 0).select("doc_id", "para_idx", (F.col("i") + 1).alias("sent_idx"), F.array_sort("x").alias("shared"))


NAMES = rf"""list_sort(list_distinct(list_transform(list_filter(flatten(list_transform(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> ''), lambda s: {words_sql("s")}[2:])), lambda w: regexp_matches(w, '^\p{{Lu}}\p{{Ll}}+')), lambda w: regexp_replace(w, '[^\p{{L}}]+$', ''))))"""


@query(f"SELECT item_id, {NAMES} AS names FROM benchmark")
def entities_lex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", an.names(F.col("text")).alias("names"))


@query(f"WITH w AS (SELECT source, unnest({T}) AS w FROM documents), k AS (SELECT source, CASE WHEN regexp_matches(w, '{an.ABSTRACT_NOUN}') THEN 'ABSTRACT' ELSE 'CONCRETE' END AS kind FROM w WHERE {tag_sql('w')} = 'NOUN') SELECT source, kind, count(*) AS n FROM k GROUP BY source, kind")
def noun_kinds_lex(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", F.explode(tx.tokens(F.col("text"))).alias("w")).where(an.tag(F.col("w")) == "NOUN")
    return rows.select("source", F.when(F.col("w").rlike(an.ABSTRACT_NOUN), "ABSTRACT").otherwise("CONCRETE").alias("kind")).groupBy("source", "kind").agg(F.count("*").alias("n"))


KIND = f"list_transform(t, lambda w: {tag_sql('w')})"
NEAR = "list_filter(list_zip({t}, {k}), lambda x: x[2] IN ('NOUN', 'PRON'))"


@over(
    CASES,
    SENT_CASES,
    f""", t AS (SELECT id, {T} AS t FROM cases), k AS (SELECT id, t, {KIND} AS k FROM t)
SELECT id, list_transform(list_filter(range(1, len(t) + 1), lambda i: k[i] = 'VERB'), lambda i: coalesce({NEAR.format(t="t[1:i - 1]", k="k[1:i - 1]")}[-1][1], '') || '|' || t[i] || '|' || coalesce({NEAR.format(t="t[i + 1:]", k="k[i + 1:]")}[1][1], '')) AS triples FROM k""",
)
def svo_lex(rows: DataFrame) -> DataFrame:
    """Triples by order of tags."""
    return rows.select("id", an.triples(F.col("text")).alias("triples"))


@query(f"WITH {SENTS}, q AS (SELECT source, ends_with(sentence, '?') OR coalesce(list_contains({list_sql([*an.QUESTION_AUX, 'who', 'what', 'where', 'why', 'how', 'which', 'when'])}, {tokens_sql('sentence')}[1]), false) AS q FROM sents) SELECT source, count(*) AS n, CAST(count(*) FILTER (q) AS BIGINT) AS questions FROM q GROUP BY source")
def question_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sents(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_if(an.asks(F.col("sentence"))).alias("questions"))
