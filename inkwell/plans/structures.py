"""Queries of text structure, templates and whole evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import annotate as an
from ..functions import lexicon as lx
from ..functions import structure as sr
from ..functions import text as tx
from ..functions.fixture import Fixture
from .pairs import CITED, content_sql, quotes_sql, refs_sql
from .made import CITED_TURNS, SENT_CASES, TAG_SENTS, TEMPLATE_SENTS, VOICED_SENTS, para_rows, tag_sql
from .registry import SENTS, among_sql, list_sql, over, query, table, tokens_sql, words_sql
from .rules import CASES, TEMPLATES

T = tokens_sql("text")
PAIRS = f"list_transform(range(1, greatest(len({T}), 1)), lambda i: {T}[i] || ' ' || {T}[i + 1])"
MARKS = "list_filter([CASE WHEN contains(text, ',') THEN 'commas' END, CASE WHEN contains(text, '—') OR contains(text, '-') THEN 'dashes' END, CASE WHEN contains(text, ';') THEN 'semicolons' END, CASE WHEN contains(text, '(') AND contains(text, ')') THEN 'parentheses' END, CASE WHEN contains(text, '*') THEN 'asterisks' END], lambda x: x IS NOT NULL)"


def analysis_sql(key: str, source: str) -> str:
    n = f"({among_sql(T, sr.CLAUSES)} + 1)"
    return rf"""SELECT {key}, {n} AS clauses, CASE WHEN {n} = 1 THEN 'simple' WHEN {n} = 2 THEN 'compound' ELSE 'complex' END AS complexity, {MARKS} AS marks FROM {source}"""


@query(analysis_sql("conv_id, turn", "conversations"))
def analyze_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sr.clauses(c).alias("clauses"), sr.complexity(c).alias("complexity"), sr.mark_pattern(c).alias("marks"))


VOICED = Fixture("voiced", "id int, text string", [(1, "The house was painted and the door was closed."), (2, "He painted the house; she closed a door."), (3, "It is good the day is warm."), (4, "It is clear the new day begins now."), (5, ""), (6, "John: [12] see (this) - it * works."), (7, "[3] Stone is laid is set."), (8, "A plain sentence stands here.")])


@over(
    VOICED,
    VOICED_SENTS,
    rf""", p AS (SELECT id, text, {PAIRS} AS p FROM voiced) SELECT id, CASE WHEN len(list_filter(p, lambda g: regexp_matches(g, '^(is|are|was|were|been|being) \S+ed$'))) > len(list_filter(p, lambda g: regexp_matches(g, '^\S+ed (the|a|an|this|that|these|those)$'))) THEN 'passive' ELSE 'active' END AS voice,
 trim(text) <> '' AND NOT ({" OR ".join(f"regexp_matches(trim(text), '{g}')" for g in sr.GIBBERISH)}) AS sane, trim(regexp_replace(regexp_replace(trim(text), '^[A-Z][a-z]+:\s*', ''), '^\[?\d+\]?\.?\s+', '')) AS reference FROM p""",
)
def voice_and_sanity(rows: DataFrame) -> DataFrame:
    c = F.col("text")
    return rows.select("id", sr.passive_voice(c).alias("voice"), sr.sane(c).alias("sane"), sr.reference_text(c).alias("reference"))


@query(
    f"""WITH l AS (SELECT item_id, list_transform(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> ''), lambda s: CAST(len({words_sql("s")}) AS DOUBLE)) AS n FROM benchmark), m AS (SELECT item_id, n, list_avg(n) AS m FROM l),
v AS (SELECT item_id, n, m, sqrt(list_avg(list_transform(n, lambda x: (x - m) * (x - m)))) / m AS cv FROM m)
SELECT item_id, CASE WHEN len(n) < 2 OR m = 0 THEN 'Low' WHEN cv > 0.4 THEN 'High' WHEN cv < 0.15 THEN 'Low' ELSE 'Moderate' END AS variation FROM v"""
)
def slot_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = F.transform(tx.sentences(F.col("text")), lambda s: F.size(tx.words(s)).cast("double"))
    return table(spark, sf_dir, "benchmark").select("item_id", sr.variation(lengths).alias("variation"))


TAGS = Fixture("tags", "id int, target array<string>, actual array<string>", [(1, ["DT", "NN", "VBZ", "."], ["DT", "NNS", "VBD"]), (2, ["DT", "NN"], ["DT", "NN", "VB", "IN", "DT"]), (3, ["JJ", "NN", "RB"], ["VB", "IN", "RB"]), (4, [], [])])
COARSE = "list_transform(list_filter({t}, lambda t: NOT list_contains(['.', ',', '!', '?', ';', ':'], t)), lambda t: CASE WHEN regexp_matches(t, '^(NN|VB|JJ|DT|IN)') THEN t[1:2] ELSE t END)"


@over(
    TAGS,
    TAG_SENTS,
    f""", c AS (SELECT id, {COARSE.format(t="target")} AS a, {COARSE.format(t="actual")} AS b FROM tags)
SELECT id, abs(len(a) - len(b)) <= 2 AND CAST(len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i])) AS DOUBLE) / greatest(len(a), len(b), 1) >= 0.6 AS same FROM c""",
)
def structure_tags(rows: DataFrame) -> DataFrame:
    return rows.select("id", sr.same_structure(F.col("target"), F.col("actual")).alias("same"))


@query(
    f"""WITH {SENTS}, t AS (SELECT source, unnest({tokens_sql("sentence")}[1:12]) AS w, generate_subscripts({tokens_sql("sentence")}[1:12], 1) AS pos FROM sents), c AS (SELECT source, pos, {tag_sql("w")} AS tag, count(*) AS n FROM t GROUP BY ALL)
SELECT source, CAST(pos AS INTEGER) AS pos, tag FROM (SELECT *, row_number() OVER (PARTITION BY source, pos ORDER BY n DESC, tag) AS r FROM c) WHERE r = 1"""
)
def modal_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent tag at each of a sentence's first twelve places, by author, the first by name of equals."""
    each = para_rows(spark, sf_dir).select("source", F.explode(tx.sentences(F.col("paragraph"))).alias("s")).select("source", F.posexplode(F.slice(an.tags(F.col("s")), 1, 12)).alias("i", "tag"))
    counts = each.groupBy("source", (F.col("i") + 1).alias("pos"), "tag").agg(F.count("*").alias("n"))
    return counts.groupBy("source", "pos").agg(F.min(F.struct((-F.col("n")).alias("m"), "tag")).alias("b")).select("source", "pos", "b.tag")


@over(
    TEMPLATES,
    TEMPLATE_SENTS,
    f", s AS (SELECT id, list_filter(list_transform(regexp_split_to_array(template, '\\[(?:NP|VP|ADJ|ADV)\\]'), lambda x: trim(x)), lambda x: x <> '') AS a FROM templates) SELECT id, CAST(i - 1 AS INTEGER) AS pos, x AS anchor FROM (SELECT id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM s)",
)
def template_explode(rows: DataFrame) -> DataFrame:
    """The fixed parts of each template, one row each."""
    return rows.select("id", F.posexplode(sr.fixed_anchors(F.col("template"))).alias("pos", "anchor"))


@query(
    f"""WITH {SENTS}, p AS (SELECT doc_id, para_idx, count(*) AS n, list({{'action': CASE WHEN (sent_idx + doc_id) % 3 = 0 THEN 'split' ELSE 'rewrite' END, 'at': sent_idx + 1, 'reason': CASE WHEN (sent_idx + doc_id) % 3 = 1 THEN 'Repetition of words' ELSE 'rhythm' END}} ORDER BY sent_idx) AS p FROM sents GROUP BY doc_id, para_idx)
SELECT doc_id, para_idx, CASE WHEN doc_id % 10 >= 5 AND n >= 3 THEN list_transform(p, lambda x: CASE WHEN x.action = 'split' THEN 'rewrite' WHEN contains(lower(x.reason), 'repetition') AND x.at < n THEN 'merge_with_next' ELSE x.action END) ELSE list_transform(p, lambda x: x.action) END AS actions FROM p"""
)
def repair_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of one step a sentence, refined where repetition (here: the id's last digit) is high."""
    kind = lambda i: (i + F.col("doc_id")) % 3
    plan = F.transform(tx.sentences(F.col("paragraph")), lambda s, i: F.struct(F.when(kind(i) == 0, "split").otherwise("rewrite").alias("action"), (i + 1).alias("at"), F.when(kind(i) == 1, "Repetition of words").otherwise("rhythm").alias("reason")))
    rows = para_rows(spark, sf_dir).select("doc_id", "para_idx", plan.alias("plan"))
    return rows.select("doc_id", "para_idx", sr.compressed(F.col("plan"), F.col("doc_id") % 10, F.size("plan")).alias("p")).select("doc_id", "para_idx", F.col("p.action").alias("actions"))


INVENTED = rf"""list_filter(list_transform(list_filter(flatten(list_transform(list_filter(string_split(regexp_replace(generated, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> ''), lambda s: {words_sql("s")}[2:])), lambda w: regexp_matches(w, '^\p{{Lu}}\p{{Ll}}')), lambda w: regexp_replace(w, '[^\p{{L}}]+$', '')), lambda w: NOT list_contains({tokens_sql("original")}, lower(w)) AND NOT list_contains({list_sql(lx.STOPS)}, lower(w)))"""


@over(
    CITED,
    CITED_TURNS,
    f""", m AS (SELECT *, {content_sql("original")} AS a, {content_sql("generated")} AS b, len(list_filter({refs_sql("original")}, lambda x: NOT list_contains({refs_sql("generated")}, x))) + len(list_filter({quotes_sql("original")}, lambda x: NOT list_contains({quotes_sql("generated")}, x))) AS lost FROM cited),
r AS (SELECT *, CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE CAST(len(list_filter(a, lambda w: list_contains(b, w))) AS DOUBLE) / len(a) END AS r, CASE WHEN len(b) = 0 THEN 1.0::DOUBLE ELSE CAST(len(list_filter(b, lambda w: list_contains(a, w))) AS DOUBLE) / len(b) END AS p FROM m),
v AS (SELECT id, r, p, CASE WHEN trim(generated) = '' THEN 'empty' WHEN lower(trim(original)) = lower(trim(generated)) THEN 'copy' WHEN lost > 0 THEN 'citations' WHEN r < 0.5 THEN 'recall' WHEN len({INVENTED}) > 0 THEN 'invented' ELSE 'ok' END AS reason FROM r)
SELECT id, reason = 'ok' AS passed, round(CASE WHEN reason = 'ok' THEN (2 * r + p) / 3 ELSE 0.0 END, 6) AS score, reason FROM v""",
)
def evaluate_pairs(rows: DataFrame) -> DataFrame:
    """Whole evaluation of outputs against their sources: ordered gates, then a score."""
    return rows.select("id", sr.evaluated(F.col("original"), F.col("generated")).alias("e")).select("id", "e.*")


@over(
    CASES,
    SENT_CASES,
    f"SELECT id, list_sort(list_distinct(list_filter({T}, lambda w: list_contains({list_sql(lx.STOPS)}, w)))) AS stops FROM cases",
)
def stop_words(rows: DataFrame) -> DataFrame:
    return rows.select("id", sr.stops_of(F.col("text")).alias("stops"))
