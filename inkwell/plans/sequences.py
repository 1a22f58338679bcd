"""Queries over the order of words, sentences, paragraphs and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as cl
from ..functions import compare as cp
from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.fixture import Fixture
from ..operators import sequence as sq
from .made import PACK_SENTS, RHYTHM_PARAS, TURNS, USE_DOCS, turn_pairs
from .registry import SENTS, any_sql, list_sql, over, query, table, tokens_sql, words_sql
from .rules import SYNTAX
from .texts import sents


def gram_sql(n: int) -> str:
    parts = " || ' ' || ".join(f"t[i + {k}]" if k else "t[i]" for k in range(n))
    return f"""WITH w AS (SELECT doc_id, {tokens_sql("text")} AS t FROM documents), g AS (SELECT doc_id, {parts} AS phrase FROM (SELECT doc_id, t, unnest(range(1, len(t) - {n - 2})) AS i FROM w WHERE len(t) >= {n}))"""


GLUE = any_sql("phrase", lx.GLUE)


@query(f"{gram_sql(3)} SELECT doc_id, phrase, count(*) AS n FROM g WHERE NOT {GLUE} GROUP BY doc_id, phrase HAVING count(*) > 1")
def repeated_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.repeated_grams(table(spark, sf_dir, "documents"), 3)


@query(f"{gram_sql(2)} SELECT doc_id, phrase, count(*) AS n FROM g WHERE NOT {GLUE} AND NOT list_has_any(string_split(phrase, ' '), {list_sql(lx.STOPS)}) GROUP BY doc_id, phrase HAVING count(*) > 1")
def repeated_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.repeated_grams(table(spark, sf_dir, "documents"), 2, content=True)


@query(
    f"""WITH t AS (SELECT doc_id, {tokens_sql("text")} AS t FROM documents), e AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM t),
g AS (SELECT doc_id, word, lead(pos) OVER (PARTITION BY doc_id, word ORDER BY pos) - pos AS gap FROM e WHERE NOT list_contains({list_sql(lx.STOPS)}, word))
SELECT doc_id, word, CAST(min(gap) AS BIGINT) AS least_gap FROM g WHERE gap <= 10 GROUP BY doc_id, word"""
)
def proximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.proximal(table(spark, sf_dir, "documents"))


ECHO = Fixture(
    "echo_pairs",
    "id int, prev string, next string",
    [
        (1, "The doors opened.", "The doors opened. Then light came."),
        (2, "The rain fell on town.", "The rain, heavy now, fell again."),
        (3, "The doors slowly opened.", "Opened, the room was bright."),
        (4, "He saw the old red barn.", "Red barn doors swung wide."),
        (5, "She walked home alone.", "Birds sang above the roof."),
        (6, "It was the house.", "It rained."),
        (7, "", "Something."),
        (8, "They saw a grey river bend.", "River bend and grey sky met."),
        (9, "He stood on the bridge", "bridge on the river stood"),
        (10, "One.", "Two."),
    ],
)
CLEAN = r"list_filter(list_transform({w}, lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}_]', '', 'g')), lambda x: x <> '')"
ECHO_SQL = f"""j AS (SELECT *, {CLEAN.format(w=words_sql("lower(prev)"))} AS p, {CLEAN.format(w=words_sql("lower(next)"))} AS n, trim(lower(prev)) AS a, trim(lower(next)) AS b FROM {{src}}),
k AS (SELECT *, p[greatest(len(p) - 5, 1):] AS t6, p[greatest(len(p) - 2, 1):] AS t3, p[greatest(len(p) - 1, 1):] AS t2, n[1:3] AS s, NOT list_contains({list_sql(lx.ECHO_COMMON)}, n[1]) AS rare FROM j),
echo AS (SELECT *, a <> '' AND b <> '' AND (starts_with(b, a) OR (len(p) >= 2 AND len(n) >= 2 AND (p[1:2] = n[1:2] OR (n[1] = p[-1] AND rare) OR (list_contains(t2, n[1]) AND rare AND len(list_filter(s, lambda w: list_contains(t6, w))) >= 2)
 OR len(list_filter(range(1, len(s)), lambda i: len(list_filter(range(1, len(t3)), lambda q: s[i] = t3[q] AND s[i + 1] = t3[q + 1])) > 0)) > 0))) AS echo FROM k)"""


@query(f"WITH {ECHO.cte()}, {ECHO_SQL.replace('{src}', 'echo_pairs')} SELECT id, coalesce(echo, false) AS echo FROM echo")
def zipper_echo_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ECHO.df(spark).select("id", cp.echoes(F.col("prev"), F.col("next")).alias("echo"))


@query(
    f"""WITH {SENTS}, pairs AS (SELECT doc_id, para_idx, sent_idx, lag(sentence) OVER (PARTITION BY doc_id, para_idx ORDER BY sent_idx) AS prev, sentence AS next FROM sents), adjacent AS (SELECT * FROM pairs WHERE prev IS NOT NULL), {ECHO_SQL.replace("{src}", "adjacent")}
SELECT doc_id, para_idx, sent_idx FROM echo WHERE echo"""
)
def zipper_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that echo the one before; neighbours come from the paragraph's own array, so nothing is shuffled."""
    rows = tx.paragraph_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "para_idx", F.explode(cp.echoing(tx.sentences(F.col("paragraph")))).alias("sent_idx"))


USES = Fixture("uses", "doc_id int, pos int, token string", [(1, 1, "A"), (1, 2, "vast"), (1, 30, "Vast"), (1, 90, "vast"), (1, 91, "profound"), (2, 5, "intricate"), (2, 6, "river"), (2, 200, "intricate"), (2, 260, "Intricate"), (2, 261, "intricate")])
LIMITED = [*lx.RESTRICTED, "the", "of", "was"]


@over(
    USES,
    USE_DOCS,
    f""", u AS (SELECT doc_id, pos, lower(token) AS word FROM uses WHERE list_contains({list_sql(LIMITED)}, lower(token))),
b AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, word ORDER BY pos) - 1 AS INTEGER) AS used, pos - lag(pos) OVER (PARTITION BY doc_id, word ORDER BY pos) AS gap FROM u)
SELECT doc_id, pos, word, used, CASE WHEN used >= 2 THEN 'FORBIDDEN' WHEN coalesce(gap < 50, false) THEN 'CLUSTERING_VIOLATION' ELSE 'ALLOWED' END AS status FROM b""",
)
def budget_violations(rows: DataFrame) -> DataFrame:
    """Uses of restricted words against an allowance of two a text."""
    return sq.budget(rows, 2, lx.CLUSTERING_DISTANCE, LIMITED)


@query(f"WITH e AS (SELECT doc_id, unnest({tokens_sql('text')}) AS word FROM documents), r AS (SELECT unnest({list_sql(['the', 'of', 'and', 'vast'])}) AS word) SELECT r.word, count(e.word) AS n, count(DISTINCT e.doc_id) AS docs, CASE WHEN count(e.word) >= 100 THEN 'forbidden' WHEN count(e.word) > 0 THEN 'warning' ELSE 'free' END AS state FROM r LEFT JOIN e ON e.word = r.word GROUP BY r.word")
def budget_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of each listed word, unused ones too; counted per document before anything is shuffled."""
    words = ["the", "of", "and", "vast"]
    used = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("word")).where(F.col("word").isin(words))
    counts = used.groupBy("word", "doc_id").agg(F.count("*").alias("n")).groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    listed = spark.createDataFrame([(w,) for w in words], "word string").join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("docs", F.lit(0).cast("long")).alias("docs"))
    return listed.withColumn("state", F.when(F.col("n") >= 100, "forbidden").when(F.col("n") > 0, "warning").otherwise("free"))


@query(
    f"""WITH {SENTS}, o AS (SELECT doc_id, para_idx AS pos, {tokens_sql("sentence")}[1] AS opener FROM sents WHERE sent_idx = 0),
s AS (SELECT *, CASE WHEN opener IS NULL THEN 0.0::DOUBLE ELSE CAST(count(*) OVER (PARTITION BY doc_id, opener ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) / greatest(count(*) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) END AS share FROM o)
SELECT doc_id, pos, opener, round(CASE WHEN share <= 0.3 THEN 1.0 ELSE greatest(0.0, 1.0 - (share - 0.3) * 2.0) END, 6) AS penalty FROM s"""
)
def opener_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tx.paragraph_rows(table(spark, sf_dir, "documents")).select("doc_id", F.col("para_idx").alias("pos"), F.get(tx.tokens(F.get(tx.sentences(F.col("paragraph")), F.lit(0))), F.lit(0)).alias("opener"))
    return sq.opener_penalties(rows).select("doc_id", "pos", "opener", F.round("penalty", 6).alias("penalty"))


RHYTHM = Fixture(
    "rhythm",
    "doc_id int, pos int, opener string, lengths array<string>, types array<string>",
    [(1, 0, "The", ["short", "long"], ["standard", "question"]), (1, 1, "But", ["short", "long"], ["standard", "question"]), (1, 2, "the", ["short", "long"], ["standard", "question"]), (1, 3, None, ["medium"], ["standard"]), (1, 4, "The", ["short", "long"], ["standard", "question"]), (2, 0, "A", ["long"], ["question"])],
)
OVERLAP = "CASE WHEN len(x.{f}) = 0 OR len(y.{f}) = 0 THEN 0.0::DOUBLE ELSE CAST(len(list_filter(range(1, least(len(x.{f}), len(y.{f})) + 1), lambda i: x.{f}[i] = y.{f}[i])) AS DOUBLE) / greatest(len(x.{f}), len(y.{f})) END"


@over(
    RHYTHM,
    RHYTHM_PARAS,
    f""", s AS (SELECT x.doc_id, x.pos, CASE WHEN x.opener IS NOT DISTINCT FROM y.opener AND x.lengths = y.lengths AND x.types = y.types THEN 1.0::DOUBLE ELSE (1.0 - abs(len(x.lengths) - len(y.lengths))::DOUBLE / greatest(len(x.lengths), len(y.lengths), 1)) * 0.15 + CASE WHEN lower(coalesce(x.opener, 'none')) = lower(coalesce(y.opener, 'none')) THEN 0.35 ELSE 0.0 END + {OVERLAP.format(f="lengths")} * 0.15 + {OVERLAP.format(f="types")} * 0.35 END AS sim
FROM rhythm x JOIN rhythm y ON x.doc_id = y.doc_id AND y.pos < x.pos)
SELECT r.doc_id, r.pos, round(1.0 - coalesce(max(sim), 0.0), 6) AS diversity FROM rhythm r LEFT JOIN s ON s.doc_id = r.doc_id AND s.pos = r.pos GROUP BY r.doc_id, r.pos""",
)
def structure_diversity(rows: DataFrame) -> DataFrame:
    return sq.diversity(rows)


PACK = Fixture("packs", "para_id int, pos int, words int", [(1, 1, 5), (1, 2, 9), (1, 3, 4), (1, 4, 20), (1, 5, 3), (1, 6, 8), (2, 1, 40), (2, 2, 1)])


@over(
    PACK,
    PACK_SENTS,
    """, l AS (SELECT para_id, list(words ORDER BY pos) AS l FROM packs GROUP BY para_id)
SELECT para_id, list_reduce(list_transform(l, lambda n: [n]), lambda a, x: CASE WHEN a[-1] + x[1] <= 22.5 THEN list_concat(a[1:-2], [a[-1] + x[1]]) ELSE list_concat(a, x) END) AS slots FROM l""",
)
def synthetic_packing(rows: DataFrame) -> DataFrame:
    """Sentences packed in order into slots of at most 22.5 words."""
    rows = rows.groupBy("para_id").agg(F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("w"))
    return rows.select("para_id", sq.packed(F.col("w.words"), F.lit(22.5)).alias("slots"))


@query(f"WITH {SENTS}, m AS (SELECT doc_id, para_idx, sent_idx, len({words_sql('sentence')}) AS n FROM sents) SELECT doc_id, para_idx, CAST(sent_idx AS INTEGER) AS slot, n AS target_len, CASE WHEN n < 15 THEN 'simple' WHEN n < 25 THEN 'moderate' ELSE 'complex' END AS type FROM m")
def structure_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tx.count(tx.words(F.col("sentence")))
    return sents(spark, sf_dir).select("doc_id", "para_idx", F.col("sent_idx").alias("slot"), n.alias("target_len"), cl.slot_type(n).alias("type"))


FLOW = f"""t AS (SELECT source, doc_id, para_idx, sent_idx, {SYNTAX.replace("text", "sentence")} AS k FROM sents), n AS (SELECT source, k AS src, lead(k) OVER (PARTITION BY doc_id ORDER BY para_idx, sent_idx) AS tgt FROM t),
c AS (SELECT source, src, tgt, count(*) AS n FROM n WHERE tgt IS NOT NULL GROUP BY source, src, tgt), flow AS (SELECT *, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY source, src), 8) AS p FROM c)"""


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sents(spark, sf_dir).withColumn("k", cl.syntax_type(F.col("sentence")))
    return sq.transitions(rows, ["doc_id"], ["para_idx", "sent_idx"], "k", "source")


@query(f"WITH {SENTS}, {FLOW} SELECT source, src, tgt, n, p FROM flow")
def sentence_type_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow(spark, sf_dir)


@query(f"WITH {SENTS}, {FLOW} SELECT source, src, tgt AS next_type FROM (SELECT *, row_number() OVER (PARTITION BY source, src ORDER BY p DESC, tgt) AS r FROM flow) WHERE r = 1")
def next_type_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest next type, the first by name of equals."""
    best = flow(spark, sf_dir).groupBy("source", "src").agg(F.min(F.struct((-F.col("p")).alias("q"), "tgt")).alias("b"))
    return best.select("source", "src", F.col("b.tgt").alias("next_type"))


@query(
    f"""WITH {SENTS}, t AS (SELECT source, {SYNTAX.replace("text", "sentence")} AS k, sent_idx = 0 AS f, sent_idx = max(sent_idx) OVER (PARTITION BY doc_id, para_idx) AS l FROM sents)
SELECT source, k AS type, CAST(count(*) FILTER (f) AS BIGINT) AS starts, CAST(count(*) FILTER (l) AS BIGINT) AS ends FROM t GROUP BY source, k"""
)
def flow_start_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tx.paragraph_rows(table(spark, sf_dir, "documents")).withColumn("s", tx.sentences(F.col("paragraph")))
    each = rows.select("source", F.size("s").alias("n"), F.posexplode("s").alias("i", "sentence")).withColumn("type", cl.syntax_type(F.col("sentence")))
    return each.groupBy("source", "type").agg(F.count_if(F.col("i") == 0).alias("starts"), F.count_if(F.col("i") == F.col("n") - 1).alias("ends"))


PENALTY = "CASE WHEN coalesce(least(len(a), len(b)) >= 3 AND CAST(len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i])) AS DOUBLE) / least(len(a), len(b)) >= 0.8, false) THEN 0.5::DOUBLE ELSE 0.0 END"


@query(f"WITH {TURNS}, w AS (SELECT conv_id, turn, {words_sql('lower(text)')}[1:5] AS a, {words_sql('lower(prev)')}[1:5] AS b FROM turns WHERE prev IS NOT NULL) SELECT conv_id, turn, {PENALTY} AS penalty FROM w")
def repetition_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", cp.repetition_penalty(F.col("text"), F.col("prev")).alias("penalty"))


@query(
    f"""WITH {ECHO.cte()}, w AS (SELECT id, {words_sql("lower(next)")}[1:5] AS a, {words_sql("lower(prev)")}[1:5] AS b FROM echo_pairs) SELECT id, {PENALTY} AS penalty FROM w"""
)
def repetition_penalty_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ECHO.df(spark).select("id", cp.repetition_penalty(F.col("next"), F.col("prev")).alias("penalty"))
