"""Queries that choose among templates, build palettes and indexes, and verify person."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import annotate as an
from ..functions import classify as cl
from ..functions import gates as gt
from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.fixture import Fixture, Made
from .made import CANDIDATE_PARAS, SENT_CASES, TEMPLATE_SENTS, tag_sql
from .registry import SENTS, among_sql, list_sql, over, query, table, tokens_sql
from .rules import CASES, PERSONS, SYNTAX, TEMPLATES
from .texts import sents

T = tokens_sql("text")
SKELETONS = Fixture("candidates", "id int, n_sents int, style int, capacity int, words int, used boolean", [(1, 3, 5, 4, 20, False), (2, 4, 2, 4, 31, True), (3, 4, 4, 6, 44, False), (4, 2, 1, 1, 29, False), (5, 4, 4, 6, 30, False)])


@over(
    SKELETONS,
    CANDIDATE_PARAS,
    f"SELECT id, round(0.5 / (1 + abs(n_sents - 4)) + 0.3 * style / 5.0 + 0.2 / (1 + abs(capacity - 4)), 6)::DOUBLE AS score FROM candidates",
)
def robust_skeleton(rows: DataFrame) -> DataFrame:
    """How well each skeleton serves four sentences and four propositions: half sentences, three tenths style, two tenths capacity."""
    score = 0.5 / (1 + F.abs(F.col("n_sents") - 4)) + 0.3 * F.col("style") / 5.0 + 0.2 / (1 + F.abs(F.col("capacity") - 4))
    return rows.select("id", F.round(score, 6).alias("score"))


@over(
    SKELETONS,
    CANDIDATE_PARAS,
    f"SELECT id, round(1.0 / (abs(words - 30) + 1), 6)::DOUBLE AS score FROM candidates WHERE NOT used ORDER BY 2 DESC, 1 LIMIT 3",
)
def select_template(rows: DataFrame) -> DataFrame:
    """The three best templates for thirty words among those not used of late."""
    score = F.round(1.0 / (F.abs(F.col("words") - 30) + 1), 6)
    return rows.where("not used").select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(3)


@query(f"WITH w AS (SELECT source, unnest({T}) AS w FROM documents) SELECT source, list_sort(coalesce(list(DISTINCT w) FILTER (list_contains({list_sql(lx.SENSORY_VERBS)}, w)), [])) AS sensory, list_sort(coalesce(list(DISTINCT w) FILTER (list_contains({list_sql([*lx.COORDINATORS, *lx.SUBORDINATORS])}, w)), [])) AS connectives FROM w GROUP BY source")
def vocabulary_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each author's sensory verbs and connectives; sets of listed words, so of bounded size."""
    w = table(spark, sf_dir, "documents").select("source", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("w"))
    pick = lambda known: F.array_sort(F.collect_set(F.when(F.col("w").isin(known), F.col("w"))))
    return w.groupBy("source").agg(pick(lx.SENSORY_VERBS).alias("sensory"), pick([*lx.COORDINATORS, *lx.SUBORDINATORS]).alias("connectives"))


@query(f"WITH w AS (SELECT unnest({T}) AS w FROM documents), c AS (SELECT w AS word, {tag_sql('w')} AS tag, count(*) AS n FROM w WHERE length(w) > 2 GROUP BY w HAVING tag IN ('ADJ', 'VERB', 'ADV')) SELECT tag, word, n, CAST(row_number() OVER (PARTITION BY tag ORDER BY n DESC, word) AS INTEGER) AS rank FROM c QUALIFY rank <= 20")
def global_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most frequent adjectives, verbs and adverbs of all texts."""
    counts = table(spark, sf_dir, "documents").select(F.explode(tx.tokens(F.col("text"))).alias("word")).where(F.length("word") > 2).groupBy("word").agg(F.count("*").alias("n"))
    tagged = counts.withColumn("tag", an.tag(F.col("word"))).where(F.col("tag").isin("ADJ", "VERB", "ADV"))
    return tagged.withColumn("rank", F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("n"), "word"))).where("rank <= 20").select("tag", "word", "n", "rank")


POS, NEG = among_sql(tokens_sql("sentence"), lx.POSITIVE), among_sql(tokens_sql("sentence"), lx.NEGATIVE)
MOOD = f"CASE WHEN CAST({POS} - {NEG} AS DOUBLE) / greatest(len({tokens_sql('sentence')}), 1) >= 0.05 THEN 'Positive' WHEN CAST({POS} - {NEG} AS DOUBLE) / greatest(len({tokens_sql('sentence')}), 1) <= -0.05 THEN 'Negative' ELSE 'Neutral' END"


@query(
    f"""WITH {SENTS}, t AS (SELECT doc_id, para_idx, sent_idx, {SYNTAX.replace("text", "sentence")} AS type, {MOOD} AS sentiment FROM sents)
SELECT doc_id, para_idx, sent_idx, type, sentiment, lag(type) OVER (PARTITION BY doc_id, para_idx ORDER BY sent_idx) AS previous_type FROM t"""
)
def context_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence with its type, mood and the type before it, from the paragraph's own array."""
    rows = tx.paragraph_rows(table(spark, sf_dir, "documents")).withColumn("x", F.transform(tx.sentences(F.col("paragraph")), lambda s: tx.let(tx.tokens(s), lambda t: F.struct(cl.syntax_of(t).alias("type"), cl.sentiment_of(t).alias("sentiment")))))
    return rows.select("doc_id", "para_idx", "x", F.posexplode_outer("x").alias("sent_idx", "y")).where("sent_idx IS NOT NULL").select("doc_id", "para_idx", "sent_idx", "y.type", "y.sentiment", F.get("x.type", F.col("sent_idx") - 1).alias("previous_type"))


@over(
    CASES,
    SENT_CASES,
    f", p AS (SELECT id, {PERSONS['a']} AS a, {PERSONS['b']} AS b, {PERSONS['c']} AS c FROM cases) SELECT id, a > 0 AND b = 0 OR (a = 0 AND b = 0 AND c = 0) AS first_singular, a = 0 AND b = 0 AS third FROM p",
)
def verify_perspective(rows: DataFrame) -> DataFrame:
    """Whether a text keeps to a person: its pronouns there (or none at all), another first person's not."""
    t = F.array_distinct(tx.tokens(F.col("text")))
    a, b, c = (tx.among(t, x) for x in (lx.FIRST_SINGULAR, lx.FIRST_PLURAL, lx.THIRD_PERSON))
    return rows.select("id", (((a > 0) & (b == 0)) | ((a == 0) & (b == 0) & (c == 0))).alias("first_singular"), ((a == 0) & (b == 0)).alias("third"))


LABELS = Fixture("labels_given", "label string", [("First Person Singular",), ("first person (plural)",), ("Third Person",), ("I",), ("we",), ("other",)])
GIVEN = "CASE doc_id % 5 WHEN 0 THEN 'First Person Singular' WHEN 1 THEN 'first person (plural)' WHEN 2 THEN 'Third Person' WHEN 3 THEN 'we' ELSE source END"
LABEL_DOCS = Made("labels_given", f"labels_given AS (SELECT {GIVEN} AS label FROM documents)", lambda spark, sf_dir: table(spark, sf_dir, "documents").select(F.expr(GIVEN).alias("label")))


@over(
    LABELS,
    LABEL_DOCS,
    f"SELECT label, CASE WHEN lower(label) = 'i' OR (contains(lower(label), 'first') AND contains(lower(label), 'singular')) THEN 'first_person_singular' WHEN lower(label) = 'we' OR (contains(lower(label), 'first') AND contains(lower(label), 'plural')) THEN 'first_person_plural' ELSE 'third_person' END AS perspective FROM labels_given",
)
def normalize_perspective(rows: DataFrame) -> DataFrame:
    low = F.lower("label")
    first = low.contains("first")
    return rows.select("label", F.when((low == "i") | (first & low.contains("singular")), "first_person_singular").when((low == "we") | (first & low.contains("plural")), "first_person_plural").otherwise("third_person").alias("perspective"))


@query(
    f"""WITH {SENTS}, n AS (SELECT doc_id, para_idx, sent_idx, len({tokens_sql("sentence")}) - 20 AS gap FROM sents)
SELECT doc_id, para_idx, CAST(sent_idx + 1 AS INTEGER) AS sentence, CASE WHEN gap > 10 THEN 'split' ELSE 'combine' END AS action, gap FROM n WHERE abs(gap) > 10"""
)
def qualitative_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences more than ten words off a target of twenty and what to do with them."""
    gap = tx.count(tx.tokens(F.col("sentence"))) - 20
    return sents(spark, sf_dir).select("doc_id", "para_idx", (F.col("sent_idx") + 1).alias("sentence"), F.when(gap > 10, "split").otherwise("combine").alias("action"), gap.alias("gap")).where(F.abs("gap") > 10)


CACHE = Fixture("cache", "digest string, value string", [("c6bd3b4a6f0be2b5d4d5d0ea15d7c1c4", "stale"), ("0cc175b9c0f1b6a831c399e269772661", "kept")])
ASKED = Fixture("asked", "text string", [("a",), ("b",)])


CACHED = Made(
    "held",
    "cache AS (SELECT md5(text) AS digest, 'kept ' || min(item_id) AS value FROM benchmark WHERE item_id % 2 = 0 GROUP BY md5(text)), asked AS (SELECT text FROM benchmark)",
    lambda spark, sf_dir: table(spark, sf_dir, "benchmark").select("text", F.md5("text").alias("digest"), "item_id"),
)


@query(f"WITH {CACHED.cte()} SELECT md5(text) AS digest, value, value IS NULL AS missing FROM asked LEFT JOIN cache ON md5(text) = digest")
def template_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached answers by the digest of their text, and what is missing; the cache holds every second text."""
    asked = CACHED.df(spark, sf_dir)
    cache = asked.where("item_id % 2 = 0").groupBy("digest").agg(F.concat(F.lit("kept "), F.min("item_id").cast("string")).alias("value"))
    return asked.select("digest").join(cache, "digest", "left").select("digest", "value", F.col("value").isNull().alias("missing"))


@query(f"WITH {CACHE.cte()}, {ASKED.cte()} SELECT text, value, value IS NULL AS missing FROM asked LEFT JOIN cache ON md5(text) = digest")
def template_cache_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ASKED.df(spark).withColumn("digest", F.md5("text")).join(CACHE.df(spark), "digest", "left").select("text", "value", F.col("value").isNull().alias("missing"))


ANCHORS = r"len(list_filter(list_filter(regexp_split_to_array(regexp_replace(template, '\[[^\]]+\]', ' ', 'g'), '\s+'), lambda w: w <> ''), lambda w: regexp_matches(w, '[\p{L}\p{N}]')))"
SLOTS = r"len(regexp_extract_all(template, '\[[^\]]+\]'))"


@over(
    TEMPLATES,
    TEMPLATE_SENTS,
    f""", h AS (SELECT id, coalesce(nullif(id % 6, 0), 3) AS score, length(template) >= 20 AND {ANCHORS} >= 2 AND {SLOTS} > 0 AND CAST({ANCHORS} AS DOUBLE) / ({ANCHORS} + {SLOTS}) < 0.8 AS valid FROM templates)
SELECT id, score, valid, valid AND score >= 3 AS kept FROM h""",
)
def curate_templates(rows: DataFrame) -> DataFrame:
    """Templates kept: sound ones with a score (here from the id, or from the number that ends it) of three or more; a missing score counts three."""
    number = F.regexp_extract("id", "[0-9]+$", 0).cast("int") if dict(rows.dtypes)["id"] == "string" else F.col("id")
    rows = rows.select("id", F.coalesce(F.nullif(number % 6, F.lit(0)), F.lit(3)).alias("score"), gt.anchor_health(F.col("template"))["valid"].alias("valid"))
    return rows.withColumn("kept", F.col("valid") & (F.col("score") >= 3))


@query(f"WITH {SENTS}, p AS (SELECT source, doc_id, para_idx, avg(CAST(len({tokens_sql('sentence')}) AS DOUBLE)) AS m FROM sents GROUP BY source, doc_id, para_idx) SELECT source, round(coalesce(avg(CASE WHEN m > 0 THEN m END), 25.0), 6) AS avg_len FROM p GROUP BY source")
def author_average_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the paragraphs' positive mean sentence lengths, 25 without any."""
    n = F.transform(tx.sentences(F.col("paragraph")), lambda s: F.size(tx.tokens(s)).cast("double"))
    mean = tx.let(n, lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs))
    rows = tx.paragraph_rows(table(spark, sf_dir, "documents")).select("source", mean.alias("m"))
    return rows.groupBy("source").agg(F.round(F.coalesce(F.avg(F.when(F.col("m") > 0, F.col("m"))), F.lit(25.0)), 6).alias("avg_len"))
