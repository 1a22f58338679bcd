"""Queries of classifiers and gates, over the tables and over small cases that reach every branch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as cl
from ..functions import gates as gt
from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.fixture import Fixture
from ..operators import measure as ms
from .made import ENDING_PARAS, FIT_TURNS, METRIC_DOCS, SENT_CASES, TEMPLATE_SENTS, TURNS, turn_pairs
from .registry import SENTS, among_sql, any_sql, list_sql, over, query, table, tokens_sql, words_sql
from .texts import sents

CASES = Fixture(
    "cases",
    "id int, text string",
    [
        (1, "A star is a ball of gas."),
        (2, "This is a good example of the form."),
        (3, "Consider the river before the bridge."),
        (4, "Therefore the bridge must stand alone."),
        (5, "Rain fell on the roof all night long."),
        (6, "   "),
        (7, "What makes a bridge stand?"),
        (8, "When did the rain begin to fall?"),
        (9, "When rain falls, the river rises."),
        (10, "If you see the bridge, turn left."),
        (11, "CHAPTER ONE THE RIVER RISES TODAY AGAIN."),
        (12, "See page 12 for the whole list of rivers."),
        (13, "[12] The river rose over the old bridge."),
        (14, "The river ran, the river ran, the river ran, the river ran."),
        (15, "The river rose over the"),
        (16, "The river rose. then it fell again to the bed. It rests."),
        (17, "The Human View Of Discrete Levels Scale Local Perspective Artifact Observe."),
        (18, "He ran. He sat. He slept. He woke."),
        (19, "The bridge stood because we built it. It will not fall, and the good river knows."),
        (20, "I saw my house; you saw your road. They, too, went home!"),
        (21, "Unless the river falls, the bridge is lost."),
        (22, "Terrible, awful rain."),
    ],
)

RHETORIC = f"""CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN 'UNKNOWN' WHEN {any_sql("lower(text)", lx.DESCRIPTIVE)} THEN 'OBSERVATION' WHEN {any_sql("lower(text)", lx.DEFINITION)} THEN 'DEFINITION'
WHEN list_contains({list_sql(lx.IMPERATIVE)}, lower({words_sql("text")}[1])) THEN 'IMPERATIVE' WHEN {any_sql("lower(text)", lx.ARGUMENT)} THEN 'ARGUMENT' ELSE 'OBSERVATION' END"""


@query(f"WITH {CASES.cte()} SELECT id, {RHETORIC} AS rhetoric FROM cases")
def rhetoric_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CASES.df(spark).select("id", cl.rhetoric(F.col("text")).alias("rhetoric"))


@query(f"WITH {SENTS} SELECT doc_id, para_idx, {RHETORIC.replace('text', 'sentence')} AS rhetoric FROM sents WHERE sent_idx = 0")
def rhetoric_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rhetorical type of each paragraph, by its first sentence."""
    rows = tx.paragraph_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "para_idx", cl.rhetoric(F.get(tx.sentences(F.col("paragraph")), F.lit(0))).alias("rhetoric"))


LOW = "regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g')"
TYPE = f"""CASE WHEN ends_with({LOW}, '?') OR {any_sql(LOW, lx.QUESTION_STARTS, "starts_with")} OR regexp_matches({LOW}, '{lx.WHEN_QUESTION}') THEN 'QUESTION' WHEN starts_with({LOW}, 'when ') OR regexp_matches({LOW}, '{lx.CONDITIONAL_START}') THEN 'CONDITIONAL' ELSE 'DECLARATIVE' END"""
T = tokens_sql("text")
SYNTAX = f"""CASE WHEN len({T}) < 4 THEN 'Fragment' WHEN {among_sql(T, lx.COORDINATORS)} > 0 THEN 'Compound' WHEN {among_sql(T, lx.SUBORDINATORS)} > 0 THEN 'Complex' ELSE 'Simple' END"""
SCORE = f"CAST({among_sql(T, lx.POSITIVE)} - {among_sql(T, lx.NEGATIVE)} AS DOUBLE) / greatest(len({T}), 1)"


@query(f"WITH {CASES.cte()} SELECT id, {TYPE} AS sentence_type, {SYNTAX} AS syntax_type, CASE WHEN {SCORE} >= 0.05 THEN 'Positive' WHEN {SCORE} <= -0.05 THEN 'Negative' ELSE 'Neutral' END AS sentiment FROM cases")
def sentence_type_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return CASES.df(spark).select("id", cl.sentence_type(c).alias("sentence_type"), cl.syntax_type(c).alias("syntax_type"), cl.sentiment(c).alias("sentiment"))


@query(f"WITH {SENTS} SELECT syntax_type, count(*) AS n FROM (SELECT {SYNTAX.replace('text', 'sentence')} AS syntax_type FROM sents) GROUP BY syntax_type")
def sentence_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sents(spark, sf_dir).select(cl.syntax_type(F.col("sentence")).alias("syntax_type")).groupBy("syntax_type").agg(F.count("*").alias("n"))


PERSONS = {k: among_sql(f"list_distinct({T})", x) for k, x in (("a", lx.FIRST_SINGULAR), ("b", lx.FIRST_PLURAL), ("c", lx.THIRD_PERSON))}


@query(f"""WITH p AS (SELECT conv_id, turn, {PERSONS["a"]} AS a, {PERSONS["b"]} AS b, {PERSONS["c"]} AS c FROM conversations) SELECT conv_id, turn, CASE WHEN a > 0 AND a >= b AND a >= c THEN 'first_person_singular' WHEN b > 0 AND b >= c THEN 'first_person_plural' ELSE 'third_person' END AS perspective FROM p""")
def input_perspective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ms.perspective(F.col("text")).alias("perspective"))


ENDINGS = Fixture("endings", "id int, paragraph string", [(1, "The door closed. Ultimately, the lesson is that time heals."), (2, "The door closed. He put 3 coins by the 2 keys at number 9."), (3, "We walked home. In 1999 Anna met Bert and Carla in Delft."), (4, "Rain fell. The cat slept on the warm stove."), (5, "It rained. Thus meaning is made."), (6, "One sentence of wisdom.")])


@over(
    ENDINGS,
    ENDING_PARAS,
    rf""", l AS (SELECT id, list_filter(list_transform(string_split(regexp_replace(paragraph, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[-1] AS s FROM endings),
w AS (SELECT id, {tokens_sql("s")} AS t, {words_sql("s")} AS w FROM l)
SELECT id, coalesce((list_contains({list_sql(lx.MORAL_OPENERS)}, t[1]) OR {among_sql("t", lx.MORAL_NOUNS)} > 0) AND len(list_filter(w[2:], lambda x: regexp_matches(x, '^[A-Z][a-z]'))) + len(list_filter(t, lambda x: regexp_matches(x, '^[0-9]+$'))) < 3, false) AS moralizing FROM w""",
)
def moralizing_endings(rows: DataFrame) -> DataFrame:
    return rows.select("id", cl.moralizing(F.col("paragraph")).alias("moralizing"))


def most_sql(items: str) -> str:
    return f"coalesce(list_max(map_values(list_histogram({items}))), 0)"


W = words_sql("text")
PAIRS = f"list_transform(range(1, greatest(len({W}), 1)), lambda i: lower({W}[i]) || ' ' || lower({W}[i + 1]))"
STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
VALID = rf"""NOT (len({W}) < 6 OR NOT regexp_matches(lower(text), '[aeiouy]') OR {any_sql(f"lower({STRIP})", lx.NAVIGATION_STARTS, "starts_with")} OR {" OR ".join(f"regexp_matches(text, '(?i){p}')" for p in gt.DIALOGUE)}
 OR NOT regexp_matches({STRIP}, '[.!?"'']$') OR regexp_matches({STRIP}, '^\[?\d+\]?\.?\s*[A-Z]') OR (upper(text) = text AND regexp_matches(text, '[A-Za-z]') AND len({W}) < 10) OR {most_sql(PAIRS)} > 3
 OR ({any_sql("lower(text)", lx.NAVIGATION)} AND len({W}) < 12) OR (len(regexp_extract_all(text, '\.')) > 3 AND NOT contains(text, '...')))"""


@query(f"WITH {CASES.cte()} SELECT id, {VALID} AS valid FROM cases")
def template_validity_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CASES.df(spark).select("id", gt.valid_template(F.col("text")).alias("valid"))


@query(f"WITH turns AS (SELECT item_id, text FROM benchmark) SELECT item_id, {VALID} AS valid FROM turns")
def template_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", gt.valid_template(F.col("text")).alias("valid"))


BARE = r"regexp_replace(lower({w}), '^[.,!?;:()\[\]{{}}''\"]+|[.,!?;:()\[\]{{}}''\"]+$', '', 'g')".replace('\\"', '"')
COMPLETE = rf"""regexp_matches(text, '[.!?"'']$') AND NOT list_contains({list_sql(lx.DANGLING)}, coalesce({BARE.format(w=W + "[-1]")}, '')) AND
 len(list_filter(regexp_split_to_array(text, '[.!?]+\s+')[1:-2], lambda s: NOT (len({words_sql("s")}) < 3 OR regexp_matches(s, '^\p{{Lu}}')))) = 0"""


@query(f"WITH {CASES.cte()} SELECT id, {COMPLETE} AS complete FROM cases")
def text_complete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CASES.df(spark).select("id", gt.complete(F.col("text")).alias("complete"))


@query(f"SELECT conv_id, turn, {COMPLETE} AS complete FROM conversations")
def text_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", gt.complete(F.col("text")).alias("complete"))


COHERENT = rf"""NOT ((len({W}) > 5 AND CAST(len(list_filter({W}[2:], lambda x: regexp_matches(x, '^\p{{Lu}}'))) AS DOUBLE) / len({W}) > 0.65) OR (len({W}) > 8 AND len(list_filter({W}[2:], lambda x: regexp_matches(x, '^\p{{Lu}}') AND NOT list_contains({list_sql(lx.CAPITAL_EXEMPT)}, lower(regexp_replace(x, '^[.,!?;:]+|[.,!?;:]+$', '', 'g'))))) >= 8))"""


@query(f"WITH {SENTS} SELECT doc_id, count(*) AS n, CAST(count(*) FILTER ({COHERENT.replace('text', 'sentence')}) AS BIGINT) AS coherent FROM sents GROUP BY doc_id")
def coherence_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sents(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(gt.coherent(F.col("sentence"))).alias("coherent"))


PARTS = r"list_filter(list_transform(regexp_split_to_array(text, '[.!?]+\s+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
FIRSTS = f"list_filter(list_transform({PARTS}, lambda s: {BARE.format(w=words_sql('s') + '[1]')}), lambda x: NOT list_contains({list_sql(lx.OPENER_EXEMPT)}, x))"


@over(
    CASES,
    SENT_CASES,
    f"SELECT id, len({W}) > 5 AND {most_sql(PAIRS)} > 3 AS pairs, len({PARTS}) >= 3 AND len({FIRSTS}) >= 3 AND {most_sql(FIRSTS)} > 2 AS starts FROM cases",
)
def repetition_gate(rows: DataFrame) -> DataFrame:
    return rows.select("id", gt.repetitive(F.col("text")).alias("r")).select("id", "r.pairs", "r.starts")


TEMPLATES = Fixture("templates", "id int, template string", [(1, "The [NP] is [ADJ] because [CLAUSE]."), (2, "Nothing is fixed in this whole sentence here."), (3, "[NP] stands [ADV]."), (4, "Because [VP] we all went home and slept all through the night."), (5, "short [NP]"), (6, "[NP the old one] and [VP] and [ADJ] or [ADV] for [CLAUSE]."), (7, "[NP] [VP] [NP] [ADJ] [ADV] of old")])
ANCHORS = r"len(list_filter(list_filter(regexp_split_to_array(regexp_replace(template, '\[[^\]]+\]', ' ', 'g'), '\s+'), lambda w: w <> ''), lambda w: regexp_matches(w, '[\p{L}\p{N}]')))"
SLOTS = r"len(regexp_extract_all(template, '\[[^\]]+\]'))"


@over(
    TEMPLATES,
    TEMPLATE_SENTS,
    rf""", c AS (SELECT id, template, {ANCHORS} AS a, {SLOTS} AS s, CAST(len(regexp_extract_all(template, '\[(?:NP|VP|CLAUSE|ADJ|ADV)(?:\s+[^\]]+)?\]')) AS DOUBLE) / 1.5 AS r FROM templates)
SELECT id, length(template) >= 20 AND a >= 2 AND s > 0 AND CAST(a AS DOUBLE) / (a + s) < 0.8 AS valid, CASE WHEN length(template) < 20 THEN 0 ELSE a END::BIGINT AS anchors, greatest(1, CAST(round_even(r, 0) AS BIGINT)) AS capacity FROM c""",
)
def anchor_health(rows: DataFrame) -> DataFrame:
    c = F.col("template")
    return rows.select("id", gt.anchor_health(c).alias("h"), gt.capacity(c).alias("capacity")).select("id", "h.valid", "h.anchors", "capacity")


RATIO = f"CASE WHEN len({words_sql('prev')}) = 0 THEN 1.0::DOUBLE ELSE CAST(len({words_sql('text')}) AS DOUBLE) / len({words_sql('prev')}) END"


@query(f"WITH {TURNS}, r AS (SELECT conv_id, turn, {RATIO} AS r FROM turns WHERE prev IS NOT NULL) SELECT conv_id, turn, round(r, 6) AS ratio, CASE WHEN r < 0.5 THEN 'meaning' WHEN r > 2.5 THEN 'structure' ELSE 'pass' END AS gate, CASE WHEN r < 0.5 OR r > 2.0 THEN 'very_different' WHEN r < 0.67 OR r > 1.5 THEN 'moderate' ELSE 'similar' END AS class FROM r")
def length_ratio_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = gt.length_ratio(F.col("text"), F.col("prev"))
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(r, 6).alias("ratio"), gt.length_gate(r).alias("gate"), gt.length_class(r).alias("class"))


FITS = Fixture("fits", "id int, words int, target int, raw int", [(1, 5, 4, None), (2, 7, 4, None), (3, 0, 2, None), (4, 22, 20, None), (5, 30, 20, 18), (6, 15, 20, 16), (7, 12, 20, 16), (8, 9, 0, None), (9, 13, 20, 16), (10, 24, 20, 16)])


@over(
    FITS,
    FIT_TURNS,
    f"SELECT id, CASE WHEN target <= 0 THEN 1.0::DOUBLE WHEN target <= 6 THEN CASE WHEN abs(words - target) <= 2 AND words > 0 THEN 1.0 ELSE 0.0 END WHEN CAST(abs(words - target) AS DOUBLE) / target <= 0.2 OR coalesce(raw > 0 AND words >= raw * 0.8::DOUBLE AND words <= target * 1.2::DOUBLE, false) THEN 1.0 ELSE 0.0 END AS fits FROM fits",
)
def sentence_length_gate(rows: DataFrame) -> DataFrame:
    return rows.select("id", ms.sentence_fits(F.col("words"), F.col("target"), F.col("raw")).alias("fits"))


@query(
    f"""WITH {SENTS}, p AS (SELECT doc_id, para_idx, CAST(count(*) AS DOUBLE) AS s, avg(CAST(len({tokens_sql("sentence")}) AS DOUBLE)) AS w FROM sents GROUP BY doc_id, para_idx)
SELECT doc_id, para_idx, round((CASE WHEN abs(w - 20.0) / 20.0 > 0.2 THEN 0.0 ELSE 1.0 - abs(w - 20.0) / 20.0 / 0.2 END + CASE WHEN abs(s - 4.0) / 4.0 > 0.2 THEN 0.0 ELSE 1.0 - abs(s - 4.0) / 4.0 / 0.2 END) / 2.0, 6) AS compliance FROM p"""
)
def compliance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs against an archetype of four sentences of twenty words, each from its own array."""
    rows = tx.paragraph_rows(table(spark, sf_dir, "documents")).withColumn("s", tx.sentences(F.col("paragraph")))
    n = F.size("s").cast("double")
    mean = F.aggregate(F.transform("s", lambda x: F.size(tx.tokens(x))), F.lit(0), lambda a, b: a + b) / n
    return rows.select("doc_id", "para_idx", F.round(ms.compliance(mean, n, F.lit(20.0), F.lit(4.0)), 6).alias("compliance"))


@query(
    f"""WITH {SENTS}, p AS (SELECT source, doc_id, para_idx, CAST(count(*) AS DOUBLE) AS s, avg(CAST(len({tokens_sql("sentence")}) AS DOUBLE)) AS w FROM sents GROUP BY source, doc_id, para_idx),
c AS (SELECT source, doc_id, para_idx, round((CASE WHEN abs(w - 20.0) / 20.0 > 0.2 THEN 0.0 ELSE 1.0 - abs(w - 20.0) / 20.0 / 0.2 END + CASE WHEN abs(s - 4.0) / 4.0 > 0.2 THEN 0.0 ELSE 1.0 - abs(s - 4.0) / 4.0 / 0.2 END) / 2.0, 6) AS compliance FROM p)
SELECT source, doc_id, para_idx, compliance FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY compliance DESC, doc_id, para_idx) AS r FROM c) WHERE r = 1"""
)
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraph of each author that complies best, the first of equals: one max per group, no sort."""
    rows = compliance_score(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    best = rows.groupBy("source").agg(F.max(F.struct("compliance", (-F.col("doc_id")).alias("d"), (-F.col("para_idx")).alias("p"))).alias("b"))
    return best.select("source", (-F.col("b.d")).alias("doc_id"), (-F.col("b.p")).alias("para_idx"), F.col("b.compliance").alias("compliance"))


METRICS = Fixture("metrics", "id int, accuracy double, fluency double, style double, thesis_alignment double, intent_compliance double, keyword_coverage double", [(1, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4), (2, 0.9, None, None, 0.6, None, None), (3, None, None, None, None, None, None), (4, None, None, None, None, None, 0.4), (5, 1.0, 1.0, None, None, 0.2, 0.0)])
TOTAL = " + ".join(f"CASE WHEN {k} IS NOT NULL THEN {w} ELSE 0.0 END" for k, w in lx.WEIGHTS.items())


@over(
    METRICS,
    METRIC_DOCS,
    f""", m AS (SELECT id, CAST({TOTAL} AS DOUBLE) AS t, {" + ".join(f"coalesce({k}, 0.0) * {w}" for k, w in lx.WEIGHTS.items())} AS s, {" + ".join(f"coalesce({k}, 0.0)" for k in lx.WEIGHTS)} AS p, {" + ".join(f"({k} IS NOT NULL)::INT" for k in lx.WEIGHTS)} AS n FROM metrics)
SELECT id, round(CASE WHEN n = 0 THEN 0.5::DOUBLE WHEN t = 0 THEN p / n ELSE greatest(0.0, least(1.0, s / t)) END, 6) AS composite FROM m""",
)
def composite_score(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.round(ms.composite({k: F.col(k) for k in lx.WEIGHTS}), 6).alias("composite"))
