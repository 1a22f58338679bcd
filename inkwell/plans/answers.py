"""Queries of model answers, verdicts and plans, on small cases that reach every branch, and of document meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..complete import Retry, Stub, answered, instruction
from ..functions import compare as cp
from ..functions import feedback as fb
from ..functions import gates as gt
from ..functions import lexicon as lx
from ..functions import rewrite as rw
from ..functions import text as tx
from ..functions.fixture import Fixture
from .made import ANSWER_DOCS, DRAFT_TURNS, SENTS_OF, SLOT_SENTS, TURN_LISTS, VERDICT_TURNS
from .pairs import clean_sql
from .registry import PARAS, SENTS, any_sql, list_sql, over, query, table, tokens_sql, words_sql
from .texts import sents

ANSWERS = Fixture("answers", "id int, text string", [(1, 'Sure! ```json\n{"a": 1}\n``` done'), (2, "plan: {'a': True, 'b': None,}"), (3, "no object here"), (4, 'list ["x", "", "y z"] end'), (5, "{broken: [}")])


FOUND = r"regexp_extract(regexp_replace(text, '```(?:json)?', '', 'g'), '(?s)(\{.*\}|\[.*\])', 1)"
REPAIRED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(f, '\bTrue\b', 'true', 'g'), '\bFalse\b', 'false', 'g'), '\bNone\b', 'null', 'g'), ',\s*([}\]])', '\1', 'g'), '''([^'']*)''', '"\1"', 'g')"""


@over(
    ANSWERS,
    ANSWER_DOCS,
    rf""", f AS (SELECT id, {FOUND} AS f, regexp_extract(text, '(?s)(\[.*?\])', 1) AS l FROM answers)
SELECT id, CASE WHEN f = '' THEN NULL WHEN json_valid(f) THEN f WHEN json_valid({REPAIRED}) THEN {REPAIRED} END AS json, CASE WHEN json_valid(l) THEN list_filter(CAST(json_transform(l, '["VARCHAR"]') AS VARCHAR[]), lambda x: trim(x) <> '') ELSE [] END AS items FROM f""",
)
def json_extraction(rows: DataFrame) -> DataFrame:
    c = F.col("text")
    return rows.select("id", fb.json_text(c).alias("json"), fb.json_list(c).alias("items"))


VERDICTS = Fixture(
    "verdicts",
    "id int, verdict string, generated string",
    [
        (1, "1. Remove 'River'.\n2) Fix the end.", "the river ran on"),
        (2, "Missing 'old stone bridge'. Rewrite the entire text.", "An old bridge of stone stood."),
        (3, "The word 'the' is missing.", "River ran."),
        (4, "Fine", "River ran."),
        (5, "Replace 'Delft' now.", "We saw Delft."),
    ],
)
Q = "regexp_extract_all(verdict, '''([^'']+)''', 1)"
SENT = r"list_filter(list_transform(string_split(regexp_replace(verdict, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
NUM = r"list_transform(regexp_extract_all(verdict, '(?m)^\s*\d+[.)]\s*(.+)$', 1), lambda x: trim(x))"


@over(
    VERDICTS,
    VERDICT_TURNS,
    f"""SELECT id, CASE WHEN len({NUM}) > 0 THEN {NUM} ELSE {SENT} END AS issues, {any_sql("lower(verdict)", fb.EDITS)} AND NOT {any_sql("lower(verdict)", fb.REWRITES)} AS edits_only,
 len({Q}) > 0 AND len(list_filter({Q}, lambda w: NOT (contains(generated, lower(w)) AND NOT contains(generated, w)))) = 0 AS false_alarm,
 len(list_filter({Q}, lambda p: contains(lower(generated), lower(p)) OR CAST(len(list_filter({tokens_sql("p")}, lambda w: list_contains({tokens_sql("generated")}, w))) AS DOUBLE) / greatest(len({tokens_sql("p")}), 1) >= 0.8)) > 0 AS false_omission,
 len({Q}) > 0 AND len(list_filter({Q}, lambda w: NOT list_contains({list_sql(lx.STOPS)}, lower(w)))) = 0 AS minor_omission FROM verdicts""",
)
def verdict_checks(rows: DataFrame) -> DataFrame:
    v, g = F.col("verdict"), F.col("generated")
    return rows.select("id", fb.issues(v).alias("issues"), fb.edits_only(v).alias("edits_only"), fb.false_alarm(v, g).alias("false_alarm"), fb.false_omission(v, g).alias("false_omission"), fb.minor_omission(v).alias("minor_omission"))


@over(VERDICTS, VERDICT_TURNS, f", i AS (SELECT unnest(CASE WHEN len({NUM}) > 0 THEN {NUM} ELSE {SENT} END) AS issue FROM verdicts) SELECT issue, count(*) AS n FROM i GROUP BY issue")
def consolidated_feedback(rows: DataFrame) -> DataFrame:
    """Issues over all verdicts by how often they are raised."""
    return rows.select(F.explode(fb.issues(F.col("verdict"))).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


DRAFTS = Fixture("drafts", "id int, recall double, prec double, fluency double, overall double, source_words int, words int", [(1, 1.0, 0.9, 0.9, 0.5, 20, 18), (2, 0.5, 0.9, 0.9, 0.5, 20, 18), (3, 0.9, 0.9, 0.5, 0.95, 20, 18), (4, 1.0, 0.9, None, 0.5, 20, 4), (5, 1.0, 0.2, 0.9, 0.9, 20, 30), (6, 0.85, 0.9, 0.9, 0.92, 20, 30)])


@over(
    DRAFTS,
    DRAFT_TURNS,
    f"""SELECT id, CASE WHEN words < 0.5 * source_words THEN 'too_short' WHEN coalesce(fluency, 1.0) < 0.7 THEN 'not_fluent' WHEN recall < 1.0 AND overall < 0.9 THEN 'low_score' WHEN prec >= 0.8 THEN 'accepted' ELSE 'imprecise' END AS verdict,
 CASE WHEN recall < 0.8 THEN 'semantic_injection' WHEN fluency < 0.7 THEN 'grammar_repair' ELSE 'style_polish' END AS next_step, CASE WHEN words <= 2 THEN 2 WHEN words <= 4 THEN 4 WHEN words <= 7 THEN 6 ELSE 10 END AS bucket FROM drafts""",
)
def acceptance(rows: DataFrame) -> DataFrame:
    d = rows
    return d.select("id", gt.accepted(d.recall, d.prec, d.fluency, d.overall, d.source_words, d.words).alias("verdict"), fb.diagnosis(d.recall, d.fluency).alias("next_step"), fb.bucket(d.words).alias("bucket"))


@query(
    f"""WITH {SENTS}, k AS (SELECT CASE WHEN contains(sentence, ';') THEN 'semicolon' WHEN contains(sentence, ':') THEN 'colon' WHEN regexp_matches(lower(sentence), ', (and|but|or|nor|yet|so) ') THEN 'conjunction' WHEN regexp_matches(lower(sentence), '[ ,](which|who|whom|whose|that) ') THEN 'relative' ELSE 'none' END AS split_point FROM sents)
SELECT split_point, count(*) AS n FROM k GROUP BY split_point"""
)
def split_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sents(spark, sf_dir).select(fb.split_point(F.col("sentence")).alias("split_point")).groupBy("split_point").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(floor(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fb.token_estimate(F.col("text")).alias("tokens"))


SLOTS = Fixture("slots", "para_id int, pos int, target_len int, type string, similarity double", [(1, 1, 15, "moderate", 0.9), (1, 2, 25, "complex", 0.1), (1, 3, 8, "simple", 0.5), (1, 4, 9, "simple", 0.2), (2, 1, 20, "moderate", 0.1)])


@over(
    SLOTS,
    SLOT_SENTS,
    """SELECT para_id, string_agg('Slot ' || pos || ': ' || target_len || ' words (' || type || ')', chr(10) ORDER BY pos) AS rendered, CAST(coalesce(max(pos) FILTER (similarity >= 0.25), 0) AS INTEGER) AS kept FROM slots GROUP BY para_id""",
)
def slot_plans(rows: DataFrame) -> DataFrame:
    """Slots as text, and how many stay once trailing ones without support are dropped."""
    rows = rows.groupBy("para_id").agg(F.array_sort(F.collect_list(F.struct("pos", "target_len", "type", "similarity"))).alias("s"))
    return rows.select("para_id", fb.slots_text(F.col("s")).alias("rendered"), fb.without_tail(F.col("s.similarity")).alias("kept"))


@query(
    r"""WITH p AS (SELECT item_id, list_filter(string_split(text, '. '), lambda x: trim(x) <> '') AS p FROM benchmark), e AS (SELECT item_id, p, greatest(1, len(p) // 3) AS e FROM p)
SELECT item_id, [array_to_string(p[1:e], '. '), array_to_string(p[e + 1:2 * e], '. '), array_to_string(p[2 * e + 1:], '. ')] AS slots FROM e"""
)
def fallback_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text's facts over three slots."""
    parts = F.filter(F.split("text", r"\. "), lambda x: F.trim(x) != "")
    return table(spark, sf_dir, "benchmark").select("item_id", fb.dealt(parts, 3).alias("slots"))


@query(f"WITH {TURN_LISTS.cte()} SELECT id, list_transform(after, lambda x, i: coalesce(before[i], before[-1]) || ' <- ' || x) AS pairs, flatten(list_transform(range(1, 6), lambda i: before))[1:5] AS padded FROM turn_lists WHERE len(before) > 0")
def window_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn's sentences with those of the turn before as skeletons, and these repeated up to five."""
    rows = TURN_LISTS.df(spark, sf_dir).where(F.size("before") > 0)
    return rows.select("id", fb.zipped(F.col("before"), F.col("after")).alias("pairs"), fb.cycled(F.col("before"), 5).alias("padded"))


@query(
    f"""WITH {SENTS}, t AS (SELECT doc_id, para_idx, sent_idx, list_sort(list_distinct(list_filter({tokens_sql("sentence")}, lambda w: NOT list_contains({list_sql(lx.STOPS)}, w) AND length(w) > 2))) AS words, max(para_idx) OVER (PARTITION BY doc_id) AS lp, max(sent_idx) OVER (PARTITION BY doc_id, para_idx) AS ls FROM sents)
SELECT doc_id, para_idx, sent_idx, words, sent_idx = 0 AS opens_paragraph, sent_idx = ls AS closes_paragraph, para_idx = 0 AND sent_idx = 0 AS opens_document, para_idx = lp AND sent_idx = ls AS closes_document FROM t"""
)
def content_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence with its content words and its place, all from the document's own nested array."""
    docs = table(spark, sf_dir, "documents").withColumn("p", tx.paragraphs(F.col("text")))
    paras = docs.select("doc_id", F.size("p").alias("np"), F.posexplode("p").alias("para_idx", "paragraph")).withColumn("s", tx.sentences(F.col("paragraph")))
    each = paras.select("doc_id", "np", "para_idx", F.size("s").alias("ns"), F.posexplode("s").alias("sent_idx", "sentence"))
    first, last = F.col("sent_idx") == 0, F.col("sent_idx") == F.col("ns") - 1
    return each.select("doc_id", "para_idx", "sent_idx", cp.content(F.col("sentence")).alias("words"), first.alias("opens_paragraph"), last.alias("closes_paragraph"), ((F.col("para_idx") == 0) & first).alias("opens_document"), ((F.col("para_idx") == F.col("np") - 1) & last).alias("closes_document"))


AUTHORS = ["Anna Bell", "Carl Dent", "Annabel"]


NAMES_SQL = list_sql(sorted(AUTHORS))


@query(
    f"""WITH a AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'anna bell' WHEN 1 THEN 'anna' WHEN 2 THEN source ELSE 'CARL DENT' END AS asked FROM documents), e AS (SELECT *, list_filter({NAMES_SQL}, lambda n: lower(n) = lower(asked)) AS e,
 list_filter({NAMES_SQL}, lambda n: contains(lower(n), lower(asked)) OR contains(lower(asked), lower(n)))[1:3] AS l FROM a) SELECT doc_id, asked, len(e) > 0 AS known, CASE WHEN len(e) > 0 THEN e WHEN len(l) > 0 THEN l ELSE {NAMES_SQL} END AS suggestions FROM e"""
)
def author_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an author is known, and names that contain the asked one or are contained in it, else all."""
    names = F.array_sort(F.array(*map(F.lit, AUTHORS)))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr("CASE doc_id % 4 WHEN 0 THEN 'anna bell' WHEN 1 THEN 'anna' WHEN 2 THEN source ELSE 'CARL DENT' END").alias("asked"))
    low = F.lower("asked")
    exact = F.filter(names, lambda n: F.lower(n) == low)
    like = F.slice(F.filter(names, lambda n: F.lower(n).contains(low) | low.contains(F.lower(n))), 1, 3)
    return rows.select("doc_id", "asked", (F.size(exact) > 0).alias("known"), F.when(F.size(exact) > 0, exact).when(F.size(like) > 0, like).otherwise(names).alias("suggestions"))


@query(
    f"""WITH v AS (SELECT conv_id, turn, len({words_sql("text")}) AS n, text FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, abs(n - 60) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY abs(n - 60), turn) AS r FROM v WHERE n >= 3) WHERE r = 1"""
)
def variant_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation's answers of three words or more, the one nearest sixty words, the first of equals."""
    n = tx.count(tx.words(F.col("text")))
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", n.alias("n")).where("n >= 3")
    best = rows.groupBy("conv_id").agg(F.min(F.struct(F.abs(F.col("n") - 60).alias("gap"), "turn")).alias("b"))
    return best.select("conv_id", "b.turn", "b.gap")


KEPT_PLAN = "list_filter([{'a': 'merge_with_next', 'i': 1}, {'a': 'delete', 'i': 2}, {'a': 'merge_with_next', 'i': 4}, {'a': 'delete', 'i': 3}], lambda p: (doc_id + p.i) % 3 > 0)"


@query(
    f"""WITH {PARAS}, s AS (SELECT doc_id, para_idx, {SENTS_OF.format(x="paragraph")} AS s, {KEPT_PLAN} AS p FROM paras)
SELECT doc_id, para_idx, list_reduce(list_concat([s], list_transform(p, lambda x: [x.a, x.i::VARCHAR])), lambda a, x: CASE WHEN x[2]::INT > len(a) THEN a WHEN x[1] = 'delete' THEN list_concat(a[1:x[2]::INT - 1], a[x[2]::INT + 1:])
 WHEN x[2]::INT < len(a) THEN list_concat(a[1:x[2]::INT - 1], list_concat([a[x[2]::INT] || ' ' || a[x[2]::INT + 1]], a[x[2]::INT + 2:])) ELSE a END) AS sentences FROM s"""
)
def repair_plan_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each paragraph's sentences after a plan's merges and deletions (1-based, in order)."""
    steps = F.array(*(F.struct(F.lit(a).alias("action"), F.lit(i).alias("at")) for a, i in (("merge_with_next", 1), ("delete", 2), ("merge_with_next", 4), ("delete", 3))))
    rows = tx.paragraph_rows(table(spark, sf_dir, "documents"))
    plan = F.filter(steps, lambda p: (F.col("doc_id") + p["at"]) % 3 > 0)
    return rows.select("doc_id", "para_idx", fb.repaired(tx.sentences(F.col("paragraph")), plan).alias("sentences"))


FIRST_TWO = r"array_to_string(list_filter(string_split(regexp_replace(regexp_replace(paragraph, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: true)[1:2], ' ')"
LEADS = "coalesce(least(len(a), len(b)) >= 3 AND CAST(len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i])) AS DOUBLE) / least(len(a), len(b)) >= 0.8, false)"


@query(
    f"""WITH {PARAS}, answered AS (SELECT doc_id, para_idx, paragraph, {FIRST_TWO} AS response FROM paras), {clean_sql("response", "answered", "doc_id, para_idx, paragraph")},
n AS (SELECT doc_id, para_idx, cleaned AS text, CASE WHEN len({words_sql("paragraph")}) = 0 THEN 1.0::DOUBLE ELSE CAST(len({words_sql("cleaned")}) AS DOUBLE) / len({words_sql("paragraph")}) END AS r, {words_sql("lower(cleaned)")}[1:5] AS a, {words_sql("lower(coalesce(lag(cleaned) OVER (PARTITION BY doc_id ORDER BY para_idx), ''))")}[1:5] AS b FROM cleaned)
SELECT doc_id, para_idx, text, CASE WHEN r < 0.5 THEN 'meaning' WHEN r > 2.5 THEN 'structure' ELSE 'pass' END AS gate, CASE WHEN {LEADS} THEN 0.5::DOUBLE ELSE 0.0 END AS penalty FROM n"""
)
def restyle_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document rewritten paragraph by paragraph: prompt, answer, cleaning, length gate, repetition against the paragraph before."""
    rows = tx.paragraph_rows(table(spark, sf_dir, "documents")).select("doc_id", "para_idx", F.lit(instruction("polish", style="plain")).alias("system"), F.col("paragraph").alias("user"))
    done = answered(rows, lambda: Retry(Stub())).withColumn("text", rw.clean_generated(F.col("response")))
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("para_idx"))
    return done.select("doc_id", "para_idx", "text", gt.length_gate(gt.length_ratio(F.col("text"), F.col("user"))).alias("gate"), cp.repetition_penalty(F.col("text"), F.coalesce(before, F.lit(""))).alias("penalty"))