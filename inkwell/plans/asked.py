"""Queries that ask a generator: each family of answers read back, and prompts assembled from sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..complete import Scripted, answered
from ..functions import asking as ak
from ..functions import lexicon as lx
from ..functions import text as tx
from .made import SENTS_OF
from .pairs import clean_sql
from .registry import PARAS, list_sql, query, table, tokens_sql, words_sql

VALUES = {"perspective": "third person", "n": 3, "words": 12, "author": "the author", "instruction": "shorten it", "feedback": "shorter", "type": "simple", "operator": "polish", "style": "plain", "template": "[NP] [VP]"}


def asked(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Every benchmark text with the offline answer to one operator."""
    task = ak.operator(name)
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.lit(ak.told(name, **VALUES)).alias("system"), F.col("text").alias("user"))
    return answered(rows, lambda: Scripted(task.reads)).withColumn("read", task.read(F.col("response"), F.col("user")))


#: The parts of a text as the offline answers see them.
P = r"string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
B = f"b AS (SELECT item_id, text, length(text) AS n, {P} AS p, {SENTS_OF.format(x='text')} AS s FROM benchmark)"


@query(f"WITH {B}, told AS (SELECT item_id, text, CASE WHEN n % 5 = 0 THEN '' ELSE 'Sure.' || chr(10) || 'REWRITE: ' || p[1] END AS response FROM b), {clean_sql('response', 'told', 'item_id, text')} SELECT item_id, coalesce(nullif(cleaned, ''), text) AS text FROM cleaned")
def ask_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rewriting operator's answer, cleaned; the draft where there is none."""
    return asked(spark, sf_dir, "translate").select("item_id", F.col("read").alias("text"))


@query(f"WITH {B}, v AS (SELECT item_id, text, n, list_filter(list_transform(p[1:3], lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: len({words_sql('x')}) >= 3) AS v FROM b) SELECT item_id, CASE WHEN n % 5 = 0 OR len(v) = 0 THEN [text] ELSE v END AS variants FROM v")
def ask_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of a sentence, one a line."""
    return asked(spark, sf_dir, "sentence_variants").select("item_id", F.col("read").alias("variants"))


@query(f"WITH {B} SELECT item_id, CASE WHEN n < 50 THEN 1.0::DOUBLE WHEN n % 5 = 0 THEN 3.0 ELSE greatest(1, least(5, n % 9)) END AS score FROM b")
def ask_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paragraph's audit: a score within bounds, three where the answer has none."""
    return asked(spark, sf_dir, "audit_paragraph").select("item_id", F.col("read").alias("score"))


@query(f"WITH {B} SELECT item_id, CASE WHEN n % 5 = 0 THEN true ELSE n % 2 = 1 END AS ok, CASE WHEN n % 5 = 0 THEN 0.5::DOUBLE ELSE CAST(n % 9 AS DOUBLE) / 10 END AS confidence FROM b")
def ask_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict and its confidence; what cannot be read passes at a half."""
    return asked(spark, sf_dir, "entailment").select("item_id", "read.ok", F.round("read.confidence", 6).alias("confidence"))


@query(f"WITH {B} SELECT item_id, CASE n % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'A' END AS choice FROM b")
def ask_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judge's letter; none where it refuses, the first where it names none."""
    return asked(spark, sf_dir, "rank_candidates").select("item_id", F.col("read").alias("choice"))


@query(f"WITH {B} SELECT item_id, CASE WHEN n % 5 = 0 THEN [] ELSE list_concat(CASE WHEN n % 4 >= 1 AND n % 4 <= len(s) THEN ['delete:' || n % 4] ELSE [] END, CASE WHEN len(s) >= 1 THEN ['split:1'] ELSE [] END) END AS steps FROM b")
def ask_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repair plan's sound steps."""
    return asked(spark, sf_dir, "repair_plan").select("item_id", F.transform("read", lambda x: F.concat_ws(":", x["action"], x["at"].cast("string"))).alias("steps"))


@query(f"WITH {B} SELECT item_id, list_transform(s, lambda x, i: CASE WHEN n % 5 > 0 AND i = 1 THEN 'OPEN' WHEN n % 5 > 0 AND i = 2 THEN 'TURN' ELSE 'BODY' END) AS roles FROM b")
def ask_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence's part in the paragraph."""
    return asked(spark, sf_dir, "narrative_arc").select("item_id", F.col("read").alias("roles"))


@query(
    f"""WITH {B}, f AS (SELECT *, list_filter(string_split(text, '. '), lambda x: trim(x) <> '') AS f, list_filter(list_transform(string_split(array_to_string(p[1:1 + n % 4], chr(10)), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM b), e AS (SELECT *, greatest(1, len(f) // 3) AS e FROM f)
SELECT item_id, CASE WHEN n % 5 > 0 AND len(l) > 0 THEN [coalesce(l[1], 'EMPTY'), coalesce(l[2], 'EMPTY'), coalesce(l[3], 'EMPTY')] ELSE [array_to_string(f[1:e], '. '), array_to_string(f[e + 1:2 * e], '. '), array_to_string(f[2 * e + 1:], '. ')] END AS slots FROM e"""
)
def ask_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts over three slots."""
    return asked(spark, sf_dir, "plan_content").select("item_id", F.col("read").alias("slots"))


USED = ["the", "of", "and", "vast"]
COUNTS = ", ".join(f"CAST(sum(len(list_filter({tokens_sql('text')}, lambda w: w = '{w}'))) AS BIGINT) AS n_{w}" for w in USED)
BUDGET = "CASE WHEN len(f) + len(w) > 0 THEN '## Vocabulary' || chr(10) || array_to_string(list_filter([CASE WHEN len(f) > 0 THEN 'Forbidden: ' || array_to_string(list_sort(f), ', ') END, CASE WHEN len(w) > 0 THEN 'Use with care: ' || array_to_string(list_sort(w), ', ') END], lambda x: x IS NOT NULL), chr(10)) END"


@query(
    f"""WITH c AS (SELECT source, {COUNTS}, CAST(count(*) AS BIGINT) AS documents FROM documents GROUP BY source), l AS (SELECT *, list_filter([{", ".join(f"CASE WHEN n_{w} >= 200 THEN '{w}' END" for w in USED)}], lambda x: x IS NOT NULL) AS f, list_filter([{", ".join(f"CASE WHEN n_{w} BETWEEN 1 AND 199 THEN '{w}' END" for w in USED)}], lambda x: x IS NOT NULL) AS w FROM c)
SELECT source, concat_ws(chr(10) || chr(10), 'You write as ' || source || '.', {BUDGET}) AS system, '## Constraints' || chr(10) || '- documents: ' || documents || chr(10) || '- the: ' || n_the AS constraints, '## Manner' || chr(10) || source || ' (70%) and plain (30%)' AS manner,
 list_sort(list_distinct(list_filter({tokens_sql("source")}, lambda w: length(w) > 2))) AS blocked FROM l"""
)
def author_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each author's system message with its word budget, constraints, blended manner and blocked words."""
    t = tx.tokens(F.col("text"))
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(*(F.sum(tx.among(t, [w])).alias(f"n_{w}") for w in USED), F.count("*").alias("documents"))
    pick = lambda test: F.array_compact(F.array(*(F.when(test(F.col(f"n_{w}")), F.lit(w)) for w in USED)))
    budget = ak.budget_section(pick(lambda n: n >= 200), pick(lambda n: n.between(1, 199)))
    return rows.select(
        "source", ak.persona(F.col("source"), budget).alias("system"), ak.style_constraints({"documents": F.col("documents"), "the": F.col("n_the")}).alias("constraints"), ak.blend(F.col("source"), F.lit("plain"), 0.7).alias("manner"), ak.blocked_names(F.col("source")).alias("blocked")
    )


@query(
    f"""WITH t AS (SELECT item_id, text, list_sort(list_distinct(list_filter({tokens_sql("text")}, lambda w: list_contains({list_sql([*lx.COORDINATORS, *lx.SUBORDINATORS])}, w)))) AS w FROM benchmark)
SELECT item_id, concat_ws(chr(10) || chr(10), '## Example' || chr(10) || 'A sentence.', '## Structure' || chr(10) || '[NP] [VP].', CASE WHEN len(w) > 0 THEN '## Words' || chr(10) || array_to_string(w, ', ') END, CASE WHEN text <> '' THEN '## Text' || chr(10) || text END, 'Follow the structure exactly.') AS strict,
 concat_ws(chr(10) || chr(10), '## Example' || chr(10) || 'A sentence.', CASE WHEN len(w) > 0 THEN '## Words' || chr(10) || array_to_string(w, ', ') END, CASE WHEN text <> '' THEN '## Text' || chr(10) || text END, 'Keep the meaning; any structure will do.') AS safety FROM t"""
)
def generation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few-shot prompts of the strictest and the loosest mode."""
    words = F.array_sort(F.array_distinct(F.filter(tx.tokens(F.col("text")), lambda w: w.isin([*lx.COORDINATORS, *lx.SUBORDINATORS]))))
    prompt = lambda mode: ak.generation_prompt(F.col("text"), F.lit("A sentence."), F.lit("[NP] [VP]."), words, mode)
    return table(spark, sf_dir, "benchmark").select("item_id", prompt("STRICT").alias("strict"), prompt("SAFETY").alias("safety"))


@query(
    f"""WITH {PARAS}, d AS (SELECT doc_id, string_agg('## P' || para_idx % 3 || chr(10) || paragraph, chr(10) ORDER BY para_idx) AS t FROM paras WHERE NOT contains(paragraph, '## ') GROUP BY doc_id), l AS (SELECT doc_id, para_idx % 3 AS k, max_by(paragraph, para_idx) AS body FROM paras WHERE NOT contains(paragraph, '## ') GROUP BY doc_id, para_idx % 3)
SELECT doc_id, 'P' || k AS name, body FROM l"""
)
def titled_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of `## NAME` sections (here made of paragraphs) read as a map; of equal names the last counts."""
    rows = tx.paragraph_rows(table(spark, sf_dir, "documents")).where(~F.col("paragraph").contains("## "))
    parts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("para_idx", "paragraph"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat(F.lit("## P"), (x["para_idx"] % 3).cast("string"), F.lit("\n"), x["paragraph"])), "\n")
    return parts.select("doc_id", F.explode_outer(ak.sections(text)).alias("name", "body")).where("name IS NOT NULL")
