"""Templates from the nearest contexts of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context as ct
from .choices import MOOD
from .made import tag_sql
from .registry import SENTS, list_sql, query, table, tokens_sql, words_sql
from .rules import SYNTAX

N = f"len({words_sql('sentence')})"
CONTEXTS = f"""{SENTS}, sized AS (SELECT doc_id, para_idx, count(*) OVER (PARTITION BY doc_id) AS n FROM paras),
ctx AS (SELECT s.doc_id, s.para_idx, s.sent_idx, s.sentence, CASE WHEN s.para_idx = 0 THEN 'first' WHEN s.para_idx = p.n - 1 THEN 'last' ELSE 'middle' END AS para_pos,
 CASE WHEN sent_idx = 0 THEN 'first' WHEN sent_idx = count(*) OVER (PARTITION BY s.doc_id, s.para_idx) - 1 THEN 'last' ELSE 'middle' END AS sent_pos,
 coalesce(lag({SYNTAX.replace("text", "sentence")}) OVER (PARTITION BY s.doc_id, s.para_idx ORDER BY sent_idx), 'Simple') AS previous_type, {MOOD} AS sentiment,
 CASE WHEN {N} < 10 THEN 'short' WHEN {N} < 20 THEN 'medium' ELSE 'long' END AS length, CAST({N} AS INTEGER) AS target, list_transform({tokens_sql("sentence")}, lambda w: {tag_sql("w")}) AS tags FROM sents AS s JOIN sized AS p ON p.doc_id = s.doc_id AND p.para_idx = s.para_idx)"""
APART = " + ".join(f"CASE WHEN c.{f} <> x.{f} THEN 1 ELSE 0 END" for f in ct.FIELDS)
FIELDS = ", ".join(ct.FIELDS)


def fill_sql(n: str) -> str:
    return f"list_transform(range({n}), lambda i: {list_sql(ct.FILL)}[i % {len(ct.FILL)} + 1])"


@query(
    f"""WITH {CONTEXTS}, cells AS (SELECT DISTINCT {FIELDS} FROM ctx),
ranked AS (SELECT {", ".join("c." + f for f in ct.FIELDS)}, x.doc_id, x.para_idx, x.sent_idx, x.tags, {APART} AS distance FROM cells AS c, ctx AS x QUALIFY row_number() OVER (PARTITION BY {", ".join("c." + f for f in ct.FIELDS)} ORDER BY {APART}, x.doc_id, x.para_idx, x.sent_idx) <= {ct.NEAREST + 1}),
met AS (SELECT t.doc_id, t.para_idx, t.sent_idx, t.target, r.tags, r.distance, r.doc_id AS d, r.para_idx AS p, r.sent_idx AS s FROM ctx AS t JOIN ranked AS r USING ({FIELDS}) WHERE (r.doc_id, r.para_idx, r.sent_idx) <> (t.doc_id, t.para_idx, t.sent_idx)
 QUALIFY row_number() OVER (PARTITION BY t.doc_id, t.para_idx, t.sent_idx ORDER BY r.distance, r.doc_id, r.para_idx, r.sent_idx) <= {ct.NEAREST}),
g AS (SELECT doc_id, para_idx, sent_idx, any_value(target) AS target, string_agg(d || '-' || p || '-' || s, ',' ORDER BY distance, d, p, s) AS nearest, CAST(sum(distance) AS INTEGER) AS distance, list_filter(list(tags ORDER BY distance, d, p, s), lambda t: len(t) > 0) AS x FROM met GROUP BY ALL),
h AS (SELECT *, CAST(floor(CAST(list_sum(list_transform(x, lambda t: len(t))) AS DOUBLE) / len(x)) AS INTEGER) AS mean FROM g),
j AS (SELECT *, CASE WHEN abs(target - mean) <= {ct.CLOSE} THEN target ELSE mean END AS n FROM h),
pos AS (SELECT doc_id, para_idx, sent_idx, i, x[k][i + 1] AS tag, k FROM (SELECT doc_id, para_idx, sent_idx, x, i, unnest(range(1, len(x) + 1)) AS k FROM (SELECT doc_id, para_idx, sent_idx, x, unnest(range(least(n, target))) AS i FROM j WHERE len(x) > 0)) WHERE i < len(x[k])),
top AS (SELECT doc_id, para_idx, sent_idx, i, tag FROM pos GROUP BY doc_id, para_idx, sent_idx, i, tag QUALIFY row_number() OVER (PARTITION BY doc_id, para_idx, sent_idx, i ORDER BY count(*) DESC, min(k)) = 1),
tops AS (SELECT doc_id, para_idx, sent_idx, map(list(i), list(tag)) AS m FROM top GROUP BY ALL),
out AS (SELECT j.*, CASE WHEN len(x) = 0 THEN {fill_sql("target")} ELSE list_concat(list_transform(range(least(n, target)), lambda i: coalesce(m[i], {list_sql(ct.OPENING)}[least(i, {len(ct.OPENING) - 1}) + 1])), {fill_sql("greatest(target - n, 0)")}) END AS t FROM j LEFT JOIN tops USING (doc_id, para_idx, sent_idx))
SELECT doc_id, para_idx, sent_idx, nearest, distance, array_to_string(t, ' ') AS template FROM out"""
)
def select_template_statistical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template that the five nearest contexts of all documents make for every sentence, found by cell."""
    rows = ct.contexts(table(spark, sf_dir, "documents"))
    out = ct.statistical_templates(rows, rows)
    shown = F.array_join(F.transform("nearest", lambda x: F.concat_ws("-", x["doc_id"].cast("string"), x["para_idx"].cast("string"), x["sent_idx"].cast("string"))), ",")
    return out.select(*ct.ID, shown.alias("nearest"), F.aggregate("distances", F.lit(0), lambda a, d: a + d).alias("distance"), F.array_join("template", " ").alias("template"))
