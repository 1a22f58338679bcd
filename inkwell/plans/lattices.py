"""Tags of words in context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clauses as cs
from ..functions import text as tx
from ..operators import lattice as la
from ..sources.shared import kept
from .registry import query, table, tokens_sql


def _weights_sql(rows: dict[str, list[int]]) -> str:
    return ", ".join(f"('{k}', {list(v)})" for k, v in rows.items())


MODEL = la.first_model()
N = len(la.TAGS)
NAMES = "[" + ", ".join(f"'{t}'" for t in la.TAGS) + "]"
DIGITS = la.weights({"NUM": 1}, ["NUM"], 0)
FOLLOWS = str(MODEL.follows)


@query(
    f"""WITH RECURSIVE closed(w, e) AS (VALUES {_weights_sql(MODEL.words)}), suffix(s, e) AS (VALUES {_weights_sql(MODEL.suffixes)}),
t AS (SELECT item_id, {tokens_sql("text")} AS t FROM benchmark), tok AS (SELECT item_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM t),
kind AS (SELECT w, arg_max(e, n) AS e FROM (SELECT d.w, length(s.s) AS n, s.e FROM (SELECT DISTINCT w FROM tok) d JOIN suffix s ON ends_with(d.w, s.s)) GROUP BY w),
em AS (SELECT tok.item_id, tok.i, tok.w, CASE WHEN regexp_matches(tok.w, '^[0-9]+$') THEN {DIGITS} ELSE coalesce(closed.e, kind.e) END AS e FROM tok LEFT JOIN closed ON closed.w = tok.w LEFT JOIN kind ON kind.w = tok.w),
v AS (SELECT item_id, i, list_transform(range(1, {N + 1}), lambda k: CAST({FOLLOWS}[{N + 1}][k] + e[k] AS BIGINT)) AS s, list_transform({NAMES}, lambda x: x) AS p FROM em WHERE i = 1
 UNION ALL SELECT item_id, i, list_transform(range(1, {N + 1}), lambda k: CAST(list_max(w[k]) + e[k] AS BIGINT)), list_transform(range(1, {N + 1}), lambda k: p[list_position(w[k], list_max(w[k]))] || ' ' || {NAMES}[k])
 FROM (SELECT em.item_id, em.i, em.e, v.p, list_transform(range(1, {N + 1}), lambda k: list_transform(range(1, {N + 1}), lambda j: v.s[j] + {FOLLOWS}[j][k])) AS w FROM v JOIN em ON em.item_id = v.item_id AND em.i = v.i + 1)),
last AS (SELECT item_id, i, p, list_transform(range(1, {N + 1}), lambda k: s[k] + {MODEL.ends}[k]) AS s FROM v)
SELECT item_id, arg_max(p[list_position(s, list_max(s))], i) AS tags FROM last GROUP BY item_id"""
)
def lattice_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of every benchmark item by the first model, each word in its context."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", tx.tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    return la.tagged(rows, "tokens", MODEL).select("item_id", F.array_join("tags", " ").alias("tags"))


@query()
def lattice_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How tags follow each other in each author's sentences, by a model counted in two rounds over all documents."""
    sents = table(spark, sf_dir, "documents").select("source", F.explode(tx.paragraphs(F.col("text"))).alias("p")).select("source", F.explode(tx.sentences(F.col("p"))).alias("s"))
    rows = kept(sents.select("source", tx.tokens(F.col("s")).alias("tokens")), "sentences")  # three passes read it
    tags = la.tagged(rows, "tokens", la.trained(rows, "tokens")).where(F.size("tags") > 1)
    pairs = F.zip_with(F.slice("tags", F.lit(1), F.size("tags") - 1), F.slice("tags", F.lit(2), F.size("tags")), lambda a, b: F.struct(a.alias("src"), b.alias("tgt")))
    counts = tags.select("source", F.explode(pairs).alias("x")).groupBy("source", "x.src", "x.tgt").agg(F.count("*").alias("n"))
    totals = counts.groupBy(F.col("source").alias("_a"), F.col("src").alias("_s")).agg(F.sum("n").alias("total"))
    both = counts.join(totals, F.col("source").eqNullSafe(F.col("_a")) & (F.col("src") == F.col("_s")))
    return both.select("source", "src", "tgt", "n", F.round(F.col("n") / F.col("total"), 6).alias("p"))


@query()
def clause_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject, verb and object of every clause of every benchmark sentence, tags by context."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(tx.sentences(F.col("text"))).alias("sent_idx", "s")).select("item_id", "sent_idx", tx.tokens(F.col("s")).alias("tokens"))
    tagged = la.tagged(rows, "tokens", MODEL)
    words = F.zip_with("tokens", "tags", lambda w, t: F.struct(w.alias("word"), t.alias("tag")))
    found = tagged.select("item_id", "sent_idx", F.posexplode(cs.clause_triples(words)).alias("clause", "x"))
    return found.select("item_id", "sent_idx", "clause", "x.subject", "x.verb", "x.object")
