"""Queries of critics, candidates, phrases, joins by likeness and range, and paragraph statistics by tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..complete import Retry, Stub
from ..functions import annotate as an
from ..functions import judge as jd
from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.fixture import Fixture, Made
from ..operators import generate as gn
from ..operators import match as mt
from ..operators import measure as ms
from ..operators import metric as me
from .answers import FIRST_TWO
from .made import CITED_TURNS, MET, SENT_CASES, SENT_ID, SENTS_OF, TURN_LISTS, met, para_rows, sent_rows, tag_sql
from .pairs import CITED, bound, clean_sql, content_sql
from .registry import PARAS, SENTS, any_sql, list_sql, over, query, table, tokens_sql, words_sql
from .rules import CASES, COMPLETE, FIRSTS, PARTS
from .stores import E, shapes
from .structures import INVENTED
from .tags import KIND, NAMES, NEAR
from .texts import DIMS, STYLE

T = tokens_sql("text")

# --- clauses and fluency

CLAUSE_CASES = Fixture(
    "clauses",
    "id int, text string",
    [
        (1, "The code, even though it is new."),
        (2, "The code works, even though it is new."),
        (3, "Although the rain fell on."),
        (4, "The bridge, which is old."),
        (5, "Limits, even though they are implied, and so on."),
        (6, "He slept. While the rain fell."),
        (7, "All is well. It rains."),
        (8, ""),
    ],
)
CLAUSE_KIND = "CASE sent_idx % 5 WHEN 1 THEN 'Although ' WHEN 2 THEN 'Stone, whereas ' WHEN 3 THEN 'The stone, which ' ELSE '' END || replace(sentence, ',', '') || CASE sent_idx % 7 WHEN 3 THEN ' Stone, although old. Rest.' ELSE '' END"
CLAUSE_SENTS = Made(
    "clauses",
    f"{SENTS}, clauses AS (SELECT {SENT_ID} AS id, {CLAUSE_KIND} AS text FROM sents)",
    lambda spark, sf_dir: sent_rows(spark, sf_dir).select(F.expr(SENT_ID).alias("id"), F.expr(CLAUSE_KIND).alias("text")),
)
STRIPPED = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
HEAD = STRIPPED.format(x=f"string_split_regex(s, '(?i),\\s+{jd.OPENS}')[1]")
FIRST = STRIPPED.format(x="string_split(s, ',')[1]")
DANGLING = f"""CASE WHEN regexp_matches(s, '{jd.CLOSES}') AND len({words_sql(HEAD)}) < 5 AND NOT {any_sql(f"lower({HEAD})", jd.MAIN_VERBS)} THEN 'clause_end' WHEN regexp_matches(s, '{jd.BEGINS}') THEN 'clause_start' WHEN regexp_matches(s, '{jd.RELATIVE}') THEN 'relative'
 WHEN regexp_matches(s, '{jd.FRAGMENT}') AND len({words_sql("s")}) < 10 AND len({words_sql(FIRST)}) <= 2 AND NOT {any_sql(f"lower({FIRST})", jd.FEW_VERBS)} THEN 'fragment' END"""
CLAUSE_PARTS = rf"list_filter(list_transform(regexp_split_to_array({STRIPPED.format(x='text')}, '[.!?]+\s+'), lambda s: {STRIPPED.format(x='s')}), lambda s: s <> '')"
CLAUSES = f"list_filter(list_transform({CLAUSE_PARTS}, lambda s: {{'kind': {DANGLING}, 'sentence': s}}), lambda x: x.kind IS NOT NULL)"


@over(CLAUSE_CASES, CLAUSE_SENTS, f", f AS (SELECT id, {CLAUSES} AS f FROM clauses) SELECT id, f[1].kind AS kind, f[1].sentence AS sentence FROM f")
def clause_gate(rows: DataFrame) -> DataFrame:
    """The first sentence of a text that lacks its main clause, and what it lacks."""
    return rows.select("id", jd.incomplete_clause(F.col("text")).alias("c")).select("id", "c.kind", "c.sentence")


def fluency_sql(source: str, key: str = "id") -> str:
    """CTEs that end in fluent(key, fluency) from source(key, text)."""
    return rf"""ft AS (SELECT {key}, text, {T} AS t FROM {source}), fk AS (SELECT *, {KIND} AS k FROM ft),
fb AS (SELECT *, CAST(len(list_filter(range(2, len(t) + 1), lambda i: k[i] = 'NOUN' AND NOT ends_with(t[i], 's') AND k[i - 1] = 'VERB')) AS DOUBLE) AS bare, len(list_filter(k, lambda x: x IN ('NOUN', 'PRON'))) > 0 AND len(list_filter(k, lambda x: x IN ('VERB', 'AUX'))) > 0 AS whole,
  1.0::DOUBLE - CASE WHEN regexp_matches(text, '{jd.STILTED}') THEN 0.5::DOUBLE ELSE 0 END - CASE WHEN regexp_matches(text, '{jd.FUTURE_PASSIVE}') THEN 0.15::DOUBLE ELSE 0 END AS b FROM fk),
fluent AS (SELECT {key}, CASE WHEN coalesce({STRIPPED.format(x="text")}, '') = '' THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, b - CASE WHEN NOT whole AND b - 0.3::DOUBLE <= 0.8::DOUBLE THEN 0.3::DOUBLE ELSE 0 END - (CASE WHEN bare > 0 THEN 0.2::DOUBLE ELSE 0 END + 0.1::DOUBLE * bare)
  - CASE WHEN NOT regexp_matches(regexp_replace(text, '\s+$', ''), '[.!?]$') THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN len(t) < 3 THEN 0.2::DOUBLE ELSE 0 END)) END AS fluency FROM fb)"""


@over(CASES, SENT_CASES, f", {fluency_sql('cases')} SELECT id, round(fluency, 6) AS fluency FROM fluent")
def fluency_lex(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.round(jd.fluency(F.col("text")), 6).alias("fluency"))


# --- a text against its source

NAMES_OF = lambda x: NAMES.replace("text", x)


@over(
    CITED,
    CITED_TURNS,
    f""", n AS (SELECT id, list_transform({NAMES_OF("original")}, lambda x: lower(x)) AS a, {NAMES_OF("generated")} AS b, list_sort(list_distinct({INVENTED})) AS words FROM cited), e AS (SELECT id, words, list_filter(b, lambda x: NOT list_contains(a, lower(x))) AS entities FROM n)
SELECT id, round(greatest(least(1.0::DOUBLE, len(entities) * 0.5::DOUBLE), least(1.0::DOUBLE, len(words) * 0.2::DOUBLE)), 6) AS score, entities, words FROM e""",
)
def hallucination_score(rows: DataFrame) -> DataFrame:
    rows = rows.select("id", jd.invention(F.col("original"), F.col("generated")).alias("x"))
    return rows.select("id", F.round("x.score", 6).alias("score"), "x.entities", "x.words")


def triples_sql(w: str) -> str:
    p = f"('#' || {w} || '#')"
    return f"list_distinct(list_transform(range(1, greatest(length({p}) - 2, 1) + 1), lambda i: {p}[i:i + 2]))"


def cosine_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / sqrt(CAST(len({a}) * len({b}) AS DOUBLE)) END"


def coverage_sql(source: str, original: str, generated: str, key: str = "id") -> str:
    """CTEs that end in covered(key, n, missing)."""
    shape = lambda x: f"list_transform({content_sql(x)}, lambda w: {{'w': w, 't': {triples_sql('w')}}})"
    return f"""va AS (SELECT {key}, {shape(original)} AS a, {shape(generated)} AS b FROM {source}),
covered AS (SELECT {key}, len(a) AS n, list_transform(list_filter(a, lambda x: len(list_filter(b, lambda y: {cosine_sql("x.t", "y.t")} > 0.7)) = 0), lambda x: x.w) AS missing FROM va)"""


@query(f"WITH {MET}, {coverage_sql('met', 'prev', 'text')} SELECT id, round(1.0 - CAST(len(missing) AS DOUBLE) / n, 6) AS coverage, missing, 1.0 - CAST(len(missing) AS DOUBLE) / n >= 0.8 AS passed FROM covered WHERE n > 0")
def soft_keyword_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each turn's content the next one covers, words alike by their letters included."""
    rows = met(spark, sf_dir).select("id", F.explode_outer(F.array(jd.soft_coverage(F.col("prev"), F.col("text")))).alias("x")).where(F.col("x").isNotNull())  # a filter is not put before an explode, where it would work all out once more
    return rows.select("id", F.round("x.coverage", 6).alias("coverage"), "x.missing", (F.col("x.coverage") >= 0.8).alias("passed"))


WORD_SET = lambda x: f"list_distinct({tokens_sql(x)})"
BEST = f"list_extract(list_sort(list_transform(range(1, len(after) + 1), lambda i: {{'like': -({cosine_sql(WORD_SET('p'), WORD_SET('after[i]'))}), 'at': i}})), 1)"
KEYS_MET = "len(list_intersect({a}, {b}))"
HYBRID = f"m.like < -0.25 AND len({content_sql('p')}) > 0 AND CAST({KEYS_MET.format(a=content_sql('p'), b=content_sql('after[m.at]'))} AS DOUBLE) / len({content_sql('p')}) >= 0.75"


@query(
    f"""WITH {TURN_LISTS.cte()}, l AS (SELECT id, before, list_filter(before, lambda p: NOT coalesce({bound(BEST, "m", f"m.like < -0.45 OR ({HYBRID})")}, false)) AS missing FROM turn_lists)
SELECT id, round(CASE WHEN len(before) = 0 THEN 1.0::DOUBLE ELSE 1.0 - CAST(len(missing) AS DOUBLE) / len(before) END, 6) AS recall, missing FROM l"""
)
def proposition_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a turn's sentences the next turn keeps, by its likeliest sentence."""
    rows = TURN_LISTS.df(spark, sf_dir).select("id", jd.proposition_recall(F.col("before"), F.col("after")).alias("x"))
    return rows.select("id", F.round("x.recall", 6).alias("recall"), "x.missing")


ENDS = f"list_transform(list_filter(range(1, len(t) + 1), lambda i: k[i] = 'VERB'), lambda i: [coalesce({NEAR.format(t='t[1:i - 1]', k='k[1:i - 1]')}[-1][1], ''), coalesce({NEAR.format(t='t[i + 1:]', k='k[i + 1:]')}[1][1], '')])"


@query(
    f"""WITH {MET}, t AS (SELECT id, prev, {T} AS t, list_filter(list_distinct({tokens_sql("prev")}), lambda w: {tag_sql("w")} = 'NOUN' AND NOT list_contains({list_sql(lx.STOPS)}, w)) AS nouns, len({words_sql("prev")}) AS n FROM met), k AS (SELECT *, {KIND} AS k FROM t),
e AS (SELECT id, nouns, n, {ENDS} AS e FROM k), m AS (SELECT id, n, e, len(nouns) AS nn, len(list_intersect(nouns, flatten(e))) AS met FROM e)
SELECT id, (n > 5 AND len(e) = 0) OR (nn > 0 AND (met = 0 OR CAST(met AS DOUBLE) / nn < 0.5)) AS incomplete FROM m"""
)
def blueprint_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the triples of a turn leave out what the turn before is about."""
    return met(spark, sf_dir).select("id", jd.blueprint_incomplete(F.col("prev"), an.triples(F.col("text"))).alias("incomplete"))


def anchors_of(c):
    return tx.let(tx.tokens(c), lambda o: F.array_compact(F.array(*(F.get(o, F.lit(i)) for i in (1, 3, 6)))))


NEXT = "list_filter(range(1, len(g) + 1), lambda q: q > s[2] AND g[q] = k[x[1]])"


def adherence_sql(source: str) -> str:
    """CTEs that end in adhered(id, adherence)."""
    return f"""ha AS (SELECT id, {tokens_sql("original")} AS o, {tokens_sql("generated")} AS g FROM {source}), hk AS (SELECT id, g, list_filter([o[2], o[4], o[7]], lambda x: x IS NOT NULL) AS k FROM ha),
hf AS (SELECT id, k, list_reduce(list_concat([[0::BIGINT, 0::BIGINT]], list_transform(range(1, len(k) + 1), lambda i: [i, 0])), lambda s, x: CASE WHEN len({NEXT}) > 0 THEN [s[1] + 1, list_min({NEXT})] ELSE s END) AS s FROM hk),
adhered AS (SELECT id, CASE WHEN len(k) = 0 THEN 1.0::DOUBLE ELSE CAST(s[1] AS DOUBLE) / len(k) END AS adherence FROM hf)"""


def recalled_sql(source: str) -> str:
    """CTEs that end in recalled(id, recall, prec)."""
    return f"""rc AS (SELECT id, {content_sql("original")} AS a, {content_sql("generated")} AS b FROM {source}),
recalled AS (SELECT id, CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / len(a) END AS recall, CASE WHEN len(b) = 0 THEN 1.0::DOUBLE ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / len(b) END AS prec FROM rc)"""


LEXICON = [*lx.COORDINATORS, *lx.SUBORDINATORS, "the"]


@over(
    CITED,
    CITED_TURNS,
    f""", {adherence_sql("cited")}, {recalled_sql("cited")}, d AS (SELECT c.id, generated, adherence, greatest(0.01::DOUBLE, 0.5::DOUBLE * recall + 0.5::DOUBLE * adherence) AS semantic, CASE WHEN len({tokens_sql("generated")}) = 0 THEN 0.0::DOUBLE ELSE CAST(len(list_filter({tokens_sql("generated")}, lambda w: list_contains({list_sql(LEXICON)}, w))) AS DOUBLE) / len({tokens_sql("generated")}) END AS density,
 len({words_sql("original")}) AS n, CAST(len({words_sql("generated")}) AS DOUBLE) / greatest(len({words_sql("original")}), 1) AS growth FROM cited c JOIN adhered h ON c.id = h.id JOIN recalled r ON c.id = r.id),
v AS (SELECT *, CASE WHEN regexp_matches(generated, '{jd.PLACEHOLDER}') THEN 'placeholder' WHEN growth > CASE WHEN n < 10 THEN 6.5 WHEN n < 20 THEN 4.0 ELSE 2.5 END AND density <= 0.4 THEN 'expansion' WHEN semantic < 0.7 OR adherence < 0.7 THEN 'gates' ELSE 'passed' END AS reason FROM d)
SELECT id, reason, round(CASE WHEN reason = 'placeholder' THEN 0.0 ELSE semantic END, 6) AS semantic, round(CASE WHEN reason = 'placeholder' THEN 0.0 ELSE adherence END, 6) AS adherence, round(CASE WHEN reason = 'placeholder' THEN 0.0 ELSE density END, 6) AS density,
 round(CASE WHEN reason = 'passed' THEN semantic * 0.4::DOUBLE + adherence * 0.3::DOUBLE + density * 0.3::DOUBLE ELSE 0.0 END, 6) AS composite FROM v""",
)
def template_candidates(rows: DataFrame) -> DataFrame:
    x = jd.template_candidate(F.col("original"), F.col("generated"), anchors_of(F.col("original")), F.array(*map(F.lit, LEXICON)))
    rows = rows.select("id", x.alias("x"))
    return rows.select("id", "x.reason", *(F.round(f"x.{k}", 6).alias(k) for k in ("semantic", "adherence", "density", "composite")))


@over(
    CITED,
    CITED_TURNS,
    f""", {adherence_sql("cited")}, {recalled_sql("cited")}, said AS (SELECT id, generated AS text FROM cited), {fluency_sql("said")}
SELECT c.id, round(greatest(0.01::DOUBLE, 0.5::DOUBLE * recall + 0.5::DOUBLE * adherence), 6) AS raw_score, round(recall, 6) AS recall, round(adherence, 6) AS adherence, round(fluency, 6) AS fluency, round({cosine_sql(WORD_SET("original"), WORD_SET("generated"))}, 6) AS similarity, round(prec, 6) AS precision FROM cited c JOIN adhered h ON c.id = h.id JOIN recalled r ON c.id = r.id JOIN fluent f ON c.id = f.id""",
)
def raw_evaluation(rows: DataFrame) -> DataFrame:
    """The whole record of an evaluation but for its verdict, see `evaluate_pairs`."""
    rows = rows.select("id", jd.full_record(F.col("original"), F.col("generated"), anchors_of(F.col("original"))).alias("x"))
    return rows.select("id", *(F.round(f"x.{k}", 6).alias(k) for k in ("raw_score", "recall", "adherence", "fluency", "similarity", "precision")))


def verdict_sql(source: str) -> str:
    """CTEs that end in judged(id, kind, score) from source(id, original, text)."""
    most = lambda x: f"coalesce(list_max(map_values(list_histogram({x}))), 0)"
    return f"""jr AS (SELECT id, original, text AS generated FROM {source}), {recalled_sql("jr")}, {fluency_sql(source)}, {coverage_sql("jr", "original", "generated")},
jw AS (SELECT id, text, len({words_sql("original")}) AS m, {words_sql("text")} AS w, {PARTS} AS parts, {FIRSTS} AS firsts FROM {source}),
jp AS (SELECT *, list_transform(range(1, greatest(len(w), 1)), lambda i: lower(w[i]) || ' ' || lower(w[i + 1])) AS pairs FROM jw),
jg AS (SELECT id, {STRIPPED.format(x="text")} = '' AS e, CASE WHEN m = 0 THEN 1.0::DOUBLE ELSE CAST(len(w) AS DOUBLE) / m END AS r, {COMPLETE} AS complete, (len(w) > 5 AND {most("pairs")} > 3) OR (len(parts) >= 3 AND len(firsts) >= 3 AND {most("firsts")} > 2) AS repeats, len({CLAUSES}) > 0 AS clause FROM jp),
judged AS (SELECT jg.id, CASE WHEN e THEN 'empty' WHEN r < 0.5 THEN 'meaning' WHEN r > 2.5 THEN 'structure' WHEN NOT coalesce(complete, false) THEN 'grammar' WHEN repeats THEN 'repetition' WHEN clause THEN 'clause' WHEN n > 0 AND 1.0 - CAST(len(missing) AS DOUBLE) / greatest(n, 1) < 0.8 THEN 'coverage' ELSE 'ok' END AS kind,
  round((2 * recall + prec + fluency) / 4, 6) AS score FROM jg JOIN recalled USING (id) JOIN fluent USING (id) JOIN covered USING (id))"""


@query(f"WITH {MET}, said AS (SELECT id, prev AS original, text FROM met), {verdict_sql('said')} SELECT id, kind = 'ok' AS passed, kind, score FROM judged")
def critic_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn judged against the one before: prechecks in order, then the weighed score."""
    return met(spark, sf_dir).select("id", gn.verdict(F.col("prev"), F.col("text")).alias("v")).select("id", "v.*")


@query(
    f"""WITH shown AS (SELECT item_id AS id, text AS paragraph FROM benchmark), asked AS (SELECT id, paragraph, {FIRST_TWO} AS response FROM shown), {clean_sql("response", "asked", "id, paragraph")}, said AS (SELECT id, paragraph AS original, cleaned AS text FROM cleaned), {verdict_sql("said")},
m AS (SELECT id, kind, score, CASE WHEN kind = 'ok' AND score >= 0.75 THEN 'strict' WHEN kind = 'ok' AND score >= 0.6 THEN 'loose' WHEN kind = 'ok' OR kind NOT IN ('empty', 'meaning') THEN 'safety' ELSE 'none' END AS mode FROM judged)
SELECT m.id AS item_id, text AS generated, mode, kind, score, CASE mode WHEN 'strict' THEN 1 WHEN 'loose' THEN 2 ELSE 3 END AS attempts FROM m JOIN said USING (id)"""
)
def critic_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through a generator (here the offline stub) and its critic, strictly first, then less so."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return gn.with_critic(rows, lambda: Retry(Stub())).drop("text")


@query()
def evolved_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns improved towards the turn before over three generations of the offline stub."""
    rows = met(spark, sf_dir).select("id", F.col("prev").alias("original"), F.col("text").alias("draft"))
    return gn.evolved(rows, lambda: Retry(Stub())).select("id", "text", "score", "generation")


ARENA = """candidates AS (SELECT id, i AS cand, CASE WHEN (id + i) % 4 = 0 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS adherence, (id + i) % 11 = 0 AS logic_fail, CAST((id * 7 + i * 3) % 10 AS DOUBLE) / 9 AS recall, CAST((id + i * 5) % 8 AS DOUBLE) / 7 AS similarity, (id + i) % 5 = 1 AS leaked, CAST((id * 3 + i) % 13 AS DOUBLE) / 12 AS density FROM met, (SELECT unnest(range(1, 9)) AS i))"""


@query(
    f"""WITH {MET}, {ARENA}, a AS (SELECT *, recall >= 0.85 AND NOT leaked AS valid FROM candidates WHERE adherence >= 0.7 AND NOT logic_fail AND (recall >= 0.5 OR similarity > 0.85)), b AS (SELECT *, bool_or(valid) OVER (PARTITION BY id) AS any_ FROM a)
SELECT id, cand, CAST(row_number() OVER (PARTITION BY id ORDER BY CASE WHEN any_ THEN density ELSE recall END DESC, cand) AS INTEGER) AS rank, CASE WHEN any_ THEN 'style' ELSE 'repair' END AS ranked_by FROM b WHERE valid OR NOT any_ QUALIFY rank <= 5"""
)
def arena_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of eight candidates for each turn (their scores made from its id) those that go on."""
    i = F.col("cand")
    rows = met(spark, sf_dir).select("id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))).alias("cand"))
    part = lambda a, b, m: ((F.col("id") * a + i * b) % m).cast("double") / (m - 1)
    made = rows.select(
        "id", "cand", F.when((F.col("id") + i) % 4 == 0, 0.5).otherwise(0.9).alias("adherence"), ((F.col("id") + i) % 11 == 0).alias("logic_fail"), part(7, 3, 10).alias("recall"), part(1, 5, 8).alias("similarity"),
        ((F.col("id") + i) % 5 == 1).alias("leaked"), part(3, 1, 13).alias("density"),
    )
    return gn.arena(made, "id", "cand")


# --- templates, phrases, words

SLOT = f"CASE {tag_sql('w')} WHEN 'NOUN' THEN '[NP]' WHEN 'VERB' THEN '[VP]' WHEN 'ADJ' THEN '[ADJ]' ELSE w END"
ONE_TEMPLATE = bound(f"list_transform({tokens_sql('s')}, lambda w: {SLOT})", "x", "coalesce(nullif(array_to_string(list_filter(x, lambda y, i: i = 1 OR NOT starts_with(y, '[') OR y <> x[greatest(i - 1, 1)]), ' ') || '.', '.'), '[NP] [VP] [NP].')")


@query(f"SELECT item_id, CASE WHEN len({SENTS_OF.format(x='text')}) > 0 THEN list_transform({SENTS_OF.format(x='text')}, lambda s: {ONE_TEMPLATE}) ELSE ['[NP] [VP] [NP].'] END AS templates FROM benchmark")
def sentence_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", jd.sentence_templates(F.col("text")).alias("templates"))


PALETTE = ["stone", "river", "station", "reading", "standing", "started", "useful", "active", "national", "quickly", "onwards", "ending"]
ALIKE = cosine_sql(triples_sql("w"), triples_sql("p"))
FIT = f"list_filter({list_sql(sorted(PALETTE))}, lambda p: {tag_sql('p')} = kind AND p <> w)"
CHOSEN = f"list_extract(list_sort(list_transform({FIT}, lambda p: {{'d': -({ALIKE}), 'w': p}})), 1)"


@query(f"WITH w AS (SELECT DISTINCT unnest({T}) AS w FROM documents), k AS (SELECT w, {tag_sql('w')} AS kind FROM w), c AS (SELECT w, kind, {CHOSEN} AS best FROM k) SELECT w AS word, CASE WHEN -best.d >= 0.3 THEN best.w WHEN kind = 'NOUN' THEN 'structure' WHEN kind = 'ADJ' THEN 'large' END AS replacement FROM c")
def semantic_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each word what an author's palette has for it; distinct words are found before anything is compared."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("word")).distinct()
    return words.select("word", jd.replacement(F.col("word"), F.array(*map(F.lit, sorted(PALETTE)))).alias("replacement"))


SYNONYMS = {"the": ["this", "that"], "and": ["plus", "also"], "of": ["from"], "river": ["stream"]}
KNOWN = "CASE lower(w) " + " ".join(f"WHEN '{k}' THEN {list_sql(v)}" for k, v in SYNONYMS.items()) + " ELSE []::VARCHAR[] END"


@query(f"WITH w AS (SELECT DISTINCT unnest({T}) AS w FROM benchmark) SELECT w AS word, list_sort(list_distinct(list_concat([lower(w)], {KNOWN}))) AS synonyms FROM w")
def synonym_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their synonyms from a given table."""
    known = F.create_map(*(x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    words = table(spark, sf_dir, "benchmark").select(F.explode(tx.tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", jd.synonyms(F.col("word"), known).alias("synonyms"))


CODE = "array_to_string(list_transform(t, lambda w: CASE " + tag_sql("w") + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in an.LETTERS.items()) + " END), '')"
RUNS = f"regexp_extract_all(s, '{an.PHRASE}')"


@query(
    f"""WITH t AS (SELECT item_id, {T} AS t FROM benchmark), s AS (SELECT item_id, t, {CODE} AS s FROM t), r AS (SELECT item_id, t, list_transform({RUNS}, lambda x: length(x)) AS n, list_transform(string_split_regex(s, '{an.PHRASE}'), lambda x: length(x)) AS g FROM s),
p AS (SELECT item_id, t, n, list_transform(range(1, len(n) + 1), lambda i: coalesce(list_sum(g[1:i]), 0) + coalesce(list_sum(n[1:i - 1]), 0)) AS began FROM r), q AS (SELECT item_id, list_transform(range(1, len(n) + 1), lambda i: t[began[i] + 1:began[i] + n[i]]) AS p FROM p)
SELECT item_id, list_transform(p, lambda x: array_to_string(x, ' ')) AS phrases, list_transform(p, lambda x: array_to_string(list_filter(x, lambda w: {tag_sql("w")} <> 'DET'), ' ')) AS cores FROM q"""
)
def noun_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noun phrases and what is left of them without determiners."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", an.phrases(F.col("text")).alias("phrases"))
    return rows.select("item_id", "phrases", F.transform("phrases", an.core).alias("cores"))


@query(rf"WITH {SENTS}, p AS (SELECT source, unnest(regexp_split_to_array(sentence, '[,;]\s*')) AS p FROM sents), w AS (SELECT source, {tokens_sql('p')}[1] AS marker FROM p) SELECT source, marker, count(*) AS n FROM w WHERE marker IS NOT NULL AND {tag_sql('marker')} IN ('ADV', 'SCONJ', 'CCONJ') GROUP BY source, marker")
def discourse_markers_lex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each author joins clauses with what."""
    rows = para_rows(spark, sf_dir).select("source", F.explode(an.discourse_markers(F.col("paragraph"))).alias("marker"))
    return rows.groupBy("source", "marker").agg(F.count("*").alias("n"))


@query(
    f"""WITH RECURSIVE e AS (SELECT vec_id, label, {E} AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
r AS (SELECT DISTINCT label, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ids, CAST([] AS DOUBLE[][]) AS vs, CAST(NULL AS BIGINT) AS vec_id, CAST(NULL AS BIGINT) AS leader FROM e
 UNION ALL SELECT label, i, CASE WHEN f IS NULL THEN list_append(ids, vec_id) ELSE ids END, CASE WHEN f IS NULL THEN list_append(vs, v) ELSE vs END, vec_id, coalesce(ids[f], vec_id)
 FROM (SELECT e.label, e.i, r.ids, r.vs, e.vec_id, e.v, list_filter(range(1, len(r.ids) + 1), lambda k: round(list_cosine_similarity(r.vs[k], e.v), 6) >= 0.7)[1] AS f FROM r JOIN e ON e.label = r.label AND e.i = r.i + 1))
SELECT label, vec_id, leader FROM r WHERE i > 0"""
)
def vocabulary_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's vectors in groups around the first ones: a vector joins the first leader that it is like (cosine 0.7 or more)."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    led = me.leaders(me.unit(rows, "vec_id", "embedding", by="label"), 0.7).withColumnRenamed("id", "vec_id")
    return rows.select("label", "vec_id").join(led, "vec_id", "left").select("label", "vec_id", F.coalesce("leader", "vec_id").alias("leader"))


# --- joins

NEAREST = f"e AS (SELECT vec_id, label, {E} AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id)"


@query(f"WITH {NEAREST} SELECT query_id, vec_id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 3")
def nearest_of_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's three nearest of its label, by pivots and blocks."""
    rows = me.unit(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", by="label")
    return me.nearest(rows, rows, 3).select(F.col("query").alias("query_id"), F.col("id").alias("vec_id"), F.col("likeness").alias("similarity"), F.col("rank").cast("int"))


@query("SELECT item_id, doc_id, n, n_chars FROM (SELECT item_id, length(text) AS n FROM benchmark) b JOIN documents d ON CAST(d.n_chars AS DOUBLE) / b.n >= 0.98 AND CAST(d.n_chars AS DOUBLE) / b.n <= 1.02 WHERE n > 0 AND n_chars > 0")
def length_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as long as a benchmark item, give or take a fiftieth."""
    left = table(spark, sf_dir, "benchmark").select("item_id", F.length("text").cast("long").alias("n"))
    right = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("n"))
    return mt.band_join(left, right, "n", 0.98, 1.02).select("item_id", F.col("_rdoc_id").alias("doc_id"), "n", F.col("_rn").alias("n_chars"))


# --- paragraphs by their tags

TAGGED = f"""{PARAS}, ps AS (SELECT source, doc_id, para_idx, paragraph, list_transform({SENTS_OF.format(x="paragraph")}, lambda s: {tokens_sql("s")}) AS s FROM paras),
pt AS (SELECT *, flatten(s) AS t FROM ps), pk AS (SELECT *, {KIND} AS k FROM pt),
pv AS (SELECT *, list_filter(range(1, len(k) + 1), lambda i: k[i] = 'VERB') AS verbs, list_transform(s, lambda x: CAST(len(x) AS DOUBLE)) AS lens FROM pk),
features AS (SELECT source, doc_id, para_idx, paragraph, CAST(len(s) AS DOUBLE) AS sentence_count, list_avg(lens) AS avg_len, CASE WHEN list_avg(lens) > 0 THEN sqrt(list_avg(list_transform(lens, lambda x: (x - list_avg(lens)) * (x - list_avg(lens))))) / list_avg(lens) ELSE 0.0 END AS burstiness,
  CASE WHEN len(verbs) = 0 THEN 0.0::DOUBLE ELSE list_avg(list_transform(range(1, len(k) + 1), lambda i: CAST(list_min(list_transform(verbs, lambda v: abs(v - i))) AS DOUBLE))) END AS complexity,
  CAST(len(list_filter(t, lambda w: list_contains({list_sql(lx.SUBORDINATORS)}, w))) AS DOUBLE) / len(s) AS clause_density, CAST(len(list_filter(k, lambda x: x = 'NOUN')) AS DOUBLE) / greatest(len(k), 1) AS noun_ratio, CAST(len(verbs) AS DOUBLE) / greatest(len(k), 1) AS verb_ratio, CAST(len(list_filter(k, lambda x: x = 'ADJ')) AS DOUBLE) / greatest(len(k), 1) AS adj_ratio,
  CASE WHEN ends_with(paragraph, '?') THEN 1.0::DOUBLE ELSE 0.0 END AS ends_question FROM pv WHERE len(s) >= 2)"""
FEATURES = ["sentence_count", "avg_len", "burstiness", "complexity", "clause_density", "noun_ratio", "verb_ratio", "adj_ratio", "ends_question"]


@query(f"WITH {TAGGED} SELECT doc_id, para_idx, {', '.join(f'round({f}, 6) AS {f}' for f in FEATURES)} FROM features")
def paragraph_features_lex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine features of each paragraph of two sentences or more."""
    rows = ms.paragraph_features(para_rows(spark, sf_dir))
    return rows.select("doc_id", "para_idx", *(F.round(f, 6).alias(f) for f in FEATURES))


SCORED = "scored AS (SELECT *, (doc_id * 3 + para_idx) % 5 + 1 AS style_score FROM features), kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) - 1 AS INTEGER) AS seq_id FROM scored WHERE style_score >= 4)"


def kept_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ms.paragraph_features(para_rows(spark, sf_dir)).withColumn("style_score", (F.col("doc_id") * 3 + F.col("para_idx")) % 5 + 1)
    return ms.gated(rows, "style_score", 4)


@query(f"WITH {TAGGED}, {SCORED} SELECT doc_id, para_idx, seq_id, style_score FROM kept")
def corpus_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that have features and a style score (here from their ids) of four or more, numbered anew."""
    return kept_paragraphs(spark, sf_dir).select("doc_id", "para_idx", "seq_id", "style_score")


TOLD = "count(*) AS n, round(avg(sentence_count), 1) AS avg_sents, round(avg(avg_len), 1) AS avg_len, CASE WHEN avg(burstiness) > 0.6 THEN 'High' ELSE 'Low' END AS burstiness, CASE WHEN avg(noun_ratio) > 0.25 THEN 'Noun-Heavy/Academic' ELSE 'Balanced' END AS style, round(avg(style_score), 1) AS avg_style_score, round(avg(noun_ratio), 3) AS noun_ratio, round(avg(clause_density), 3) AS clause_density"


@query(
    f"""WITH {TAGGED}, {SCORED}, a AS (SELECT *, CASE WHEN sentence_count <= 2 THEN 0 WHEN sentence_count <= 4 THEN 1 ELSE 2 END AS archetype_id FROM kept)
SELECT archetype_id, {TOLD}, (arg_min(paragraph, {{'s': -style_score, 'd': doc_id, 'p': para_idx}})) AS example FROM a GROUP BY archetype_id UNION ALL SELECT -1, {TOLD}, (arg_min(paragraph, {{'s': -style_score, 'd': doc_id, 'p': para_idx}})) FROM a"""
)
def archetype_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each archetype's means, labels and best-scored paragraph, and as -1 those of all: one rollup."""
    rows = kept_paragraphs(spark, sf_dir).withColumn("archetype_id", F.when(F.col("sentence_count") <= 2, 0).when(F.col("sentence_count") <= 4, 1).otherwise(2))
    return ms.described(rows)


@query(f"WITH {SENTS}, c AS (SELECT source, doc_id, para_idx, count(*) AS n FROM sents GROUP BY ALL), a AS (SELECT *, CASE WHEN n <= 2 THEN 0 WHEN n <= 4 THEN 1 ELSE 2 END AS archetype_id FROM c), b AS (SELECT archetype_id, min({{'d': doc_id, 'p': para_idx}}) AS b FROM a GROUP BY archetype_id) SELECT archetype_id, b.d AS doc_id, b.p AS para_idx, paragraph FROM b JOIN paras ON doc_id = b.d AND para_idx = b.p")
def archetype_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first paragraph of each archetype: one aggregate, then a lookup of a few rows."""
    first = shapes(spark, sf_dir).groupBy("archetype_id").agg(F.min(F.struct("doc_id", "para_idx")).alias("b")).select("archetype_id", "b.*")
    return para_rows(spark, sf_dir).join(first, ["doc_id", "para_idx"]).select("archetype_id", "doc_id", "para_idx", "paragraph")


@query(f"WITH {PARAS}, n AS (SELECT source, count(*) AS n FROM paras GROUP BY source) SELECT source, n, CASE WHEN n < 10 THEN least(n, 8) ELSE greatest(8, least(CAST(floor(sqrt(n)) AS BIGINT), 50)) END AS clusters FROM n")
def cluster_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many archetypes each author's paragraphs bear."""
    rows = para_rows(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    return rows.select("source", "n", ms.cluster_number(F.col("n")).alias("clusters"))


RATIO = f"CAST(len(list_filter(k, lambda x: x = 'ADJ')) AS DOUBLE) / greatest(len(list_filter(k, lambda x: x = 'VERB')), 1) / 3.0"


@query(f"WITH {STYLE}, k AS (SELECT doc_id, list_transform(t, lambda w: {tag_sql('w')}) AS k FROM base) SELECT s.doc_id, {', '.join(f'CAST(round({d}, 6) AS DOUBLE) AS {d}' for d in DIMS)}, round(greatest(0.0, least(1.0, {RATIO})), 6) AS adjectives_lex FROM style s JOIN k USING (doc_id)")
def style_vector7_lex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven dimensions of a document's style."""
    c = F.col("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", ms.style_struct(c).alias("_s"), ms.adjectives_to_verbs(c).alias("adjectives_lex"))
    return rows.select("doc_id", *(F.round(F.col("_s")[d], 6).alias(d) for d in DIMS), F.round("adjectives_lex", 6).alias("adjectives_lex"))


MOOD = f"CASE WHEN list_contains({list_sql(lx.POSITIVE)}, word) THEN 'positive' WHEN list_contains({list_sql(lx.NEGATIVE)}, word) THEN 'negative' ELSE 'neutral' END"


@query(f"WITH w AS (SELECT unnest({T}) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM w WHERE length(word) > 2 AND {tag_sql('word')} IN ('ADJ', 'VERB') AND NOT list_contains({list_sql(lx.STOPS)}, word) GROUP BY word), t AS (SELECT * FROM c ORDER BY n DESC, word LIMIT 60), m AS (SELECT word, n, {MOOD} AS polarity FROM t) SELECT polarity, word, n, CAST(row_number() OVER (PARTITION BY polarity ORDER BY n DESC, word) AS INTEGER) AS rank FROM m QUALIFY rank <= 20")
def polarity_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent adjectives and verbs (a top-k report: sixty, twenty a class) by polarity."""
    return ms.polarity_words(table(spark, sf_dir, "documents"), 20)


GENERAL = f"w AS (SELECT source, word FROM (SELECT source, unnest({T}) AS word FROM documents) WHERE NOT list_contains({list_sql(lx.STOPS)}, word) AND {tag_sql('word')} IN ('NOUN', 'VERB', 'ADJ')), c AS (SELECT source, word, count(*) AS n FROM w GROUP BY ALL), g AS (SELECT source, list(word ORDER BY n DESC, word)[1:50] AS general FROM c GROUP BY source)"


@query(
    f"""WITH {GENERAL}, t AS (SELECT source, {T} AS t FROM documents), k AS (SELECT source, t, {KIND} AS k FROM t), i AS (SELECT source, list_sort(list_distinct(flatten(list(list_transform(list_filter(range(1, len(t)), lambda i: k[i] = 'ADV' AND k[i + 1] = 'ADJ'), lambda i: t[i]))))) AS intensifiers FROM k GROUP BY source)
SELECT i.source, intensifiers, coalesce(general, []) AS general FROM i LEFT JOIN g ON i.source IS NOT DISTINCT FROM g.source"""
)
def general_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each author's adverbs before adjectives, and its fifty most frequent nouns, verbs and adjectives."""
    return ms.palette(table(spark, sf_dir, "documents"), 50)
