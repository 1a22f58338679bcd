"""Queries that hold a text against the one it answers, and rewriters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import compare as cp
from ..functions import lexicon as lx
from ..functions import rewrite as rw
from ..functions import text as tx
from ..functions.fixture import Fixture
from .made import CITED_TURNS, LINE_DOCS, RAW_TURNS, SCALPEL_SENTS, SENT_CASES, TURNS, VARIANT_TURNS, turn_pairs
from .registry import list_sql, over, query, table, tokens_sql, words_sql
from .rules import CASES

CITED = Fixture(
    "cited",
    "id int, original string, generated string",
    [
        (1, "Rivers rise [^1] and fall [^2].", "Rivers rise [^1] and fall [^2]."),
        (2, 'He said "the bridge stands" twice [^3].', "He spoke twice."),
        (3, "Nothing to keep.", "Nothing kept [^9]."),
        (4, 'A "quoted part" and [^4] and [^4].', 'The "quoted part" stays (Smith, 2001).'),
        (5, "Water [^10] and stone [^2].", "Water  flows over stone [^7]!"),
        (6, "The old Bridge stood.", "The bridge near Delft stood. Anna saw it."),
    ],
)


def content_sql(x: str) -> str:
    return f"list_sort(list_distinct(list_filter({tokens_sql(x)}, lambda w: NOT list_contains({list_sql(lx.STOPS)}, w) AND length(w) > 2)))"


def refs_sql(x: str) -> str:
    return rf"list_sort(list_distinct(regexp_extract_all({x}, '\[\^\d+\]')))"


def quotes_sql(x: str) -> str:
    return rf"""list_transform(list_filter(list_transform(regexp_extract_all({x}, '["''][^"'']*["'']'), lambda q: regexp_replace(q, '^["'']+|["'']+$', '', 'g')), lambda q: length(q) > 2), lambda q: trim(q))"""


@over(
    CITED,
    CITED_TURNS,
    f""", p AS (SELECT id, {refs_sql("original")} AS a, {refs_sql("generated")} AS b, {quotes_sql("original")} AS q, {quotes_sql("generated")} AS r FROM cited),
m AS (SELECT *, list_filter(a, lambda x: NOT list_contains(b, x)) AS lost, list_filter(q, lambda x: NOT list_contains(r, x)) AS gone FROM p)
SELECT id, round(CASE WHEN len(a) + len(q) = 0 THEN 1.0::DOUBLE ELSE 1.0 - CAST(len(lost) + len(gone) AS DOUBLE) / (len(a) + len(q)) END, 6) AS score, lost AS missing_citations, gone AS missing_quotes FROM m""",
)
def citation_quote_preservation(rows: DataFrame) -> DataFrame:
    rows = rows.select("id", cp.preservation(F.col("original"), F.col("generated")).alias("p"))
    return rows.select("id", F.round("p.score", 6).alias("score"), "p.missing_citations", "p.missing_quotes")


@query(
    f"""WITH {TURNS}, c AS (SELECT conv_id, turn, {content_sql("prev")} AS a, {content_sql("text")} AS b, list_distinct({words_sql("prev")}) AS x, list_distinct({words_sql("text")}) AS y FROM turns WHERE prev IS NOT NULL)
SELECT conv_id, turn, round(CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE CAST(len(list_filter(a, lambda w: list_contains(b, w))) AS DOUBLE) / len(a) END, 6) AS recall,
 round(CASE WHEN len(b) = 0 THEN 1.0::DOUBLE ELSE CAST(len(list_filter(b, lambda w: list_contains(a, w) OR w = 'the')) AS DOUBLE) / len(b) END, 6) AS precision,
 round(CASE WHEN len(x) + len(y) = 0 THEN 0.0::DOUBLE ELSE CAST(len(list_filter(x, lambda w: list_contains(y, w))) AS DOUBLE) / (len(x) + len(y) - len(list_filter(x, lambda w: list_contains(y, w)))) END, 6) AS jaccard FROM c"""
)
def keyword_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, precision with allowed words, and Jaccard likeness of each turn against the one before."""
    a, b = F.col("prev"), F.col("text")
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(cp.recall(a, b), 6).alias("recall"), F.round(cp.precision(a, b, F.array(F.lit("the"))), 6).alias("precision"), F.round(cp.jaccard(a, b), 6).alias("jaccard"))


@over(
    CITED,
    CITED_TURNS,
    rf""", s AS (SELECT id, {tokens_sql("original")} AS known, flatten(list_transform(list_filter(list_transform(string_split(regexp_replace(generated, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), lambda s: {words_sql("s")}[2:])) AS inner_words FROM cited)
SELECT id, list_sort(list_distinct(list_filter(list_transform(list_filter(inner_words, lambda w: regexp_matches(w, '^\p{{Lu}}\p{{Ll}}')), lambda w: regexp_replace(w, '[^\p{{L}}]+$', '')), lambda w: NOT list_contains(known, lower(w)) AND NOT list_contains({list_sql(lx.STOPS)}, lower(w))))) AS invented FROM s""",
)
def hallucinated_words(rows: DataFrame) -> DataFrame:
    return rows.select("id", cp.invented(F.col("original"), F.col("generated")).alias("invented"))


KEYS = ["bridge", "delft", "water", "stone", "and", "tion"]


@over(
    CITED,
    CITED_TURNS,
    f"""SELECT id, list_filter({list_sql(KEYS)}, lambda k: contains(lower(generated), k) AND NOT contains(lower(original), k)) AS leaked, round(CAST(len(list_filter({list_sql(KEYS)}, lambda k: contains(lower(generated), k))) AS DOUBLE) / {len(KEYS)}, 6) AS covered,
 round(CASE WHEN len({tokens_sql("generated")}) = 0 THEN 0.0::DOUBLE ELSE CAST(len(list_filter({tokens_sql("generated")}, lambda w: list_contains({list_sql(KEYS)}, w))) AS DOUBLE) / len({tokens_sql("generated")}) END, 6) AS density FROM cited""",
)
def context_leak(rows: DataFrame) -> DataFrame:
    keys = F.array(*map(F.lit, KEYS))
    g, o = F.col("generated"), F.col("original")
    return rows.select("id", cp.leaked(keys, g, o).alias("leaked"), F.round(cp.covered(keys, g), 6).alias("covered"), F.round(cp.density(g, keys), 6).alias("density"))


NEXT = "list_filter(range(1, len(g) + 1), lambda q: q > s[2] AND g[q] = k[x[1]])"


@over(
    CITED,
    CITED_TURNS,
    f""", a AS (SELECT id, {tokens_sql("original")} AS o, {tokens_sql("generated")} AS g FROM cited), k AS (SELECT id, g, list_filter([o[2], o[4], o[7]], lambda x: x IS NOT NULL) AS k FROM a),
f AS (SELECT id, k, list_reduce(list_concat([[0::BIGINT, 0::BIGINT]], list_transform(range(1, len(k) + 1), lambda i: [i, 0])), lambda s, x: CASE WHEN len({NEXT}) > 0 THEN [s[1] + 1, list_min({NEXT})] ELSE s END) AS s FROM k)
SELECT id, round(CASE WHEN len(k) = 0 THEN 1.0::DOUBLE ELSE CAST(s[1] AS DOUBLE) / len(k) END, 6) AS adherence FROM f""",
)
def adherence_inorder(rows: DataFrame) -> DataFrame:
    """Share of three anchor words of the source that the output has in order."""
    anchors = tx.let(tx.tokens(F.col("original")), lambda o: F.array_compact(F.array(*(F.get(o, F.lit(i)) for i in (1, 3, 6)))))
    return rows.select("id", F.round(cp.adherence(anchors, F.col("generated")), 6).alias("adherence"))


LENGTHS = "h AS (SELECT source, least(length(w), 20) AS k, count(*) AS n FROM (SELECT source, unnest({t}) AS w FROM documents) GROUP BY source, k)"


@query(
    f"""WITH {LENGTHS.format(t=tokens_sql("text"))}, p AS (SELECT source, k, n::DOUBLE / sum(n) OVER (PARTITION BY source) AS p FROM h), g AS (SELECT k, sum(n) AS n FROM h GROUP BY k), q AS (SELECT k, n::DOUBLE / sum(n) OVER () AS q FROM g)
SELECT source, round(sum(p * ln(p / q)), 6) AS divergence FROM p JOIN q USING (k) GROUP BY source"""
)
def kl_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of an author's distribution of word lengths from all authors'; counts of at most 20 lengths are joined."""
    rows = table(spark, sf_dir, "documents").select("source", F.explode(tx.tokens(F.col("text"))).alias("w"))
    h = rows.groupBy("source", F.least(F.length("w"), F.lit(20)).alias("k")).agg(F.count("*").alias("n"))
    own = h.join(h.groupBy("source").agg(F.sum("n").alias("t")), "source").select("source", "k", (F.col("n") / F.col("t")).alias("p"))
    g = h.groupBy("k").agg(F.sum("n").alias("m"))
    whole = g.crossJoin(F.broadcast(g.agg(F.sum("m").alias("t")))).select("k", (F.col("m") / F.col("t")).alias("q"))  # one row
    return own.join(whole, "k").groupBy("source").agg(F.round(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))), 6).alias("divergence"))


STARTERS = "(?i)^(?:" + "|".join(lx.LOGIC_STARTERS) + ")[, ]+"


@over(CASES, SENT_CASES, f", s AS (SELECT id, trim(text) AS t, regexp_replace(trim(text), '{STARTERS}', '') AS u FROM cases) SELECT id, CASE WHEN regexp_matches(t, '{STARTERS}') THEN upper(u[1]) || u[2:] ELSE t END AS rewritten FROM s")
def strip_connectors(rows: DataFrame) -> DataFrame:
    return rows.select("id", rw.without_connector(F.col("text")).alias("rewritten"))


TRIMMED = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def phantoms_sql(x: str) -> str:
    gone = f"list_filter({refs_sql(x)}, lambda r: NOT list_contains({refs_sql('original')}, r))"
    return TRIMMED.format(x=f"regexp_replace(list_reduce(list_concat([{x}], {gone}), lambda t, r: replace(t, r, '')), ' {{2,}}', ' ', 'g')")


@over(
    CITED,
    CITED_TURNS,
    rf""", p AS (SELECT id, original, generated, regexp_replace(generated, '\s*\([A-Z][a-z]+,?\s+\d{{4}}(?:,\s*p\.\s*#?)?\)', '', 'g') AS plain FROM cited),
k AS (SELECT id, {phantoms_sql("generated")} AS without_phantoms, {phantoms_sql("plain")} AS kept, list_filter({refs_sql("original")}, lambda r: NOT list_contains({refs_sql("generated")}, r)) AS lost FROM p)
SELECT id, without_phantoms, CASE WHEN len(lost) = 0 THEN kept ELSE regexp_replace(kept, '[.!?]+$', '') || array_to_string(lost, '') || coalesce(nullif(regexp_extract(kept, '([.!?]+)$', 1), ''), '.') END AS restored FROM k""",
)
def restore_citations(rows: DataFrame) -> DataFrame:
    g, o = F.col("generated"), F.col("original")
    return rows.select("id", rw.without_phantoms(g, cp.citations(o)).alias("without_phantoms"), rw.with_citations(g, o).alias("restored"))


RAW = Fixture(
    "raw",
    "id int, text string",
    [
        (1, "Sure.\nREWRITE: The river rose , and fell...."),
        (2, "CRITICAL: keep it\nThe river rose (Smith, 2001) over Chapter 4 stones ."),
        (3, "Output: plain text"),
        (4, "---\n===\nKept line\n\nOther (Jones 12) line !"),
        (5, 'he said "stop .. here , now" and [^3] . then he left. it was done!  so.'),
        (6, "rewrite it? Rewrite: it's [^1] a 'b' .. end"),
        (7, ""),
        (8, '"whole , quote" only'),
    ],
)


def sql_chain(x: str, steps: list[tuple[str, str]]) -> str:
    for pattern, new in steps:
        quoted = pattern.replace("'", "''")
        x = f"regexp_replace({x}, '{quoted}', '{new}', 'g')"
    return x


def bound(value: str, name: str, body: str) -> str:
    """body, in which `name` stands for the value."""
    return f"list_extract(list_transform([{value}], lambda {name}: {body}), 1)"


def tidy_sql(x: str) -> str:
    return sql_chain(x, [(a, b.replace("$1", r"\1")) for a, b in rw.SPACING])


def clean_sql(text: str, source: str, key: str) -> str:
    """CTEs that end in cleaned(key, cleaned)."""
    span = rw.PROTECTED.replace("'", "''")
    first = f"CASE WHEN k0 = 1 AND regexp_matches(y, '^[a-z]') THEN upper(y[1]) || y[2:] ELSE y END"
    capital = rf"array_to_string(list_transform(string_split(regexp_replace(y0, '([.!?]\s+)([a-z])', '\1' || chr(2) || '\2', 'g'), chr(2)), lambda y, k: CASE WHEN k = 1 THEN {first} ELSE upper(y[1]) || y[2:] END), '')"
    part = bound("i", "k0", bound(tidy_sql("p[i]"), "y0", sql_chain(capital, [(rw.NUMBERED, "")])))
    instruction = " OR ".join(f"starts_with({TRIMMED.format(x='x')}, '{i}')" for i in lx.INSTRUCTIONS)
    held = rf"""CASE WHEN starts_with(q[i], '[^') OR length(regexp_replace(q[i], '^["'']+|["'']+$', '', 'g')) > 2 THEN q[i] ELSE {tidy_sql("q[i]")} END"""
    tail = TRIMMED.format(x=f"string_split_regex({text}, '(?i)rewrite:?[ \\t\\n\\r\\f]*')[-1]")
    return rf"""r AS (SELECT {key}, CASE WHEN regexp_matches({text}, '(?i)rewrite') THEN {tail} ELSE {text} END AS t FROM {source}),
l AS (SELECT {key}, array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT ({instruction} OR {TRIMMED.format(x="x")} IN ('===', '---', ''))), chr(10)) AS t FROM r),
a AS (SELECT {key}, {sql_chain("t", [(x, "") for x in rw.AUTHOR_YEAR])} AS t FROM l),
s AS (SELECT {key}, string_split_regex(t, '{span}') AS p, regexp_extract_all(t, '{span}') AS q FROM a),
w AS (SELECT {key}, array_to_string(list_transform(range(1, len(p) + 1), lambda i: {part} || coalesce({held}, '')), '') AS t FROM s),
cleaned AS (SELECT {key}, {TRIMMED.format(x=f"regexp_replace(t, '{rw.PREFIX}', '')")} AS cleaned FROM w)"""


@over(RAW, RAW_TURNS, f", {clean_sql('text', 'raw', 'id')} SELECT id, cleaned FROM cleaned")
def clean_generated(rows: DataFrame) -> DataFrame:
    return rows.select("id", rw.clean_generated(F.col("text")).alias("cleaned"))


SANE = r"""regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\\n', chr(10), 'g'), '\r\n|\r', chr(10), 'g'), '\t', ' ', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), ' {2,}', ' ', 'g')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""


@query(f"SELECT page_id, {SANE} AS sanitized FROM pages")
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", rw.sanitize(F.col("html")).alias("sanitized"))


LINES = Fixture("corpus_lines", "doc_id int, line_no int, line string", [(1, 1, "Introduction"), (1, 2, "The physi-"), (1, 3, "cist's problem is dif-"), (1, 4, "ferent now."), (1, 5, "12"), (1, 6, "XIV"), (1, 7, "Introduction"), (1, 8, "physi-"), (1, 9, "Biologist names"), (1, 10, "Rest."), (2, 1, "Introduction"), (2, 2, "plain"), (2, 3, "iv")])


@over(
    LINES,
    LINE_DOCS,
    f""", n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS r FROM corpus_lines)
SELECT doc_id, line_no, line FROM n WHERE NOT regexp_matches(trim(line), '^\\d{{1,4}}$') AND NOT regexp_matches(upper(trim(line)), '{lx.ROMAN}') AND NOT (list_contains({list_sql(lx.HEADERS)}, trim(line)) AND r > 1)""",
)
def clean_corpus_lines(rows: DataFrame) -> DataFrame:
    """Lines without page numbers, roman numerals and repeated headers."""
    c = F.trim("line")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "line").orderBy("line_no")))
    return rows.where(~c.rlike(r"^\d{1,4}$") & ~F.upper(c).rlike(lx.ROMAN) & ~(c.isin(lx.HEADERS) & (F.col("r") > 1))).select("doc_id", "line_no", "line")


WAS = "regexp_extract(a, '[^|]*$', 0)"
OPEN = TRIMMED.format(x=f"regexp_replace({WAS}, '-$', '')")
STEM, HEAD = f"coalesce({words_sql(OPEN)}[-1], '')", f"coalesce({words_sql('x')}[1], '')"


@over(
    LINES,
    LINE_DOCS,
    rf""", l AS (SELECT doc_id, list(regexp_replace(line, '\s+$', '') ORDER BY line_no) AS l FROM corpus_lines GROUP BY doc_id)
SELECT doc_id, list_reduce(l, lambda a, x: CASE WHEN ends_with({WAS}, '-') AND regexp_matches({HEAD}, '^\p{{Ll}}') AND length(regexp_replace({HEAD}, '[.,!?;:]+$', '')) <= 8 AND length({STEM}) <= 6 AND NOT regexp_matches({OPEN}, '[.!?:]$')
 THEN a[1:length(a) - length({WAS})] || {OPEN} || {TRIMMED.format(x="x")} ELSE a || '|' || x END) AS text FROM l""",
)
def dehyphenate(rows: DataFrame) -> DataFrame:
    """The lines of each text with split words joined; a text's lines are one row's worth."""
    rows = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return rows.select("doc_id", F.array_join(rw.dehyphenated(F.col("l.line")), "|").alias("text"))


SCALPEL = Fixture("scalpel", "id int, text string", [(1, "A vast, profound river."), (2, "Vast fields lie here, staggering."), (3, "Plain words.")])
PALETTE = {"vast": "wide", "staggering": "great"}
NEW = "(CASE bare " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in PALETTE.items()) + " ELSE '' END)"


@over(
    SCALPEL,
    SCALPEL_SENTS,
    rf""", e AS (SELECT id, unnest({words_sql("text")}) AS w, generate_subscripts({words_sql("text")}, 1) AS i FROM scalpel), b AS (SELECT *, lower(regexp_replace(w, '[^\p{{L}}]', '', 'g')) AS bare FROM e),
n AS (SELECT id, i, CASE WHEN list_contains({list_sql(lx.RESTRICTED)}, bare) THEN CASE WHEN regexp_matches(w, '^\p{{Lu}}') THEN upper({NEW}[1]) || {NEW}[2:] ELSE {NEW} END || regexp_extract(w, '[^\p{{L}}]*$', 0) ELSE w END AS w FROM b)
SELECT id, regexp_replace(regexp_replace(string_agg(w, ' ' ORDER BY i) FILTER (w <> ''), '\s+([.,!?;:])', '\1', 'g'), ',\s*,', ',', 'g') AS text FROM n GROUP BY id""",
)
def programmatic_cleanup(rows: DataFrame) -> DataFrame:
    """Restricted words replaced by the palette's or dropped."""
    palette = F.create_map(*(F.lit(x) for pair in PALETTE.items() for x in pair))
    tidy = F.regexp_replace(rw.replaced(F.col("text"), F.array(*map(F.lit, lx.RESTRICTED)), palette), r",\s*,", ",")
    return rows.select("id", tidy.alias("text"))


@over(
    SCALPEL,
    SCALPEL_SENTS,
    r""", c AS (SELECT id, text, list_extract(list_sort(list_transform(list_filter(range(1, length(text) + 1), lambda i: text[i] IN (',', ';')), lambda i: {'d': abs(i - length(text)::DOUBLE / 2), 'i': i})), 1).i AS i FROM scalpel),
s AS (SELECT id, text, i, regexp_replace(text[i + 1:], '^\s+|\s+$', '', 'g') AS rest FROM c)
SELECT id, CASE WHEN i IS NULL THEN [text] ELSE [text[1:i - 1] || '.', replace(upper(rest[1]), 'ẞ', 'SS') || rest[2:]] END AS parts FROM s""",
)
def forced_split(rows: DataFrame) -> DataFrame:
    return rows.select("id", rw.split_middle(F.col("text")).alias("parts"))


VARIANTS = Fixture("variants_raw", "id int, response string", [(1, "Here are some:\nVAR: The river rose.\nVAR: The rain fell."), (2, "1. First one here.\n2) Second one here.\n- Third one."), (3, "Only a plain text without marks")])
MARK = r"^(?:VAR:|\d+[.)]|[-*])\s*"


@over(
    VARIANTS,
    VARIANT_TURNS,
    rf""", l AS (SELECT id, response, list_transform(list_filter(string_split(response, chr(10)), lambda x: regexp_matches(x, '{MARK}')), lambda x: trim(regexp_replace(x, '{MARK}', ''))) AS v FROM variants_raw)
SELECT id, CASE WHEN len(v) > 0 THEN v ELSE [trim(response)] END AS variants FROM l""",
)
def parse_variants(rows: DataFrame) -> DataFrame:
    """Variants of a model's answer: marked lines, else the whole."""
    found = F.transform(F.filter(F.split("response", "\n"), lambda x: x.rlike(MARK)), lambda x: F.trim(F.regexp_replace(x, MARK, "")))
    return rows.select("id", F.when(F.size(found) > 0, found).otherwise(F.array(F.trim("response"))).alias("variants"))
