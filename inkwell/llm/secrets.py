"""Secret scans: known shapes of secrets, and sliding-window Shannon entropy over candidate strings.

DataFrame functions only. A pattern's matches and the text between them
alternate, so their lengths add up to the places of the matches, in code
points. Entropy is followed along a candidate string by counts that change by
one symbol coming in and one going out; n log2 n is taken from a table of
whole millionths, so sums are exact and do not drift.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import boxed, clean, unboxed

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: As long runs are matched whole, asking for the least length in the pattern drops just the short ones.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
#: Candidates for the entropy scan: long runs of these symbols with a digit and a letter among them.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Least entropy in bits of a window, by character class.
LEAST_BITS = {"entropy_hex": 3.0, "entropy_base64": 3.9}
HEX_ONLY = r"^[0-9A-Fa-f]+$"
#: What is no secret is cut out of a candidate, and the rest is scanned: the documented example key, UUIDs, dates and times, and
#: pieces between / _ = - that hold a word of documentation or an alphabet. Greedy classes are possessive or bounded by a
#: look-behind, so that Java's matcher reads a run once; SQL has the same without, as its matcher never goes back.
CUT = (
    r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY|[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}|[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-]",
    r"(?i:example|sample|placeholder|changeme|xxxx|abcdefghijklm|0123456789abcdef)",
)
CUT_SQL = f"{CUT[0]}|[A-Za-z0-9+]*{CUT[1]}[A-Za-z0-9+]*"
CUT_JAVA = f"{CUT[0]}|(?<![A-Za-z0-9+])[A-Za-z0-9+]*?{CUT[1]}[A-Za-z0-9+]*+"
#: Words joined to a path, with a number: no secret as a whole.
PATH_SQL = r"^[a-z]+(?:[/_=-][a-z]+)*[/_=-]?[0-9]{1,4}$"
PATH_JAVA = PATH_SQL.replace(")*", ")*+")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
SPAN = "array<struct<start: long, rank: int, end: long>>"


def prefixed(items: Column, value: Callable[[Column], Column], plus: Callable[[Column, Column], Column], per: int = 256) -> Column:
    """Each item with what the values of all earlier ones come to, as (item, before), starting from 0.

    An array that grows by one costs its length each time, so items go by
    blocks of `per`: first the blocks' values, then the items of each block.
    """
    zero = F.lit(0).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / per).cast("int") - 1, F.lit(0))), lambda i: F.slice(items, i * per + 1, per))
    sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: plus(a, value(x)).cast("long")))
    first = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
    starts = F.aggregate(sums, first, lambda a, x: F.struct(plus(a["at"], x).cast("long").alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def inside(block: Column, start: Column) -> Column:
        own = F.aggregate(F.slice(block, F.lit(1), F.greatest(F.size(block) - 1, F.lit(0))), F.struct(start.alias("at"), F.array(start).alias("out")), lambda a, x: F.struct(plus(a["at"], value(x)).cast("long").alias("at"), F.concat(a["out"], F.array(plus(a["at"], value(x)).cast("long"))).alias("out")), lambda a: a["out"])
        return F.zip_with(block, own, lambda x, at: F.struct(x.alias("item"), at.alias("before")))

    return F.filter(F.flatten(F.zip_with(blocks, starts, inside)), lambda x: x["item"].isNotNull())


def add(a: Column, b: Column) -> Column:
    return a + b


def found(text: Column, pattern: str, rank: int, least_value: int = 0) -> Column:
    """Spans (start, rank, end) of the pattern's matches, left to right; with least_value, of those whose second group is so long."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least_value else whole
    matches = F.zip_with(whole, value, lambda m, v: F.struct(F.length(m).alias("n"), (F.length(v) >= least_value).alias("ok")))
    steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)), matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), m["n"].alias("n"), m["ok"].alias("ok")))
    kept = F.filter(prefixed(steps, lambda s: s["gap"] + s["n"], add), lambda x: x["item"]["ok"])
    spans = F.transform(kept, lambda x: F.struct((x["before"] + x["item"]["gap"]).alias("start"), F.lit(rank).alias("rank"), (x["before"] + x["item"]["gap"] + x["item"]["n"]).alias("end")))
    return F.when(text.rlike(pattern), spans.cast(SPAN)).otherwise(F.array().cast(SPAN))


def candidates(text: Column) -> Column:
    """Candidate strings with the place where each begins."""
    whole = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    steps = F.zip_with(F.slice(F.split(text, CANDIDATE, -1), F.lit(1), F.size(whole)), whole, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    kind = "array<struct<start: long, value: string>>"
    placed = F.transform(prefixed(steps, lambda s: s["gap"] + F.length(s["m"]), add), lambda x: F.struct((x["before"] + x["item"]["gap"]).alias("start"), x["item"]["m"].alias("value")))
    return F.when(text.rlike(CANDIDATE), placed.cast(kind)).otherwise(F.array().cast(kind))


def hot_range(value: Column, window: int = WINDOW) -> Column:
    """(first, last): where in the string its first and its last window of enough entropy begins; null if it has none."""
    bits = {k: round((math.log2(window) - b) * window * 1e6) for k, b in LEAST_BITS.items()}
    most = F.when(value.rlike(HEX_ONLY), F.lit(bits["entropy_hex"])).otherwise(F.lit(bits["entropy_base64"]))
    table = F.array(*(F.lit(round(c * math.log2(c) * 1e6) if c else 0) for c in range(window + 1)))
    symbols = F.regexp_extract_all(value, F.lit("."), F.lit(0))
    goes = F.concat(F.array_repeat(F.lit("").cast("string"), window), symbols)
    def place(symbol: Column) -> Column:
        return F.instr(F.lit(SYMBOLS), symbol) - 1

    both = F.zip_with(symbols, goes, lambda come, go: F.struct(place(come).alias("come"), F.when(go != "", place(go)).otherwise(-1).alias("go")))
    steps = F.slice(both, F.lit(1), F.length(value))
    start = F.struct(F.lit(0).alias("i"), F.array_repeat(F.lit(0), len(SYMBOLS)).alias("n"), F.lit(0).alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def step(a: Column, s: Column) -> Column:
        return F.struct((a["i"] + 1).alias("i"), counted(a, s).alias("n"), moved(a, s).alias("sum"), F.when(hot(a, s), F.coalesce(a["first"], a["i"] + 1 - window)).otherwise(a["first"]).alias("first"), F.when(hot(a, s), a["i"] + 1 - window).otherwise(a["last"]).alias("last"))

    def counted(a: Column, s: Column) -> Column:
        return F.transform(a["n"], lambda n, k: n + F.when(k == s["come"], 1).otherwise(0) - F.when(k == s["go"], 1).otherwise(0))

    def weight(n: Column) -> Column:
        return F.get(table, n)

    def moved(a: Column, s: Column) -> Column:
        come, go = F.get(a["n"], s["come"]), F.get(a["n"], s["go"])
        change = F.when(s["go"] < 0, weight(come + 1) - weight(come)).otherwise(weight(come + 1) - weight(come) + weight(go - 1) - weight(go))
        return a["sum"] + F.when(s["come"] == s["go"], 0).otherwise(change)

    def hot(a: Column, s: Column) -> Column:
        return (a["i"] + 1 >= window) & (moved(a, s) <= most)

    return F.aggregate(steps, start, step, lambda a: F.when(a["first"].isNotNull(), F.struct(a["first"].alias("first"), a["last"].alias("last"))))


def parts(candidate: Column, cut: str = CUT_JAVA, path: str = PATH_JAVA) -> Column:
    """What the allow-list leaves of a candidate (start, value), as far as it can be a secret."""
    value = candidate["value"]
    gone = F.transform(F.regexp_extract_all(value, F.lit(cut), F.lit(0)), F.length)
    left = F.split(value, cut, -1)
    steps = F.transform(left, lambda x, i: F.struct(x.alias("m"), (F.length(x) + F.coalesce(F.get(gone, i), F.lit(0))).alias("n")))
    placed = F.transform(prefixed(steps, lambda s: s["n"], add), lambda x: F.struct((candidate["start"] + x["before"]).cast("long").alias("start"), x["item"]["m"].alias("value")))
    return F.filter(placed, lambda c: (F.length(c["value"]) >= WINDOW) & c["value"].rlike("[A-Za-z]") & c["value"].rlike("[0-9]") & ~c["value"].rlike(path))


def entropy_spans(text: Column, window: int = WINDOW) -> Column:
    """Spans of the windows with enough entropy: in each part of a candidate that the allow-list leaves, from its first to its last."""
    some = F.flatten(F.transform(candidates(text), lambda c: parts(c)))
    ranged = F.transform(some, lambda c: F.struct(c["start"].alias("start"), F.when(c["value"].rlike(HEX_ONLY), 3).otherwise(4).alias("rank"), hot_range(c["value"], window).alias("hot")))
    warm = F.filter(ranged, lambda c: c["hot"].isNotNull())
    return F.transform(warm, lambda c: F.struct((c["start"] + c["hot"]["first"]).cast("long").alias("start"), c["rank"].alias("rank"), (c["start"] + c["hot"]["last"] + window).cast("long").alias("end")))


def scanned(docs: DataFrame) -> DataFrame:
    """Adds base and added, arrays of spans (start, rank, end); rank is the kind's place in KINDS. A null text is an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(F.concat(found(text, ASSIGN, 0, LEAST_VALUE), found(text, ACCESS, 1), found(text, HEX, 2)))
    return docs.withColumn("base", base).withColumn("added", entropy_spans(text))


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy for every row; repeated rows are kept, a null doc_id stays null."""
    marked = scanned(clean(docs, "doc_id", "text"))

    def number(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    return marked.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_entropy"))


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by the mask, spans that overlap by one; n_chars follows the text. Other texts are unchanged."""
    spans = F.array_sort(F.concat("base", "added"))
    # a span that begins where all before it have ended masks the text between; others lie in one that was masked
    fresh = F.filter(prefixed(spans, lambda s: s["end"], F.greatest), lambda x: x["item"]["start"] >= x["before"])
    parts = F.transform(fresh, lambda x: F.concat(F.substring("text", (x["before"] + 1).cast("int"), (x["item"]["start"] - x["before"]).cast("int")), F.lit(mask)))
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    rest = F.concat(F.array_join(parts, ""), F.substring("text", (last + 1).cast("int"), F.lit(2**31 - 1)))
    marked = scanned(boxed(docs, "text"))
    out = unboxed(marked.withColumn("text", F.when((F.size("base") > 0) | (F.size("added") > 0), rest).otherwise(F.col("text"))), docs.columns, "text")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def _sql() -> str:
    """The scan in DuckDB's SQL: runs are taken whole and filtered, and every window's entropy is counted anew."""

    def quoted(x: str) -> str:
        return x.replace("'", "''")

    def spans(name: str, pattern: str, rank: int, test: str = "true") -> str:
        p = quoted(pattern)
        return f"""{name} AS (SELECT doc_id, row, list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'start': CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT), 'rank': {rank}, 'value': m[i], 'group2': w[i]}}), lambda s: {test}) AS z
  FROM (SELECT doc_id, row, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}') AS m, {"regexp_extract_all(text, '" + p + "', 2)" if rank == 0 else "regexp_extract_all(text, '" + p + "')"} AS w FROM d))"""

    whole = f"length(s.value) >= {WINDOW} AND regexp_matches(s.value, '[A-Za-z]') AND regexp_matches(s.value, '[0-9]') AND NOT regexp_matches(s.value, '{PATH_SQL}')"
    weight = "list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: CAST(round((length(w) - length(replace(w, c, ''))) * log2(length(w) - length(replace(w, c, ''))) * 1000000) AS BIGINT)))"
    bits = {k: round((math.log2(WINDOW) - b) * WINDOW * 1e6) for k, b in LEAST_BITS.items()}
    shown = "array_to_string(list_transform(list_sort({x}), lambda s: ['assign', 'access', 'hex', 'entropy_hex', 'entropy_base64'][s.rank + 1] || ':' || s.start || ':' || s.stop), ',')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
{spans("a0", ASSIGN, 0, f"length(s.group2) >= {LEAST_VALUE}")},
{spans("a1", ACCESS, 1)},
{spans("a2", HEX, 2)},
{spans("a4", "[A-Za-z0-9+/_=-]{20,}", 3, "regexp_matches(s.value, '[A-Za-z]') AND regexp_matches(s.value, '[0-9]')")},
cuts AS (SELECT doc_id, row, list_transform(z, lambda s: {{'start': s.start, 'g': string_split_regex(s.value, '{CUT_SQL}'), 'm': regexp_extract_all(s.value, '{CUT_SQL}')}}) AS y FROM a4),
a3 AS (SELECT doc_id, row, list_filter(flatten(list_transform(y, lambda c: list_transform(range(1, len(c.g) + 1), lambda i: {{'start': CAST(c.start + coalesce(list_sum(list_transform(c.g[1:i - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(c.m[1:i - 1], lambda x: length(x))), 0) AS BIGINT), 'rank': 3, 'value': c.g[i]}}))), lambda s: {whole}) AS z FROM cuts),
base AS (SELECT a0.doc_id, a0.row, list_transform(list_concat(a0.z, list_concat(a1.z, a2.z)), lambda s: {{'start': s.start, 'rank': s.rank, 'stop': CAST(s.start + length(s.value) AS BIGINT)}}) AS b, a3.z AS c FROM a0 JOIN a1 USING (row) JOIN a2 USING (row) JOIN a3 USING (row)),
warm AS (SELECT doc_id, row, b, list_transform(c, lambda s: {{'start': s.start, 'rank': CASE WHEN regexp_matches(s.value, '{HEX_ONLY}') THEN 3 ELSE 4 END, 'hot': list_filter(range(0, length(s.value) - {WINDOW - 1}), lambda i: list_extract(list_transform([s.value[i + 1:i + {WINDOW}]], lambda w: {weight}), 1) <= CASE WHEN regexp_matches(s.value, '{HEX_ONLY}') THEN {bits["entropy_hex"]} ELSE {bits["entropy_base64"]} END)}}) AS c FROM base),
found AS (SELECT doc_id, b, list_transform(list_filter(c, lambda s: len(s.hot) > 0), lambda s: {{'start': CAST(s.start + list_min(s.hot) AS BIGINT), 'rank': s.rank, 'stop': CAST(s.start + list_max(s.hot) + {WINDOW} AS BIGINT)}}) AS e FROM warm)
SELECT doc_id, len(list_filter(b, lambda s: s.rank = 0)) AS n_assign, len(list_filter(b, lambda s: s.rank = 1)) AS n_access, len(list_filter(b, lambda s: s.rank = 2)) AS n_hex, sha256({shown.format(x="b")}) AS base_sha256, {shown.format(x="list_concat(b, e)")} AS spans, len(e) AS n_entropy FROM found"""


SQL = _sql()
