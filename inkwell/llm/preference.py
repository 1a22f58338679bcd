"""Preference formatting: the common turns of a chosen and a rejected conversation once, and two masked completions.

DataFrame functions only. A turn is rendered as a role line, its text and an
end mark. The prompt is the longest prefix of turns, role and text alike, that
both conversations have; what follows is each one's completion. Masks are
spans of the completion, in characters, on which a loss is to be taken: the
texts of assistant turns with their end marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import clean

OPEN, CLOSE = "<|", "|>"
END = "<|end|>\n"
TRAINED = "assistant"


def dialogues(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order of turn (null first), role, text; null roles and texts count as empty ones."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = clean(conversations, "conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull())
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE + "\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t["role"]), t["text"], F.lit(END))), "")


def masks(turns: Column) -> Column:
    """begin:end of each trained stretch of the rendered turns, comma-joined."""
    kind = "array<string>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("out"))

    def step(a: Column, t: Column) -> Column:
        begin = a["at"] + F.length(head(t["role"]))
        end = begin + F.length(t["text"]) + len(END)
        span = F.array(F.concat_ws(":", begin.cast("string"), end.cast("string")))
        return F.struct(end.cast("long").alias("at"), F.when(t["role"] == TRAINED, F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

    return F.aggregate(turns, start, step, lambda a: F.array_join(a["out"], ","))


def common(a: Column, b: Column) -> Column:
    """How many turns the two begin with alike."""
    most = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), most), F.slice(b, F.lit(1), most), lambda x, y: x == y)
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, ok: F.struct((s["n"] + F.when(s["go"] & ok, 1).otherwise(0)).alias("n"), (s["go"] & ok).alias("go")), lambda s: s["n"])


def format_pairs(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per pair (pair_id, chosen_id, rejected_id): prefix_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, status.

    status: ok; identical (no turn differs); short (one is a prefix of the
    other, so its completion is empty); unpaired (a side is missing: its
    completion is null and all turns of the other are prompt-free completion).
    Each conversation joins by its id, so no pair is built by comparing
    conversations with each other. Rows of pairs without either are left out.
    """
    every = dialogues(conversations)
    left = every.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("_c"))
    right = every.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("_r"))
    both = pairs.select("pair_id", "chosen_id", "rejected_id").join(left, "chosen_id", "left").join(right, "rejected_id", "left").where(F.col("_c").isNotNull() | F.col("_r").isNotNull())
    return finish(both)


def finish(both: DataFrame) -> DataFrame:
    n = F.when(F.col("_c").isNotNull() & F.col("_r").isNotNull(), common(F.col("_c"), F.col("_r"))).otherwise(0)
    cut = both.withColumn("prefix_turns", n)

    def rest(turns: str) -> Column:
        return F.slice(turns, F.col("prefix_turns") + 1, F.greatest(F.size(turns) - F.col("prefix_turns"), F.lit(0)))

    parts = cut.withColumn("_a", rest("_c")).withColumn("_b", rest("_r"))
    status = F.when(F.col("_c").isNull() | F.col("_r").isNull(), "unpaired").when((F.size("_a") == 0) & (F.size("_b") == 0), "identical").when((F.size("_a") == 0) | (F.size("_b") == 0), "short").otherwise("ok")
    prompt = rendered(F.slice(F.coalesce("_c", "_r"), F.lit(1), F.col("prefix_turns")))
    return parts.select("pair_id", "chosen_id", "rejected_id", "prefix_turns", prompt.alias("prompt"), rendered(F.col("_a")).alias("chosen"), rendered(F.col("_b")).alias("rejected"), masks(F.col("_a")).alias("chosen_mask"), masks(F.col("_b")).alias("rejected_mask"), status.alias("status"))


def paired_by_id(conversations: DataFrame) -> DataFrame:
    """Pairs conversations 2k (chosen) and 2k + 1 (rejected): one shuffle by conversation, one by pair."""
    every = dialogues(conversations)
    key = F.floor(F.col("conv_id") / 2).cast("long")
    left = every.where("conv_id % 2 = 0").select(key.alias("pair_id"), F.col("conv_id").alias("chosen_id"), F.col("turns").alias("_c"))
    right = every.where("conv_id % 2 <> 0").select(key.alias("pair_id"), F.col("conv_id").alias("rejected_id"), F.col("turns").alias("_r"))
    return finish(left.join(right, "pair_id", "full"))


SQL = r"""
WITH turns AS (SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
paired AS (SELECT coalesce(c.k, r.k) AS pair_id, c.conv_id AS chosen_id, r.conv_id AS rejected_id, c.t AS c, r.t AS r
  FROM (SELECT CAST(floor(conv_id / 2.0) AS BIGINT) AS k, * FROM turns WHERE conv_id % 2 = 0) c FULL JOIN (SELECT CAST(floor(conv_id / 2.0) AS BIGINT) AS k, * FROM turns WHERE conv_id % 2 <> 0) r ON c.k = r.k),
counted AS (SELECT *, CASE WHEN c IS NULL OR r IS NULL THEN 0 ELSE coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] <> r[i])) - 1, least(len(c), len(r))) END AS n FROM paired),
rest AS (SELECT *, c[n + 1:] AS a, r[n + 1:] AS b FROM counted),
flat AS (SELECT pair_id, side, i, x.role AS role, x.text AS text FROM (
  SELECT pair_id, 'a' AS side, unnest(a) AS x, unnest(range(1, len(a) + 1)) AS i FROM rest UNION ALL SELECT pair_id, 'b', unnest(b), unnest(range(1, len(b) + 1)) FROM rest)),
placed AS (SELECT *, sum(length('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10))) OVER (PARTITION BY pair_id, side ORDER BY i) AS stop FROM flat),
masks AS (SELECT pair_id, side, string_agg((stop - length(text) - 8)::BIGINT || ':' || stop::BIGINT, ',' ORDER BY i) FILTER (role = 'assistant') AS m FROM placed GROUP BY pair_id, side)
SELECT rest.pair_id, chosen_id, rejected_id, CAST(n AS INT) AS prefix_turns,
  array_to_string(list_transform(coalesce(c, r)[1:n], lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), '') AS prompt,
  CASE WHEN c IS NOT NULL THEN array_to_string(list_transform(a, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), '') END AS chosen,
  CASE WHEN r IS NOT NULL THEN array_to_string(list_transform(b, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), '') END AS rejected,
  CASE WHEN c IS NOT NULL THEN coalesce(ma.m, '') END AS chosen_mask, CASE WHEN r IS NOT NULL THEN coalesce(mb.m, '') END AS rejected_mask,
  CASE WHEN c IS NULL OR r IS NULL THEN 'unpaired' WHEN len(a) = 0 AND len(b) = 0 THEN 'identical' WHEN len(a) = 0 OR len(b) = 0 THEN 'short' ELSE 'ok' END AS status
FROM rest LEFT JOIN masks ma ON ma.pair_id = rest.pair_id AND ma.side = 'a' LEFT JOIN masks mb ON mb.pair_id = rest.pair_id AND mb.side = 'b'
"""
