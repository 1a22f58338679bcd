"""The structure of a text as columns: marks, clauses, voice, templates by position, pair scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import compare as cp
from . import lexicon as lx
from . import text as tx

# Clause words and shapes of gibberish.
CLAUSES = ["and", "or", "but", "because", "since", "while", "when", "if", "that", "which", "who"]
GIBBERISH = [r"(?i)^It\s+is\s+\w+\s+the\s+\w+\s+is\s+\w+", r"(?i)^It\s+is\s+\w+\s+the\s+\w+\s+\w+\s+\w+", r"(?i)\b\w+\s+is\s+\w+\s+is\s+\w+"]


def clauses(c: Column) -> Column:
    """Clause words and one more."""
    return tx.among(tx.tokens(c), CLAUSES) + 1


def complexity(c: Column) -> Column:
    n = clauses(c)
    return F.when(n == 1, "simple").when(n == 2, "compound").otherwise("complex")


def mark_pattern(c: Column) -> Column:
    """Which kinds of marks a text has, in fixed order."""
    kinds = [("commas", c.contains(",")), ("dashes", c.contains("—") | c.contains("-")), ("semicolons", c.contains(";")), ("parentheses", c.contains("(") & c.contains(")")), ("asterisks", c.contains("*"))]
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in kinds)))


def passive_voice(c: Column) -> Column:
    """passive where a form of be before a word in -ed is more frequent than such a word before a determiner."""

    def judge(pairs: Column) -> Column:
        passive = F.size(F.filter(pairs, lambda g: g.rlike(r"^(is|are|was|were|been|being) \S+ed$")))
        active = F.size(F.filter(pairs, lambda g: g.rlike(r"^\S+ed (the|a|an|this|that|these|those)$")))
        return F.when(passive > active, "passive").otherwise("active")

    return tx.let(tx.grams(tx.tokens(c), 2), judge)


def sane(c: Column) -> Column:
    """Whether a candidate is no gibberish."""
    out = F.coalesce(tx.strip(c), F.lit("")) != ""
    for p in GIBBERISH:
        out = out & ~tx.strip(c).rlike(p)
    return F.coalesce(out, F.lit(False))


def variation(lengths: Column) -> Column:
    """High, Moderate or Low spread of slot lengths; under two slots it is Low."""

    def judge(xs: Column) -> Column:
        mean = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)
        spread = tx.let(mean, lambda m: F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(xs)) / m)
        return F.when((F.size(xs) < 2) | (mean == 0), "Low").when(spread > 0.4, "High").when(spread < 0.15, "Low").otherwise("Moderate")

    return tx.let(lengths, judge)


def same_structure(target: Column, actual: Column) -> Column:
    """Tags of about the same number that agree by place, coarsely, in three of five."""
    coarse = lambda tags: F.transform(F.filter(tags, lambda t: ~t.isin(".", ",", "!", "?", ";", ":")), lambda t: F.when(t.rlike("^(NN|VB|JJ|DT|IN)"), F.substring(t, 1, 2)).otherwise(t))
    a, b = coarse(target), coarse(actual)
    hits = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: F.coalesce(x, F.lit(False))))
    return (F.abs(F.size(a) - F.size(b)) <= 2) & (hits / F.greatest(F.size(a), F.size(b), F.lit(1)) >= 0.6)


def fixed_anchors(template: Column) -> Column:
    """What stands between a template's placeholders."""
    return tx.full(F.split(template, r"\[(?:NP|VP|ADJ|ADV)\]"))


def reference_text(c: Column) -> Column:
    """Without a leading name tag and a leading citation number."""
    return tx.strip(F.regexp_replace(F.regexp_replace(tx.strip(c), r"^[A-Z][a-z]+:\s*", ""), r"^\[?\d+\]?\.?\s+", ""))


def compressed(plan: Column, repetition: Column, sentences: Column, threshold: int = 5) -> Column:
    """Under much repetition, splits become rewrites, and rewrites for repetition merge with the next sentence where there is one."""

    def one(p: Column) -> Column:
        action = F.when(p["action"] == "split", "rewrite").when((p["action"] == "rewrite") & F.lower(p["reason"]).contains("repetition") & (p["at"] < sentences), "merge_with_next").otherwise(p["action"])
        return F.struct(action.alias("action"), p["at"].alias("at"), p["reason"].alias("reason"))

    return F.when((repetition >= threshold) & (sentences >= 3), F.transform(plan, one)).otherwise(plan)


def raw_score(recall: Column, adherence: Column, floor: float = 0.01) -> Column:
    """Half recall, half adherence, never below the floor."""
    return F.greatest(F.lit(floor), 0.5 * recall + 0.5 * adherence)


def style_alignment(own: Column, author: Column, density: Column, staccato: Column) -> Column:
    """Likeness to an author's vector less staccato, mixed with the lexicon's density and scaled by staccato."""
    like = F.greatest(F.lit(0.0), cp.cosine(own, author) - 0.3 * staccato)
    return (0.7 * like + 0.3 * density) * (1.0 - 0.2 * staccato)


def evaluated(original: Column, generated: Column) -> Column:
    """(passed, score, reason): a copy, an empty text, lost citations, low recall and new names stop it in this order; then recall and precision decide."""
    r, p = cp.recall(original, generated), cp.precision(original, generated, F.array().cast("array<string>"))
    kept = cp.preservation(original, generated)["score"]
    reason = (
        F.when(tx.strip(generated) == "", "empty")
        .when(F.lower(tx.strip(original)) == F.lower(tx.strip(generated)), "copy")
        .when(kept < 1.0, "citations")
        .when(r < 0.5, "recall")
        .when(F.size(cp.invented(original, generated)) > 0, "invented")
        .otherwise("ok")
    )
    score = F.when(reason == "ok", (2 * r + p) / 3).otherwise(0.0)
    return F.struct((reason == "ok").alias("passed"), F.round(score, 6).alias("score"), reason.alias("reason"))


def stops_of(c: Column) -> Column:
    """Distinct function words of a text, sorted."""
    return F.array_sort(F.array_distinct(F.filter(tx.tokens(c), lambda w: w.isin(lx.STOPS))))
