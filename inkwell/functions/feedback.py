"""Answers and verdicts of models: reading them, judging them, turning them into plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from . import text as tx

# Words that mark an edit or ask for a rewrite.
EDITS = ["remove", "delete", "cut", "replace", "change", "substitute", "swap", "insert", "add", "fix", "correct"]
REWRITES = ["rewrite", "restructure", "reorganize", "rephrase", "completely", "entire", "whole", "match the structure", "follow the pattern", "adopt the style", "emulate", "mirror"]


def outermost(c: Column) -> Column:
    """From the first brace to the last one that closes, or from the first bracket so, whichever begins first; empty if neither is there."""
    ways = [F.struct(F.instr(c, a).alias("at"), F.regexp_extract(c, rf"(?s)^[^\{a}]*+(\{a}.*\{b})", 1).alias("found")) for a, b in ("{}", "[]")]
    return F.coalesce(F.array_min(F.filter(F.array(*ways), lambda x: x["found"] != ""))["found"], F.when(c.isNotNull(), F.lit("")))


def json_text(c: Column) -> Column:
    """The outermost object or list in an answer, code fences and chatter left out; single quotes, trailing commas and Python's words repaired."""
    bare = F.regexp_replace(c, r"```(?:json)?", "")
    found = outermost(bare)
    whole = F.try_parse_json(found).isNotNull()
    words = F.regexp_replace(F.regexp_replace(F.regexp_replace(found, r"\bTrue\b", "true"), r"\bFalse\b", "false"), r"\bNone\b", "null")
    repaired = F.regexp_replace(F.regexp_replace(words, r",\s*([}\]])", "$1"), r"'([^']*)'", '"$1"')
    return F.when(found == "", None).when(whole, found).when(F.try_parse_json(repaired).isNotNull(), repaired)


def json_list(c: Column) -> Column:
    """The first list of an answer as non-empty strings; empty if there is none."""
    return F.filter(F.coalesce(F.from_json(F.regexp_extract(c, r"^[^\[]*+(\[[^\]]*+\])", 1), "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(x) != "")


def issues(c: Column) -> Column:
    """Numbered items of a verdict, else its sentences, else the whole."""
    numbered = F.transform(F.regexp_extract_all(c, F.lit(r"(?m)^[ \t\x0B\f]*+\d++[.)]\s*(.+)$"), F.lit(1)), F.trim)
    parts = tx.sentences(c)
    return F.when(F.size(numbered) > 0, numbered).when(F.size(parts) > 0, parts).otherwise(F.array(c))


def edits_only(c: Column) -> Column:
    """Whether a verdict names an edit and asks for no rewrite."""
    return tx.has_any(F.lower(c), EDITS) & ~tx.has_any(F.lower(c), REWRITES)


def quoted(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"'([^']+)'"), F.lit(1))


def false_alarm(verdict: Column, generated: Column) -> Column:
    """Whether all quoted words said to be invented names stand in lower case in the output."""
    q = quoted(verdict)
    return (F.size(q) > 0) & F.forall(q, lambda w: generated.contains(F.lower(w)) & ~generated.contains(w))


def false_omission(verdict: Column, generated: Column) -> Column:
    """Whether something said to be missing is there, whole or by four fifths of its words."""

    def there(known: Column) -> Column:
        return F.exists(quoted(verdict), lambda p: F.lower(generated).contains(F.lower(p)) | (F.size(F.filter(tx.tokens(p), lambda w: F.array_contains(known, w))) / F.greatest(F.size(tx.tokens(p)), F.lit(1)) >= 0.8))

    return tx.let(tx.tokens(generated), there)


def minor_omission(verdict: Column) -> Column:
    """Whether all that is said to be missing are function words."""
    q = quoted(verdict)
    return (F.size(q) > 0) & F.forall(q, lambda w: F.lower(w).isin(lx.STOPS))


def slots_text(slots: Column) -> Column:
    """Slots (target_len, type) as lines."""
    return F.array_join(F.transform(slots, lambda s, i: F.concat(F.lit("Slot "), (i + 1).cast("string"), F.lit(": "), s["target_len"].cast("string"), F.lit(" words ("), s["type"], F.lit(")"))), "\n")


def diagnosis(recall: Column, fluency: Column) -> Column:
    """What to do with a draft next."""
    return F.when(recall < 0.8, "semantic_injection").when(fluency < 0.7, "grammar_repair").otherwise("style_polish")


def bucket(n: Column) -> Column:
    return F.when(n <= 2, 2).when(n <= 4, 4).when(n <= 7, 6).otherwise(10)


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("long")


def split_point(c: Column) -> Column:
    """Where a long sentence can be cut, the first kind that it has: semicolon, colon, comma with conjunction, relative pronoun."""
    return F.when(c.contains(";"), "semicolon").when(c.contains(":"), "colon").when(F.lower(c).rlike(r", (and|but|or|nor|yet|so) "), "conjunction").when(F.lower(c).rlike(r"[ ,](which|who|whom|whose|that) "), "relative").otherwise("none")


def directives(own: Column, target: Column) -> Column:
    """What to change where a source's rates (long, marks, person) fall short of the target's."""
    rules = [("long", 0.05, "Write longer sentences."), ("marks", 0.05, "Use more commas and semicolons."), ("person", 0.03, "Speak in the first person.")]
    return F.array_compact(F.array(*(F.when(target[k] - own[k] > by, F.lit(say)) for k, by, say in rules)))


def without_tail(scores: Column, least: float = 0.25) -> Column:
    """How many slots stay when trailing ones below the threshold are dropped."""
    return F.coalesce(F.array_max(F.filter(F.transform(scores, lambda s, i: F.when(s >= least, i + 1)), lambda x: x.isNotNull())), F.lit(0))


def dealt(parts: Column, slots: int) -> Column:
    """Parts in order over a number of slots, evenly, the last one taking the rest."""

    def cut(xs: Column) -> Column:
        each = F.greatest(F.lit(1), F.floor(F.size(xs) / slots).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.array_join(F.when(i == slots - 1, F.slice(xs, i * each + 1, F.greatest(F.size(xs) - i * each, F.lit(0)))).otherwise(F.slice(xs, i * each + 1, each)), ". "))

    return tx.let(parts, cut)


def zipped(skeletons: Column, inputs: Column) -> Column:
    """Each input with its skeleton, the last one serving the rest."""
    return F.transform(inputs, lambda x, i: F.concat(F.coalesce(F.get(skeletons, i), F.element_at(skeletons, -1)), F.lit(" <- "), x))


def cycled(items: Column, n: int) -> Column:
    """Cut to n items, or repeated in turn up to n."""
    return F.slice(F.flatten(F.array_repeat(items, n)), 1, n)


def repaired(sentences: Column, plan: Column) -> Column:
    """Sentences after a plan's deletions and merges with the next one (action, at: 1-based), in order; what points past the end is skipped."""

    def step(a: Column, p: Column) -> Column:
        n = F.size(a)
        before, here, after = F.slice(a, F.lit(1), p["at"] - 1), F.get(a, p["at"] - 1), F.get(a, p["at"])
        rest = F.slice(a, p["at"] + 1, F.greatest(n - p["at"], F.lit(0)))
        merged = F.concat(before, F.array(F.concat_ws(" ", here, after)), F.slice(a, p["at"] + 2, F.greatest(n - p["at"] - 1, F.lit(0))))
        return F.when(p["at"] > n, a).when(p["action"] == "delete", F.concat(before, rest)).when((p["action"] == "merge_with_next") & after.isNotNull(), merged).otherwise(a)

    return F.aggregate(plan, sentences, step)
