"""Deterministic gates over sentences, paragraphs and templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from . import text as tx

# How dialogue and fragments begin; case does not count.
DIALOGUE = [r"^(And|But|So|Then) [a-z]", r"^If you (could|can|see)", r"^Then came", r'^"?[A-Z][a-z]+:', r"^Concerning", r"^What (if|about)"]
SLOT = r"\[[^\]]+\]"
MAJOR = r"\[(?:NP|VP|CLAUSE|ADJ|ADV)(?:\s+[^\]]+)?\]"
MARK = r"[.,!?;:()\[\]{}'\"]"
EDGES = f"^{MARK}++|{tx.run(MARK)}$"


def most_repeated(items: Column) -> Column:
    """How often the most frequent item of a list occurs."""

    def widest(xs: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0))), lambda i: (i == 0) | (F.get(xs, i) != F.get(xs, i - 1)))
        runs = tx.let(starts, lambda at: F.transform(at, lambda i, k: F.coalesce(F.get(at, k + 1), F.size(xs)) - i))
        return F.when(F.size(xs) == 0, 0).when(F.size(F.array_distinct(xs)) == F.size(xs), 1).otherwise(F.array_max(runs))

    return tx.let(F.sort_array(items), widest)


def bare(word: Column) -> Column:
    """A word in lower case without marks at its edges."""
    return F.regexp_replace(F.lower(word), EDGES, "")


def valid_template(c: Column) -> Column:
    """Whether a sentence can serve as a structural template; without a parser, six words at least stand for a verb and subject."""
    w, low, s = tx.words(c), F.lower(c), tx.strip(c)
    bad = [
        F.size(w) < 6,
        ~F.lower(c).rlike("[aeiouy]"),
        tx.starts_any(F.lower(s), lx.NAVIGATION_STARTS),
        *(c.rlike("(?i)" + p) for p in DIALOGUE),
        ~s.rlike(r"[.!?\"']$"),
        s.rlike(r"^\[?\d+\]?\.?\s*[A-Z]"),
        (F.upper(c) == c) & c.rlike("[A-Za-z]") & (F.size(w) < 10),
        most_repeated(tx.grams(F.transform(w, F.lower), 2)) > 3,
        tx.has_any(low, lx.NAVIGATION) & (F.size(w) < 12),
        (F.regexp_count(c, F.lit(r"\.")) > 3) & ~c.contains("..."),
    ]
    out = F.lit(False)
    for b in bad:
        out = out | F.coalesce(b, F.lit(True))
    return ~out


def complete(c: Column) -> Column:
    """Ends with a final mark and no dangling word, and each later full sentence before the last begins in upper case."""
    last = bare(F.element_at(tx.words(c), -1))
    parts = F.split(c, tx.run("[.!?]") + r"\s++")
    inner = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    started = F.forall(inner, lambda s: (F.size(tx.words(s)) < 3) | s.rlike(r"^\p{Lu}"))
    return F.coalesce(c.rlike(r"[.!?\"']$") & ~last.isin(lx.DANGLING) & started, F.lit(False))


def coherent(c: Column) -> Column:
    """No word salad: not too many capitalised words after the first."""
    w = tx.words(c)
    later = F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0)))
    upper = F.size(F.filter(later, lambda x: x.rlike(r"^\p{Lu}")))
    salad = F.size(F.filter(later, lambda x: x.rlike(r"^\p{Lu}") & ~F.lower(F.regexp_replace(x, f"^[.,!?;:]++|{tx.run('[.,!?;:]')}$", "")).isin(lx.CAPITAL_EXEMPT)))
    return ~(((F.size(w) > 5) & (upper / F.size(w) > 0.65)) | ((F.size(w) > 8) & (salad >= 8)))


def repetitive(c: Column, bigrams: int = 3, starts: int = 2) -> Column:
    """Too many equal word pairs, or too many sentences that begin alike."""
    pairs = tx.let(tx.words(F.lower(c)), lambda w: F.when(F.size(w) > 5, most_repeated(tx.grams(w, 2))).otherwise(0))

    def alike(parts: Column) -> Column:
        first = F.filter(F.transform(parts, lambda s: bare(F.get(tx.words(s), F.lit(0)))), lambda x: ~x.isin(lx.OPENER_EXEMPT))
        return F.when(F.size(parts) >= 3, tx.let(first, lambda x: F.when(F.size(x) >= 3, most_repeated(x)).otherwise(0))).otherwise(0)

    same = tx.let(tx.full(F.split(c, tx.run("[.!?]") + r"\s++")), alike)
    return F.struct((pairs > bigrams).alias("pairs"), (same > starts).alias("starts"))


def anchors(c: Column) -> Column:
    """Words of a template outside its slots that hold a letter or digit."""
    held, rest = tx.cut_at_last(c, "]")  # an open bracket without an end would be followed to the end of the text, again and again
    return F.size(F.filter(tx.words(F.concat(F.regexp_replace(held, SLOT, " "), rest)), lambda w: w.rlike(r"[\p{L}\p{N}]")))


def anchor_health(c: Column) -> Column:
    """(valid, anchors): long enough, two anchors, a slot, and not four fifths fixed."""
    n, slots = anchors(c), F.regexp_count(tx.cut_at_last(c, "]")[0], F.lit(SLOT))
    ok = (F.length(c) >= 20) & (n >= 2) & (slots > 0) & (n / (n + slots) < 0.8)
    return F.struct(ok.alias("valid"), F.when(F.length(c) < 20, 0).otherwise(n).cast("long").alias("anchors"))


def capacity(c: Column) -> Column:
    """Propositions a template holds: its slots by 1.5, one at least (halves go to the even number)."""
    return F.greatest(F.lit(1), F.bround(F.regexp_count(c, F.lit(MAJOR)) / 1.5).cast("int")).cast("long")


def length_ratio(a: Column, b: Column) -> Column:
    """Words of a by words of b; 1 where b has none."""
    n, m = F.size(tx.words(a)), F.size(tx.words(b))
    return F.when(m == 0, 1.0).otherwise(n / m)


def length_gate(ratio: Column, low: float = 0.5, high: float = 2.5) -> Column:
    return F.when(ratio < low, "meaning").when(ratio > high, "structure").otherwise("pass")


def length_class(ratio: Column) -> Column:
    very = (ratio < 0.5) | (ratio > 2.0)
    return F.when(very, "very_different").when((ratio < 0.67) | (ratio > 1.5), "moderate").otherwise("similar")


def accepted(recall: Column, precision: Column, fluency: Column, overall: Column, source_words: Column, words: Column, threshold: float = 0.9) -> Column:
    """Acceptance of a candidate: not too short, fluent, full recall or a high score, and precise."""
    return F.when(words < 0.5 * source_words, "too_short").when(F.coalesce(fluency, F.lit(1.0)) < 0.7, "not_fluent").when((recall < 1.0) & (overall < threshold), "low_score").when(precision >= 0.8, "accepted").otherwise("imprecise")
