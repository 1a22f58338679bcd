"""Classifiers of sentences and paragraphs by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from . import text as tx


def rhetoric(c: Column) -> Column:
    """Rhetorical type; rules are tried in order and look for characters, not whole words."""

    def judge(x: Column) -> Column:
        low, s = x["low"], x["s"]
        first = F.lower(F.get(tx.words(s), F.lit(0)))
        return (
            F.when(F.coalesce(tx.strip(s), F.lit("")) == "", "UNKNOWN")
            .when(tx.has_any(low, lx.DESCRIPTIVE), "OBSERVATION")
            .when(tx.has_any(low, lx.DEFINITION), "DEFINITION")
            .when(first.isin(lx.IMPERATIVE), "IMPERATIVE")
            .when(tx.has_any(low, lx.ARGUMENT), "ARGUMENT")
            .otherwise("OBSERVATION")
        )

    return tx.let(c, lambda s: tx.let(F.struct(s.alias("s"), F.lower(s).alias("low")), judge))


def sentence_type(c: Column) -> Column:
    """QUESTION, CONDITIONAL or DECLARATIVE by how the sentence begins."""
    low = tx.strip(F.lower(c))
    return F.when(low.endswith("?") | tx.starts_any(low, lx.QUESTION_STARTS) | low.rlike(lx.WHEN_QUESTION), "QUESTION").when(low.startswith("when ") | low.rlike(lx.CONDITIONAL_START), "CONDITIONAL").otherwise("DECLARATIVE")


def skeleton_type(skeleton: Column, text: Column) -> Column:
    low = F.lower(skeleton)
    asks = skeleton.contains("?") | text.contains("?")
    return F.when(asks & (tx.strip(text).endswith("?") | tx.has_any(low, ["how", "why", "what", "when", "where", "who", "which"])), "RHETORICAL_QUESTION").when(tx.has_any(low, ["if", "when", "unless", "provided that", "in case"]), "CONDITIONAL").otherwise("DECLARATIVE")


def syntax_type(c: Column) -> Column:
    """Fragment, Compound, Complex or Simple, by counts of conjunctions among the tokens."""
    return tx.let(tx.tokens(c), syntax_of)


def syntax_of(t: Column) -> Column:
    """The same, of tokens."""
    return F.when(F.size(t) < 4, "Fragment").when(tx.among(t, lx.COORDINATORS) > 0, "Compound").when(tx.among(t, lx.SUBORDINATORS) > 0, "Complex").otherwise("Simple")


def sentiment(c: Column) -> Column:
    """Positive, Negative or Neutral, by words of either list per token against 0.05."""
    return tx.let(tx.tokens(c), sentiment_of)


def sentiment_of(t: Column) -> Column:
    """The same, of tokens."""
    score = (tx.among(t, lx.POSITIVE) - tx.among(t, lx.NEGATIVE)) / F.greatest(F.size(t), F.lit(1))
    return tx.let(score, lambda x: F.when(x >= 0.05, "Positive").when(x <= -0.05, "Negative").otherwise("Neutral"))


def moralizing(paragraph: Column) -> Column:
    """Whether the last sentence moralises and shows under three concrete marks (numbers, names inside the sentence)."""
    last = F.element_at(tx.sentences(paragraph), -1)
    t = tx.tokens(last)
    opens = F.get(t, F.lit(0)).isin(lx.MORAL_OPENERS)
    noun = tx.among(t, lx.MORAL_NOUNS) > 0
    names = F.size(F.filter(F.slice(tx.words(last), F.lit(2), F.greatest(F.size(tx.words(last)) - 1, F.lit(0))), lambda w: w.rlike("^[A-Z][a-z]"))) + F.size(F.filter(t, lambda w: w.rlike("^[0-9]+$")))
    return F.coalesce((opens | noun) & (names < 3), F.lit(False))


def length_category(n: Column) -> Column:
    return F.when(n < 10, "short").when(n < 20, "medium").otherwise("long")


def slot_type(n: Column) -> Column:
    return F.when(n < 15, "simple").when(n < 25, "moderate").otherwise("complex")
