"""Subject, verb and object of each clause, by one fold over a sentence's tagged words with a stack of open clauses.

A relative pronoun behind a noun opens a clause about that noun, a
subordinator one without a subject; both push the clause at hand. A second verb,
or a nominative pronoun behind a verb, ends the clause and goes back to what
was pushed. Nouns behind a preposition belong to no one, but behind "by" in a
passive clause one is the agent; there subject and object change places.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import annotate as an
from . import lexicon as lx
from . import text as tx

RELATIVE = ["who", "whom", "which", "that"]
NOMINATIVE = ["i", "we", "he", "she", "they"]
NOUNS = ["NOUN", "PRON", "NUM"]
PARTICIPLE = "(ed|en|own|ung|uilt|ade|aid)$"
FRAME = "struct<subj: string, verb: string, obj: string, agent: string, passive: boolean>"
TRIPLE = "struct<subject: string, verb: string, object: string>"
STATE = f"struct<f: {FRAME}, prep: boolean, by: boolean, be: boolean, noun: boolean, last: string, stack: array<{FRAME}>, out: array<{TRIPLE}>>"


def frame(subj: Column | None = None, verb: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    one = F.struct((null if subj is None else subj).alias("subj"), (null if verb is None else verb).alias("verb"), null.alias("obj"), null.alias("agent"), F.lit(False).alias("passive"))
    return one.cast(FRAME)


def triples_of(f: Column) -> Column:
    """The triple of a clause as an array, empty if it has no verb."""
    word = lambda c: F.coalesce(c, F.lit(""))
    one = F.struct(word(F.when(f["passive"], f["agent"]).otherwise(f["subj"])).alias("subject"), an.base_form(f["verb"]).alias("verb"), word(F.when(f["passive"], f["subj"]).otherwise(f["obj"])).alias("object")).cast(TRIPLE)
    return F.when(f["verb"].isNotNull(), F.array(one)).otherwise(F.array().cast(f"array<{TRIPLE}>"))


def clause_triples(words: Column) -> Column:
    """(subject, verb, object) of each clause of a sentence, from an array of (word, tag), in the order in which clauses end."""
    none, no, yes = F.lit(None).cast("string"), F.lit(False), F.lit(True)

    def state(f: Column, prep: Column, by: Column, be: Column, noun: Column, last: Column, stack: Column, out: Column) -> Column:
        return F.struct(f.alias("f"), prep.alias("prep"), by.alias("by"), be.alias("be"), noun.alias("noun"), last.alias("last"), stack.alias("stack"), out.alias("out")).cast(STATE)

    def below(a: Column) -> tuple[Column, Column]:
        """The pushed clause, or none, and the rest of the stack."""
        n = F.size(a["stack"])
        return F.get(a["stack"], n - 1), F.slice(a["stack"], F.lit(1), F.greatest(n - 1, F.lit(0)))

    def step(a: Column, x: Column) -> Column:
        f, w, kind = a["f"], x["word"], x["tag"]
        pushed, rest = below(a)
        relative = w.isin(RELATIVE) & a["noun"]
        opened = state(frame(F.when(relative, a["last"])), no, no, no, no, a["last"], F.concat(a["stack"], F.array(f)), a["out"])
        # a noun
        put = lambda **new: F.struct(*(new.get(k, f[k]).alias(k) for k in ("subj", "verb", "obj", "agent", "passive"))).cast(FRAME)
        ends = f["verb"].isNotNull() & w.isin(NOMINATIVE) & ~a["prep"]
        back = F.when(pushed.isNotNull() & pushed["verb"].isNull(), rest).otherwise(a["stack"])
        own = F.when(a["prep"] & a["by"] & f["passive"], put(agent=w)).when(a["prep"], f).when(f["verb"].isNull(), put(subj=w)).when(f["obj"].isNull() | (a["noun"] & (f["obj"] == a["last"])), put(obj=w)).otherwise(f)
        named = state(F.when(ends, frame(w)).otherwise(own), no, no, no, yes, w, F.when(ends, back).otherwise(a["stack"]), F.when(ends, F.concat(a["out"], triples_of(f))).otherwise(a["out"]))
        # a verb
        first = put(verb=w, passive=a["be"] & w.rlike(PARTICIPLE))
        outer = F.when(pushed.isNull(), frame(f["subj"], w)).otherwise(frame(pushed["subj"], w))
        done = F.concat(a["out"], triples_of(f), F.when(pushed.isNotNull(), triples_of(pushed)).otherwise(F.array().cast(f"array<{TRIPLE}>")))
        second = f["verb"].isNotNull()
        acted = state(F.when(second, outer).otherwise(first), no, no, no, no, a["last"], F.when(second, rest).otherwise(a["stack"]), F.when(second, done).otherwise(a["out"]))
        behind = state(f, yes, w == "by", no, no, a["last"], a["stack"], a["out"])
        helped = state(f, a["prep"], a["by"], w.isin(lx.BE_FORMS), no, a["last"], a["stack"], a["out"])
        other = state(f, a["prep"], a["by"], a["be"] & (kind == "ADV"), no, a["last"], a["stack"], a["out"])
        return F.when(relative | (kind == "SCONJ"), opened).when(kind.isin(NOUNS), named).when(kind == "VERB", acted).when(kind == "ADP", behind).when(kind == "AUX", helped).otherwise(other)

    start = state(frame(), no, no, no, no, none, F.array().cast(f"array<{FRAME}>"), F.array().cast(f"array<{TRIPLE}>"))
    return F.aggregate(words, start, step, lambda a: F.concat(a["out"], triples_of(a["f"]), F.flatten(F.transform(F.reverse(a["stack"]), triples_of))))


def tagged_words(sentence: Column) -> Column:
    """(word, tag) of a sentence by the word-list tagger."""
    return F.transform(tx.tokens(sentence), lambda w: F.struct(w.alias("word"), an.tag(w).alias("tag")))
