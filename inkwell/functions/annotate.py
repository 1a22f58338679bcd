"""A tagger by word lists and suffixes, and what can be read off its tags. Results say `_lex`: no parser is claimed.

`tag` is the replaceable part: anything that maps a lower-case token column to one of TAGS serves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from . import text as tx

TAGS = ["NUM", "PRON", "DET", "CCONJ", "SCONJ", "AUX", "ADP", "ADV", "VERB", "ADJ", "NOUN"]
DETERMINERS = ["a", "an", "the", "this", "that", "these", "those", "each", "every", "some", "any", "no"]
PREPOSITIONS = ["of", "in", "on", "at", "by", "with", "from", "to", "into", "over", "under", "through", "about", "between", "against", "during", "without"]
AUXILIARIES = [*lx.BE_FORMS, "do", "does", "did", "have", "has", "had", "will", "would", "can", "could", "should", "may", "might", "must", "shall"]
RELATIVES = ["who", "whom", "whose", "which", "that"]
VERBS = ["go", "goes", "went", "come", "came", "see", "saw", "say", "said", "make", "made", "take", "took", "know", "knew", "run", "ran", "stand", "stood", "fall", "fell", "rise", "rose", "build", "built", "sit", "sat", "sleep", "slept", "wake", "woke", "begin", "began", "leave", "left", "seem", "seems", "become", "became", *lx.SENSORY_VERBS]
COPULAS = ["be", "seem", "appear", "become", "remain", "stay", "look", "feel", "sound", "taste", "smell"]  # fixed values
QUESTION_AUX = ["do", "does", "did", "is", "are", "was", "were", "can", "could", "will", "would", "should", "have", "has", "had", "may", "might", "must"]
ADVERB, VERB, ADJECTIVE = r"^\p{L}{2,}ly$", r"^\p{L}{3,}(ed|ing|ize|ise|ify)$", r"^\p{L}{2,}(ous|ful|ive|able|ible|al|ic|less)$"
ABSTRACT_NOUN = r"^\p{L}{2,}(ness|ity|tion|sion|ment|ism|ence|ance)$"

#: In order: the first that fits gives the tag.
RULES: list[tuple[str, str | list[str]]] = [
    ("NUM", r"^[0-9]+$"),
    ("CCONJ", lx.COORDINATORS),
    ("PRON", [*lx.FIRST_SINGULAR, *lx.FIRST_PLURAL, *lx.THIRD_PERSON, *lx.VOICE_SECOND, "who", "whom", "whose", "which"]),
    ("DET", DETERMINERS),
    ("SCONJ", lx.SUBORDINATORS),
    ("AUX", AUXILIARIES),
    ("ADP", PREPOSITIONS),
    ("ADV", ADVERB),
    ("VERB", VERBS),
    ("VERB", VERB),
    ("ADJ", ADJECTIVE),
]


#: What a word must look like before a pattern is tried on it: how it ends, or that it begins with a digit.
HINTS = {r"^[0-9]+$": None, ADVERB: ["ly"], VERB: ["ed", "ing", "ize", "ise", "ify"], ADJECTIVE: ["ous", "ful", "ive", "able", "ible", "al", "ic", "less"]}
LISTED = sorted({w for _, rule in RULES if not isinstance(rule, str) for w in rule})


def fits(word: Column, rule: str) -> Column:
    ends = HINTS[rule]
    return (word < ":" if ends is None else reduce(lambda a, b: a | b, (word.endswith(e) for e in ends))) & word.rlike(rule)


def tag(word: Column) -> Column:
    """The first rule that fits. Most words are on no list, which one look tells, and have no ending that a pattern asks for."""

    def first(rules: list[tuple[str, str | list[str]]]) -> Column:
        out = F.lit("NOUN")
        for name, rule in reversed(rules):
            out = F.when(fits(word, rule) if isinstance(rule, str) else word.isin(rule), name).otherwise(out)
        return out

    return F.when(word.isin(LISTED), first(RULES)).otherwise(first([r for r in RULES if isinstance(r[1], str)]))


def tags(c: Column) -> Column:
    return F.transform(tx.tokens(c), tag)


def with_tag(c: Column, *names: str) -> Column:
    """Distinct tokens of these tags, sorted."""
    return F.filter(distinct(c), lambda w: tag(w).isin(*names))


def distinct(c: Column) -> Column:
    """Distinct tokens, sorted."""
    return F.sort_array(F.array_distinct(tx.tokens(c)))


def base_form(w: Column) -> Column:
    """A verb without its ending, a doubled last consonant made single."""
    cut = F.regexp_replace(F.regexp_replace(w, "(ied|ies)$", "y"), "(ed|ing|es|s)$", "")
    return F.regexp_replace(cut, r"([bdgklmnprt])\1$", "$1")


def action_verbs(c: Column) -> Column:
    """Base forms of a sentence's verbs, linking ones left out, distinct and sorted."""
    verbs = F.transform(F.filter(tx.tokens(c), lambda w: tag(w) == "VERB"), base_form)
    return F.array_sort(F.array_distinct(F.filter(verbs, lambda w: ~w.isin([*COPULAS, "becom", "sens"]))))


def asks(c: Column) -> Column:
    """Whether a sentence is a question: its mark, a question word first, or an auxiliary first."""
    return asks_by(c, tx.tokens(c))


def asks_by(c: Column, t: Column) -> Column:
    """The same, the first tokens known."""
    first = F.get(t, F.lit(0))
    return F.coalesce(tx.strip(c).endswith("?") | first.isin(*QUESTION_AUX, "who", "what", "where", "why", "how", "which", "when"), F.lit(False))


def commands(c: Column) -> Column:
    """Whether a sentence begins with a bare verb and names no person before the next verb."""
    return tx.let(tx.tokens(c), commands_by)


def commands_by(t: Column) -> Column:
    """The same, the first tokens known."""
    return F.coalesce(F.get(t, F.lit(0)).isin([*lx.IMPERATIVE, "go", "see", "make", "take", "leave"]) & ~F.get(t, F.lit(1)).isin("i", "we", "he", "she", "they"), F.lit(False))


def names(c: Column) -> Column:
    """Capitalised words that do not begin a sentence, distinct and sorted."""
    inner = F.flatten(F.transform(tx.sentences(c), lambda s: tx.let(tx.words(s), lambda w: F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))))))
    found = F.transform(F.filter(inner, lambda w: w.rlike(r"^\p{Lu}\p{Ll}+")), lambda w: F.regexp_replace(w, tx.run(r"[^\p{L}]") + "$", ""))
    return F.array_sort(F.array_distinct(found))


def triples(c: Column) -> Column:
    """Subject, verb and object by order alone: each verb with the nearest noun or pronoun on either side. Tags are given once, and each gap between two nouns is read once."""

    def read(t: Column) -> Column:
        return tx.let(F.struct(t.alias("t"), F.transform(t, tag).alias("k")), between)

    def between(x: Column) -> Column:
        nouns = F.filter(F.sequence(F.lit(0), F.size(x["k"]) - 1), lambda i: F.get(x["k"], i).isin("NOUN", "PRON"))
        ends = F.concat(F.array(F.lit(-1)), nouns, F.array(F.size(x["k"])))
        return F.when(F.size(x["k"]) == 0, F.array().cast("array<string>")).otherwise(tx.let(ends, lambda e: F.flatten(F.transform(F.slice(e, F.lit(1), F.size(e) - 1), lambda a, j: verbs(x, a, F.get(e, j + 1))))))

    def verbs(x: Column, a: Column, b: Column) -> Column:
        at = F.when(b - a > 1, F.filter(F.sequence(a + 1, b - 1), lambda i: F.get(x["k"], i) == "VERB")).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat_ws("|", F.coalesce(F.get(x["t"], a), F.lit("")), F.get(x["t"], i), F.coalesce(F.get(x["t"], b), F.lit(""))))

    return tx.let(tx.tokens(c), read)


#: One letter for each tag, so that phrases are found by patterns over them.
LETTERS = {"NUM": "M", "PRON": "O", "DET": "D", "CCONJ": "C", "SCONJ": "S", "AUX": "X", "ADP": "P", "ADV": "R", "VERB": "V", "ADJ": "J", "NOUN": "N"}
PHRASE = "D?[RJM]*N+(?:PD?[RJM]*N+|CD?[RJM]*N+)*"
#: The same for Java's matcher: neither back into a repeated group nor from the middle of a run.
RUN = "(?:D|(?<![DRJM]))[RJM]*+N++(?:[PC]D?[RJM]*+N++)*+"


def phrases(c: Column) -> Column:
    """Noun phrases: determiner, modifiers, nouns, and what prepositions and conjunctions add to them, in text order."""
    code = F.create_map(*(F.lit(x) for pair in LETTERS.items() for x in pair))

    def read(t: Column) -> Column:
        letters = F.array_join(F.transform(t, lambda w: code[tag(w)]), "")

        def cut(s: Column) -> Column:
            gaps = F.transform(F.split(s, RUN, -1), F.length)
            runs = F.transform(F.regexp_extract_all(s, F.lit(RUN), F.lit(0)), F.length)
            both = F.zip_with(F.slice(gaps, F.lit(1), F.size(runs)), runs, lambda g, n: F.struct(g.alias("gap"), n.alias("n")))
            start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
            return F.aggregate(both, start, lambda a, x: F.struct((a["at"] + x["gap"] + x["n"]).alias("at"), F.concat(a["out"], F.array(F.array_join(F.slice(t, a["at"] + x["gap"] + 1, x["n"]), " "))).alias("out")), lambda a: a["out"])

        return tx.let(letters, cut)

    return tx.let(tx.tokens(c), read)


def core(phrase: Column) -> Column:
    """A phrase without determiners and marks."""
    return F.array_join(F.filter(tx.tokens(phrase), lambda w: tag(w) != "DET"), " ")


def discourse_markers(c: Column) -> Column:
    """Adverbs and conjunctions that begin a sentence or follow a comma or semicolon, in text order."""
    parts = F.flatten(F.transform(tx.sentences(c), lambda s: F.split(s, r"[,;]\s*")))
    first = F.transform(parts, lambda p: F.get(tx.tokens(p), F.lit(0)))
    return F.filter(first, lambda w: w.isNotNull() & tag(w).isin("ADV", "SCONJ", "CCONJ"))
