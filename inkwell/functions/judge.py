"""Critics of generated texts as columns: dangling clauses, fluency, invented names, coverage by likeness, candidates of templates.

Likeness of words and sentences comes from `Alike` columns, which stand for a
text encoder: `letters_alike` compares words by their letter triples,
`words_alike` sentences by their distinct words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import annotate as an
from . import compare as cp
from . import lexicon as lx
from . import structure as sr
from . import text as tx

# Words that open a subordinate clause, verbs that show a main clause, and shapes of weak futures.
OPENS = r"(?:even\s+though|although|while|whereas)"
MAIN_VERBS = ["is", "are", "was", "were", "has", "have", "had", "does", "do", "did", "works", "exists", "contains", "provides", "creates", "defines", "requires", "needs", "eliminates", "embeds", "embedded"]
FEW_VERBS = ["is", "are", "was", "were", "has", "have", "works", "exists"]
STILTED = r"(?i)\b(will|shall)\s*,\s*[^,]+,\s*(be\s+)?\w+"
FUTURE_PASSIVE = r"(?i)\bwill\s+be\s+\w+(?:en|ed)\b"
PLACEHOLDER = r"(?i)\[(?:NP|VP|ADJ)\]"
#: Shapes of sentences that lack their main clause.
CLOSES, BEGINS, RELATIVE, FRAGMENT = rf"(?i),\s+{OPENS}\s+[^,]+\.?\s*$", rf"(?i)^{OPENS}\s+[^,]+\.?\s*$", r"(?i)^[^,]+,\s+which\s+[^,]+\.?\s*$", rf"(?i)^[A-Za-z]+\s*,\s+{OPENS}"


def clause_parts(c: Column) -> Column:
    """Sentences without their marks, cut where marks and white space meet."""
    return F.filter(F.transform(F.split(tx.strip(c), tx.run("[.!?]") + r"\s++"), tx.strip), lambda s: s != "")


def dangling(s: Column) -> Column:
    """What a sentence lacks: its main clause after or before a subordinate one, the verb after a relative clause; null if nothing."""
    head = tx.strip(F.get(F.split(s, rf"(?i),\s+{OPENS}"), F.lit(0)))
    first = tx.strip(F.get(F.split(s, ","), F.lit(0)))
    bare = ~tx.has_any(F.lower(head), MAIN_VERBS) & (F.size(tx.words(head)) < 5)
    short = (F.size(tx.words(s)) < 10) & (F.size(tx.words(first)) <= 2) & ~tx.has_any(F.lower(first), FEW_VERBS)
    return F.when(s.rlike(CLOSES) & bare, "clause_end").when(s.rlike(BEGINS), "clause_start").when(s.rlike(RELATIVE), "relative").when(s.rlike(FRAGMENT) & short, "fragment")


def incomplete_clause(c: Column) -> Column:
    """(kind, sentence) of the first sentence that lacks its main clause; null if none does."""
    judged = F.transform(clause_parts(c), lambda s: F.struct(dangling(s).alias("kind"), s.alias("sentence")))
    return F.get(F.filter(judged, lambda x: x["kind"].isNotNull()), F.lit(0))


def fluency(c: Column) -> Column:
    """1 less what weak futures, a missing subject or verb, missing articles, no final mark and under three words cost; an empty text has 0."""

    def score(x: Column) -> Column:
        t, kinds = x["t"], x["kinds"]
        whole = F.exists(kinds, lambda k: k.isin("NOUN", "PRON")) & F.exists(kinds, lambda k: k.isin("VERB", "AUX"))
        bare = F.size(F.filter(kinds, lambda k, i: (k == "NOUN") & ~F.get(t, i).endswith("s") & (F.get(kinds, F.greatest(i - 1, F.lit(0))) == "VERB") & (i > 0)))
        start = 1.0 - F.when(c.rlike(STILTED), 0.5).otherwise(0.0) - F.when(c.rlike(FUTURE_PASSIVE), 0.15).otherwise(0.0)
        lacks = F.when(~whole & (start - 0.3 <= 0.8), 0.3).otherwise(0.0)
        articles = F.when(bare > 0, 0.2).otherwise(0.0) + 0.1 * bare
        ends = F.when(~F.regexp_replace(c, tx.run(r"\s") + "$", "").rlike(r"[.!?]$"), 0.1).otherwise(0.0)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), start - lacks - articles - ends - F.when(F.size(t) < 3, 0.2).otherwise(0.0)))

    return F.when(F.coalesce(tx.strip(c), F.lit("")) == "", 0.0).otherwise(tx.let(tx.tokens(c), lambda t: tx.let(F.struct(t.alias("t"), F.transform(t, an.tag).alias("kinds")), score)))


def invention(original: Column, generated: Column) -> Column:
    """(score, entities, words): a half for each name that shares nothing with the source's, a fifth for each new capitalised word, at most 1, the greater of both."""
    names = F.transform(an.names(original), F.lower)
    entities = F.filter(an.names(generated), lambda n: ~F.array_contains(names, F.lower(n)))
    fresh = cp.invented(original, generated)
    score = F.greatest(F.least(F.lit(1.0), F.size(entities) * 0.5), F.least(F.lit(1.0), F.size(fresh) * 0.2))
    return F.struct(score.alias("score"), entities.alias("entities"), fresh.alias("words"))


def triples_of(word: Column) -> Column:
    """Distinct letter triples of a word between marks."""
    padded = F.concat(F.lit("#"), word, F.lit("#"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substr(padded, i, F.lit(3))))


def set_cosine(a: Column, b: Column) -> Column:
    """Cosine of two sets."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a) * F.size(b).cast("double")))


def letters_alike(a: Column, b: Column) -> Column:
    """Likeness of two words by their letter triples."""
    return set_cosine(triples_of(a), triples_of(b))


def words_alike(a: Column, b: Column) -> Column:
    """Likeness of two sentences by their distinct words."""
    return set_cosine(F.array_distinct(tx.tokens(a)), F.array_distinct(tx.tokens(b)))


def alike_pairs(xs: Column, ys: Column, least: float) -> Column:
    """Numbers (x, y from 0, one long: x * 2^31 + y) of the words that may be more alike than `least`, all that are among them; each word has w and its triples t.

    Sets of which the greater shares more than `least`^2 of its parts, as it then
    must, meet in their first parts of any order common to them: so words meet by
    the digests of these, in one sort, and others never do.
    """
    bits = lambda x, n: F.call_function("shiftright", x, F.lit(n))
    first = lambda t: F.slice(F.sort_array(F.transform(t, lambda g: F.hash(g).cast("long"))), F.lit(1), F.size(t) - F.floor(F.size(t) * (least * least) - 1e-9).cast("int"))
    place = lambda words, side: F.flatten(F.transform(words, lambda x, i: F.transform(first(x["t"]), lambda h: F.call_function("shiftleft", h, F.lit(32)) + (i.cast("long") + side))))
    at = lambda k: k.bitwiseAND(F.lit(2**31 - 1))
    of_x = lambda k: k.bitwiseAND(F.lit(2**31)) != 0

    def meet(keys: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(keys) - 1), lambda i: (i == 0) | (bits(F.get(keys, i), 32) != bits(F.get(keys, i - 1), 32)))

        def pairs(run: Column) -> Column:
            one = F.transform(F.filter(run, of_x), lambda x: F.transform(F.filter(run, lambda k: ~of_x(k)), lambda y: at(x) * 2**31 + at(y)))
            return F.flatten(one)

        def each(begin: Column) -> Column:
            spans = F.transform(begin, lambda s, k: F.struct(s.alias("s"), F.coalesce(F.get(begin, k + 1), F.size(keys)).alias("e")))
            both = F.filter(spans, lambda r: ~of_x(F.get(keys, r["s"])) & of_x(F.get(keys, r["e"] - 1)))  # within a digest, those of y come first
            return F.flatten(F.transform(both, lambda r: tx.let(F.slice(keys, r["s"] + 1, r["e"] - r["s"]), pairs)))

        return F.array_distinct(tx.let(starts, each))

    found = tx.let(F.sort_array(F.concat(place(xs, F.lit(2**31)), place(ys, F.lit(0).cast("long")))), meet)
    return F.when((F.size(xs) == 0) | (F.size(ys) == 0), F.array().cast("array<bigint>")).otherwise(found)


def soft_coverage(original: Column, generated: Column, least: float = 0.7) -> Column:
    """(coverage, missing): the share of the source's content words with one in the output that is more alike than `least`, and the others; null where the source has none.

    Words that both have are alike; of the others only those that share one of their first triples are compared.
    """
    shapes = lambda words: F.transform(words, lambda w: F.struct(w.alias("w"), triples_of(w).alias("t")))

    def lost(s: Column) -> Column:
        def one(k: Column) -> Column:
            return F.struct(F.get(s["x"], F.call_function("shiftright", k, F.lit(31)).cast("int")).alias("x"), F.get(s["y"], k.bitwiseAND(F.lit(2**31 - 1)).cast("int")).alias("y"))

        near = F.filter(F.transform(alike_pairs(s["x"], s["y"], least), one), lambda p: set_cosine(p["x"]["t"], p["y"]["t"]) > least)
        return F.array_except(s["x"]["w"], F.transform(near, lambda p: p["x"]["w"]))

    def judge(s: Column) -> Column:
        own = F.coalesce(F.array_except(s["a"], s["b"]), F.array().cast("array<string>"))
        missing = tx.let(F.struct(shapes(own).alias("x"), shapes(F.coalesce(s["b"], F.array().cast("array<string>"))).alias("y")), lost)
        return tx.let(missing, lambda m: F.when(F.size(s["a"]) > 0, F.struct((1.0 - F.size(m) / F.size(s["a"])).alias("coverage"), m.alias("missing"))))

    return tx.let(F.struct(cp.content(original).alias("a"), cp.content(generated).alias("b")), judge)


def proposition_recall(propositions: Column, sentences: Column, least: float = 0.45, hybrid: float = 0.25, overlap: float = 0.75) -> Column:
    """(recall, missing): propositions that some sentence is likelier to hold than `least`, or that the likeliest sentence, above `hybrid`, shares most content words with.

    Of equally like sentences the first counts. Without propositions recall is 1, without sentences 0.
    """
    sets = lambda xs: F.transform(xs, lambda x, i: F.struct(x.alias("text"), F.array_distinct(tx.tokens(x)).alias("words"), i.alias("at")))

    def judge(s: Column) -> Column:
        def best(p: Column) -> Column:
            return F.array_max(F.transform(s["b"], lambda x: F.struct(set_cosine(p["words"], x["words"]).alias("like"), (-x["at"]).alias("at"), x["text"].alias("text"))))

        def kept(p: Column) -> Column:
            def one(m: Column) -> Column:
                keys = cp.content(p["text"])
                share = F.size(F.array_intersect(keys, cp.content(m["text"]))) / F.greatest(F.size(keys), F.lit(1))
                return (m["like"] > least) | ((m["like"] > hybrid) & (F.size(keys) > 0) & (share >= overlap))

            return F.coalesce(tx.let(best(p), one), F.lit(False))

        lost = F.filter(s["a"], lambda p: ~kept(p))
        return F.struct(F.when(F.size(s["a"]) == 0, 1.0).otherwise(1.0 - F.size(lost) / F.greatest(F.size(s["a"]), F.lit(1))).alias("recall"), F.transform(lost, lambda p: p["text"]).alias("missing"))

    return tx.let(F.struct(sets(propositions).alias("a"), sets(sentences).alias("b")), judge)


def blueprint_incomplete(original: Column, triples: Column) -> Column:
    """Whether triples (subject|verb|object) leave out more than half of a source's nouns, or there are none for over five words."""
    nouns = F.filter(an.with_tag(original, "NOUN"), lambda w: ~w.isin(lx.STOPS))
    ends = F.flatten(F.transform(triples, lambda t: F.array(F.get(F.split(t, r"\|"), F.lit(0)), F.get(F.split(t, r"\|"), F.lit(2)))))

    def judge(n: Column) -> Column:
        met = F.size(F.array_intersect(n, ends))
        empty = (F.size(tx.words(original)) > 5) & (F.size(triples) == 0)
        return empty | ((F.size(n) > 0) & ((met == 0) | (met / F.greatest(F.size(n), F.lit(1)) < 0.5)))

    return F.coalesce(tx.let(nouns, judge), F.lit(False))


def template_candidate(original: Column, candidate: Column, anchors: Column, lexicon: Column, least: float = 0.7) -> Column:
    """(semantic, adherence, density, composite, reason) of a candidate made from a template: placeholders and undue growth stop it, then the two gates."""
    recall = cp.recall(original, candidate)
    adherence, density = cp.adherence(anchors, candidate), cp.density(candidate, lexicon)
    semantic = sr.raw_score(recall, adherence)
    n = F.size(tx.words(original))
    growth = F.size(tx.words(candidate)) / F.greatest(n, F.lit(1))
    most = F.when(n < 10, 6.5).when(n < 20, 4.0).otherwise(2.5)

    def judge(s: Column) -> Column:
        ghost = candidate.rlike(PLACEHOLDER)
        reason = F.when(ghost, "placeholder").when((growth > most) & (s["density"] <= 0.4), "expansion").when((s["semantic"] < least) | (s["adherence"] < least), "gates").otherwise("passed")
        value = lambda x: F.when(ghost, 0.0).otherwise(x)
        total = F.when(reason == "passed", s["semantic"] * 0.4 + s["adherence"] * 0.3 + s["density"] * 0.3).otherwise(0.0)
        return F.struct(value(s["semantic"]).alias("semantic"), value(s["adherence"]).alias("adherence"), value(s["density"]).alias("density"), total.alias("composite"), reason.alias("reason"))

    return tx.let(F.struct(semantic.alias("semantic"), adherence.alias("adherence"), density.alias("density")), judge)


def full_record(original: Column, generated: Column, anchors: Column) -> Column:
    """Whole evaluation and raw score in one record: passed, raw_score, recall, adherence, fluency, similarity, precision, score, reason."""
    e = sr.evaluated(original, generated)
    r, p, a = cp.recall(original, generated), cp.precision(original, generated, F.array().cast("array<string>")), cp.adherence(anchors, generated)
    return F.struct(e["passed"].alias("passed"), sr.raw_score(r, a).alias("raw_score"), r.alias("recall"), a.alias("adherence"), fluency(generated).alias("fluency"), words_alike(original, generated).alias("similarity"), p.alias("precision"), e["score"].alias("score"), e["reason"].alias("reason"))


def bleached(sentence: Column) -> Column:
    """A sentence with its nouns, verbs and adjectives replaced by placeholders, runs of one kind by one; the default template where nothing is left."""
    slot = lambda w: F.when(an.tag(w) == "NOUN", "[NP]").when(an.tag(w) == "VERB", "[VP]").when(an.tag(w) == "ADJ", "[ADJ]").otherwise(w)
    filled = F.transform(tx.tokens(sentence), slot)
    single = tx.let(filled, lambda xs: F.filter(xs, lambda x, i: (i == 0) | ~x.startswith("[") | (x != F.get(xs, F.greatest(i - 1, F.lit(0))))))
    return F.coalesce(F.nullif(F.concat(F.array_join(single, " "), F.lit(".")), F.lit(".")), F.lit("[NP] [VP] [NP]."))


def sentence_templates(c: Column) -> Column:
    """A template for each sentence of an example; the default one for an empty example."""
    return tx.let(F.transform(tx.sentences(c), bleached), lambda t: F.when(F.coalesce(F.size(t), F.lit(0)) > 0, t).otherwise(F.array(F.lit("[NP] [VP] [NP]."))))


def replacement(word: Column, palette: Column, least: float = 0.3) -> Column:
    """The palette's word of the same kind that is most alike (the first by name of equals), else a neutral one of the kind; null where the word is to go."""
    kind = an.tag(word)
    fit = F.filter(palette, lambda p: (an.tag(p) == kind) & (p != word))
    best = F.array_min(F.transform(fit, lambda p: F.struct((-letters_alike(word, p)).alias("d"), p.alias("w"))))
    return F.when(-best["d"] >= least, best["w"]).when(kind == "NOUN", "structure").when(kind == "ADJ", "large")


def synonyms(word: Column, known: Column) -> Column:
    """The word and what a map of synonyms has for it, sorted."""
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lower(word)), F.coalesce(known[F.lower(word)], F.array().cast("array<string>")))))
