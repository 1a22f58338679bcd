"""Measurements of authors and texts: rhythm, punctuation, vocabulary, person, style vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as lx
from ..functions import text as tx


def rhythm_label(cv: Column) -> Column:
    return F.when(cv < 0.4, "Smooth/Monotonous").when(cv < 0.6, "Moderate Variation").otherwise("Jagged/Volatile")


def burstiness(sentences: DataFrame, by: str = "source") -> DataFrame:
    """Sentences, mean words, coefficient of variation of words and its label, per group."""
    n = F.size(tx.tokens(F.col("sentence"))).cast("double")
    out = sentences.withColumn("_n", n).groupBy(by).agg(F.count("*").alias("n_sentences"), F.avg("_n").alias("_avg"), F.stddev_pop("_n").alias("_sd"))
    cv = F.when(F.col("_avg") > 0, F.col("_sd") / F.col("_avg")).otherwise(0.0)
    return out.select(by, "n_sentences", F.round("_avg", 6).alias("mean_words"), F.round(cv, 6).alias("burstiness"), F.when(F.col("_avg") > 0, rhythm_label(cv)).otherwise("Unknown").alias("rhythm_desc"))


def punctuation(sentences: DataFrame, by: str = "source") -> DataFrame:
    """Semicolons, dashes and exclamation marks per 100 sentences and which the author prefers."""
    c = F.col("sentence")
    out = sentences.groupBy(by).agg(F.count("*").alias("n"), *(F.sum(F.regexp_count(c, F.lit(p))).alias(a) for p, a in ((";", "s"), (r"(?:^|\s)[—–-](?:\s|$)|[—–]", "d"), ("!", "e"))))
    rate = {a: F.col(a) * 100.0 / F.col("n") for a in "sde"}
    top = F.greatest(*rate.values())
    choice = F.when(top < 1.0, "Standard").when(rate["s"] == top, "Semicolons").when(rate["d"] == top, "Dashes").otherwise("Exclamations")
    return out.select(by, F.round(rate["s"], 2).alias("semicolons_per_100"), F.round(rate["d"], 2).alias("dashes_per_100"), F.round(rate["e"], 2).alias("exclamations_per_100"), choice.alias("punctuation_preference"))


def structure(sentences: DataFrame, by: str = "source") -> DataFrame:
    """Mean words, share of sentences with comma or semicolon, spread of lengths."""
    c = F.col("sentence")
    n = F.size(tx.tokens(c)).cast("double")
    return sentences.groupBy(by).agg(F.round(F.avg(n), 4).alias("avg_words_per_sentence"), F.round(F.avg(c.rlike("[,;]").cast("double")), 4).alias("complexity_ratio"), F.round(F.stddev_pop(n), 4).alias("sentence_length_std_dev"))


def top_words(words: DataFrame, by: str, word: str, k: int, out: str = "n") -> DataFrame:
    """The k most frequent words of each group with their share of its words; ties in alphabetical order."""
    counts = words.groupBy(by, word).agg(F.count("*").alias(out))
    order = Window.partitionBy(by).orderBy(F.desc(out), word)
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    totals = counts.groupBy(by).agg(F.sum(out).alias("_total"))
    return ranked.join(totals, by).select(by, word, out, "rank", F.round(F.col(out) / F.col("_total"), 8).alias("share"))


def openers(sentences: DataFrame, by: str = "source") -> DataFrame:
    """First word of each sentence."""
    first = F.get(tx.tokens(F.col("sentence")), F.lit(0))
    return sentences.select(by, first.alias("opener")).where(F.col("opener").isNotNull())


def opener_pattern(sentences: DataFrame, by: str = "source", k: int = 10) -> DataFrame:
    """Whether an author's most frequent openers are logical or narrative markers."""
    top = top_words(openers(sentences, by), by, "opener", k)
    out = top.groupBy(by).agg(F.sum(F.col("opener").isin(lx.LOGICAL_OPENERS).cast("long")).alias("logical"), F.sum(F.col("opener").isin(lx.NARRATIVE_OPENERS).cast("long")).alias("narrative"))
    return out.select(by, "logical", "narrative", F.when(F.col("logical") > F.col("narrative"), "Logical").when(F.col("narrative") > F.col("logical"), "Narrative").otherwise("Mixed").alias("opener_pattern"))


def keywords(docs: DataFrame, by: str = "source", k: int = 30) -> DataFrame:
    """The most frequent words of an author that are no function words; shares are of such words."""
    each = docs.select(by, F.explode(tx.tokens(F.col("text"))).alias("word")).where(~F.col("word").isin(lx.STOPS) & (F.length("word") > 2))
    return top_words(each, by, "word", k)


def point_of_view(docs: DataFrame, by: str = "source") -> DataFrame:
    """Pronouns by class and the dominant person; without any it is the third."""
    t = tx.tokens(F.col("text"))
    out = docs.groupBy(by).agg(F.sum(tx.among(t, lx.FIRST_SINGULAR)).alias("first_singular"), F.sum(tx.among(t, lx.FIRST_PLURAL)).alias("first_plural"), F.sum(tx.among(t, lx.THIRD_PERSON)).alias("third_person"))
    top = F.greatest("first_singular", "first_plural", "third_person")
    pov = F.when(top == 0, "Third Person").when(F.col("first_singular") == top, "First Person Singular").when(F.col("first_plural") == top, "First Person Plural").otherwise("Third Person")
    return out.withColumn("pov", pov)


def profile(sentences: DataFrame, by: str = "source") -> DataFrame:
    """Rhythm, punctuation and person of each group from one pass over its sentences, each tokenised once."""
    c, t = F.col("sentence"), F.col("_t")
    marks = {"_s": ";", "_d": r"(?:^|\s)[—–-](?:\s|$)|[—–]", "_e": "!"}
    people = {"_one": lx.FIRST_SINGULAR, "_many": lx.FIRST_PLURAL, "_third": lx.THIRD_PERSON}
    each = sentences.withColumn("_t", tx.tokens(c)).select(by, F.size(t).cast("double").alias("_n"), *(F.regexp_count(c, F.lit(p)).alias(a) for a, p in marks.items()), *(tx.among(t, x).alias(a) for a, x in people.items()))
    out = each.groupBy(by).agg(F.count("*").alias("n_sentences"), F.avg("_n").alias("_avg"), F.stddev_pop("_n").alias("_sd"), *(F.sum(a).alias(a) for a in (*marks, *people)))
    cv = F.when(F.col("_avg") > 0, F.col("_sd") / F.col("_avg")).otherwise(0.0)
    rate = {a: F.col(a) * 100.0 / F.col("n_sentences") for a in marks}
    mark, person = F.greatest(*rate.values()), F.greatest(*people)
    prefers = F.when(mark < 1.0, "Standard").when(rate["_s"] == mark, "Semicolons").when(rate["_d"] == mark, "Dashes").otherwise("Exclamations")
    pov = F.when(person == 0, "Third Person").when(F.col("_one") == person, "First Person Singular").when(F.col("_many") == person, "First Person Plural").otherwise("Third Person")
    label = F.when(F.col("_avg") > 0, rhythm_label(cv)).otherwise("Unknown")
    return out.select(by, "n_sentences", F.col("_avg").alias("mean_words"), cv.alias("burstiness"), label.alias("rhythm_desc"), prefers.alias("punctuation_preference"), pov.alias("pov"))


def voice(c: Column) -> Column:
    """1st, 2nd, 3rd or neutral by pronouns; of equal counts the first named."""
    t = tx.tokens(c)
    one, two, three = (tx.among(t, x) for x in (lx.VOICE_FIRST, lx.VOICE_SECOND, lx.VOICE_THIRD))
    top = F.greatest(one, two, three)
    return F.when(top == 0, "neutral").when(one == top, "1st").when(two == top, "2nd").otherwise("3rd")


def perspective(c: Column) -> Column:
    """Person by distinct pronoun forms; the singular wins ties, and without any it is the third."""
    t = F.array_distinct(tx.tokens(c))
    one, many, third = (tx.among(t, x) for x in (lx.FIRST_SINGULAR, lx.FIRST_PLURAL, lx.THIRD_PERSON))
    return F.when((one > 0) & (one >= many) & (one >= third), "first_person_singular").when((many > 0) & (many >= third), "first_person_plural").otherwise("third_person")


def scaled(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low)))


def style_struct(c: Column) -> Column:
    """Style measures of a text, each brought to 0..1; those that need a tagger use word lists and suffixes."""

    def from_sentences(s: Column) -> Column:
        return tx.let(F.flatten(s), lambda t: from_tokens(s, t))

    def from_tokens(s: Column, t: Column) -> Column:
        n, m = F.greatest(F.size(t), F.lit(1)).cast("double"), F.greatest(F.size(s), F.lit(1)).cast("double")
        each = F.transform(s, lambda y: tx.among(y, lx.SUBORDINATORS) + F.floor(0.5 * tx.among(y, lx.COORDINATORS)))
        clauses = F.coalesce(F.array_max(each), F.lit(0)).cast("double")
        passive = F.size(F.filter(t, lambda w, i: w.isin(lx.BE_FORMS) & F.coalesce(F.get(t, i + 1).rlike("^\\S+(ed|en)$"), F.lit(False)))).cast("double")
        be = F.greatest(tx.among(t, lx.BE_FORMS), F.lit(1)).cast("double")
        letters = F.aggregate(t, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).cast("double")
        return F.struct(
            scaled(n / m, 5.0, 50.0).alias("length"),
            scaled(100.0 * F.regexp_count(c, F.lit("[,;:]")) / n, 0.0, 20.0).alias("marks"),
            (tx.among(t, lx.STOPS) / n).alias("stops"),
            scaled(clauses, 0.0, 10.0).alias("depth_lex"),
            F.least(passive / be, F.lit(1.0)).alias("passive_lex"),
            scaled(letters / n, 3.0, 8.0).alias("word_length"),
        )

    return tx.let(F.transform(tx.sentences(c), tx.tokens), from_sentences)


DIMENSIONS = ["length", "marks", "stops", "depth_lex", "passive_lex", "word_length"]


def style_vectors(docs: DataFrame, *keys: str) -> DataFrame:
    """The keys and one column per style measure, from docs.text."""
    return docs.select(*keys, style_struct(F.col("text")).alias("_s")).select(*keys, *(F.col("_s")[d].alias(d) for d in DIMENSIONS))


def compliance(mean_words: Column, sentences: Column, target_words: Column, target_sentences: Column, tolerance: float = 0.2) -> Column:
    """Mean of two scores, each falling from 1 to 0 over the tolerance."""

    def one(actual: Column, target: Column) -> Column:
        off = F.abs(actual - target) / target
        return F.when(target > 0, F.when(off > tolerance, 0.0).otherwise(1.0 - off / tolerance)).otherwise(1.0)

    return (one(mean_words, target_words) + one(sentences, target_sentences)) / 2.0


def sentence_fits(words: Column, target: Column, raw: Column, tolerance: float = 0.2, micro: int = 6, slack: int = 2) -> Column:
    """1.0 if a sentence's length will do: near a short target, within tolerance of a long one, or between what the source had and the target."""
    small = (F.abs(words - target) <= slack) & (words > 0)
    near = F.abs(words - target) / target <= tolerance
    safe = F.coalesce((raw > 0) & (words >= raw * (1 - tolerance)) & (words <= target * (1 + tolerance)), F.lit(False))
    return F.when(target <= 0, 1.0).when(target <= micro, small.cast("double")).otherwise((near | safe).cast("double"))


def composite(metrics: dict[str, Column]) -> Column:
    """Weighted mean of the metrics that are not null, weights renormalised, within 0..1; 0.5 if there is none."""
    zero = F.lit(0.0)
    total = sum((F.when(c.isNotNull(), lx.WEIGHTS.get(k, 0.0)).otherwise(0.0) for k, c in metrics.items()), zero)
    there = sum((c.isNotNull().cast("int") for c in metrics.values()), F.lit(0))
    weighted = sum((F.coalesce(c, zero) * lx.WEIGHTS.get(k, 0.0) for k, c in metrics.items()), zero)
    plain = sum((F.coalesce(c, zero) for c in metrics.values()), zero)
    return F.when(there == 0, 0.5).when(total == 0, plain / there).otherwise(F.greatest(zero, F.least(F.lit(1.0), weighted / total)))


def adjectives_to_verbs(c: Column) -> Column:
    """Adjectives by verbs, 0 to 3 brought to 0..1."""
    from ..functions import annotate as an

    return tx.let(an.tags(c), lambda k: scaled(F.size(F.filter(k, lambda x: x == "ADJ")) / F.greatest(F.size(F.filter(k, lambda x: x == "VERB")), F.lit(1)), 0.0, 3.0))


def paragraph_features(paragraphs: DataFrame, least: int = 2) -> DataFrame:
    """paragraphs of at least so many sentences, with nine features; heads are the nearest verbs, as no parser is at hand."""
    from ..functions import annotate as an

    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(xs), F.lit(1))

    def read(s: Column) -> Column:
        return tx.let(F.flatten(s), lambda t: tx.let(F.struct(s.alias("s"), t.alias("t"), F.transform(t, an.tag).alias("k"), F.transform(s, lambda x: F.size(x).cast("double")).alias("lens")), told))

    def told(x: Column) -> Column:
        s, t, k, lens = x["s"], x["t"], x["k"], x["lens"]
        n = F.greatest(F.size(k), F.lit(1))
        share = lambda tag: F.size(F.filter(k, lambda y: y == tag)) / n
        avg = mean(lens)
        spread = tx.let(avg, lambda m: F.sqrt(mean(F.transform(lens, lambda v: (v - m) * (v - m)))))

        def heads(verbs: Column) -> Column:
            """Mean distance to the nearest verb: words between verbs d apart add d * d div 4, those on v places before the first or after the last v * (v + 1) / 2."""
            outer = lambda v: F.floor(v * (v + 1) / 2)
            each = F.transform(verbs, lambda v, j: F.when(j == 0, outer(v)).otherwise(tx.let(v - F.get(verbs, j - 1), lambda d: F.floor(d * d / 4))))
            total = F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x) + outer(n - 1 - F.get(verbs, F.size(verbs) - 1))
            return F.when(F.size(verbs) == 0, 0.0).otherwise(total.cast("double") / n)

        verbs = F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(k, i) == "VERB"), lambda i: i.cast("long"))
        return F.struct(
            F.size(s).cast("double").alias("sentence_count"), avg.alias("avg_len"), F.when(avg > 0, spread / avg).otherwise(0.0).alias("burstiness"), tx.let(verbs, heads).alias("complexity"),
            (F.size(F.filter(t, lambda w: w.isin(lx.SUBORDINATORS))) / F.size(s)).alias("clause_density"), share("NOUN").alias("noun_ratio"), share("VERB").alias("verb_ratio"), share("ADJ").alias("adj_ratio"),
        )

    rows = paragraphs.withColumn("_f", tx.let(F.transform(tx.sentences(F.col("paragraph")), tx.tokens), lambda s: F.when(F.size(s) >= least, read(s))))
    return rows.where(F.col("_f").isNotNull()).select(*paragraphs.columns, "_f.*", F.col("paragraph").endswith("?").cast("double").alias("ends_question"))


def gated(rows: DataFrame, score: str, least: int) -> DataFrame:
    """Rows with score enough, numbered anew within their document."""
    order = Window.partitionBy("doc_id").orderBy("para_idx")
    return rows.where(F.col(score) >= least).withColumn("seq_id", F.row_number().over(order) - 1)


def described(rows: DataFrame) -> DataFrame:
    """Archetypes' means, labels and best-scored paragraph (the first of equals), and as -1 those of all."""
    best = F.min_by("paragraph", F.struct((-F.col("style_score")).alias("s"), "doc_id", "para_idx"))
    out = rows.rollup("archetype_id").agg(
        F.count("*").alias("n"), F.round(F.avg("sentence_count"), 1).alias("avg_sents"), F.round(F.avg("avg_len"), 1).alias("mean_len"), F.when(F.avg("burstiness") > 0.6, "High").otherwise("Low").alias("rhythm"),
        F.when(F.avg("noun_ratio") > 0.25, "Noun-Heavy/Academic").otherwise("Balanced").alias("style"), F.round(F.avg("style_score"), 1).alias("avg_style_score"), F.round(F.avg("noun_ratio"), 3).alias("nouns"), F.round(F.avg("clause_density"), 3).alias("clauses"), best.alias("example"),
    )
    return out.select(F.coalesce("archetype_id", F.lit(-1)).alias("archetype_id"), "n", "avg_sents", F.col("mean_len").alias("avg_len"), F.col("rhythm").alias("burstiness"), "style", "avg_style_score", F.col("nouns").alias("noun_ratio"), F.col("clauses").alias("clause_density"), "example")


def cluster_number(n: Column, least: int = 8, most: int = 50) -> Column:
    """The square root of the number of paragraphs within bounds; under ten paragraphs as many as there are, up to the least."""
    return F.when(n < 10, F.least(n, F.lit(least))).otherwise(F.greatest(F.lit(least), F.least(F.floor(F.sqrt(n)).cast("long"), F.lit(most)))).cast("long")


def polarity_words(docs: DataFrame, k: int) -> DataFrame:
    """Of the 3k most frequent adjectives and verbs the first k of each polarity."""
    from ..functions import annotate as an

    words = docs.select(F.explode(tx.tokens(F.col("text"))).alias("word")).where(F.length("word") > 2).groupBy("word").agg(F.count("*").alias("n"))
    top = words.where(an.tag(F.col("word")).isin("ADJ", "VERB") & ~F.col("word").isin(lx.STOPS)).orderBy(F.desc("n"), "word").limit(3 * k)
    mood = F.when(F.col("word").isin(lx.POSITIVE), "positive").when(F.col("word").isin(lx.NEGATIVE), "negative").otherwise("neutral")
    order = Window.partitionBy("polarity").orderBy(F.desc("n"), "word")
    return top.withColumn("polarity", mood).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("polarity", "word", "n", "rank")


def palette(docs: DataFrame, k: int, by: str = "source") -> DataFrame:
    """Each author's distinct adverbs before adjectives and its k most frequent nouns, verbs and adjectives."""
    from ..functions import annotate as an

    words = docs.select(by, F.explode(tx.tokens(F.col("text"))).alias("word")).where(~F.col("word").isin(lx.STOPS)).groupBy(by, "word").agg(F.count("*").alias("n")).where(an.tag(F.col("word")).isin("NOUN", "VERB", "ADJ"))
    top = words.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "word"))).where(F.col("rank") <= k)
    general = top.groupBy(F.col(by).alias("_g")).agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("_w"))

    def before(x: Column) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(x["t"]) - 2, F.lit(0))), lambda i: F.coalesce((F.get(x["k"], i) == "ADV") & (F.get(x["k"], i + 1) == "ADJ"), F.lit(False))), lambda i: F.get(x["t"], i))

    found = docs.select(by, F.explode_outer(F.array_distinct(tx.let(F.struct(tx.tokens(F.col("text")).alias("t"), an.tags(F.col("text")).alias("k")), before))).alias("w"))
    each = found.groupBy(by).agg(F.array_sort(F.collect_set("w")).alias("intensifiers"))
    return each.join(general, F.col(by).eqNullSafe(F.col("_g")), "left").select(by, "intensifiers", F.coalesce(F.col("_w.word"), F.array().cast("array<string>")).alias("general"))
