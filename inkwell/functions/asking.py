"""What each generating operator asks for, how its answer is read, and what stands in where there is none.

A `Task` is one operator: its instruction, how its answer is read (a family in
READERS) and the family's fallback. Prompts are assembled from sections.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import feedback as fb
from . import rewrite as rw
from . import text as tx

VARIANT = r"^(?:VAR:|\d+[.)]|[-*])\s*"
ACTIONS = ["delete", "merge_with_next", "rewrite", "split", "insert"]


def number(answer: Column, name: str = "score") -> Column:
    """A number of the answer's object by name."""
    return F.try_to_number(F.nullif(F.regexp_extract(answer, rf'"{name}"\s*:\s*(-?[0-9]+(?:\.[0-9]+)?)', 1), F.lit("")), F.lit("S999999.999999")).cast("double")


def read_text(answer: Column, draft: Column) -> Column:
    """The cleaned answer; the draft where it is empty."""
    return F.coalesce(F.nullif(rw.clean_generated(answer), F.lit("")), draft)


def read_variants(answer: Column, draft: Column) -> Column:
    """Marked lines of the answer, at least three words each; the draft alone where there are none."""
    found = F.transform(F.filter(F.split(answer, "\n"), lambda x: x.rlike(VARIANT)), lambda x: tx.strip(F.regexp_replace(x, VARIANT, "")))
    long = F.filter(found, lambda x: F.size(tx.words(x)) >= 3)
    return F.when(F.coalesce(F.size(long), F.lit(0)) > 0, long).otherwise(F.array(draft))


def read_score(answer: Column, draft: Column, least: float = 1, most: float = 5, default: float = 3, short: int = 50) -> Column:
    """A score within bounds; the least for a draft too short to judge, the default where the answer has none."""
    told = F.coalesce(number(answer), F.lit(float(default)))
    return F.when(F.length(draft) < short, float(least)).otherwise(F.greatest(F.lit(float(least)), F.least(F.lit(float(most)), told)))


def read_verdict(answer: Column, draft: Column) -> Column:
    """(ok, confidence); what cannot be read passes with a confidence of a half."""
    ok = F.nullif(F.lower(F.regexp_extract(answer, r'(?i)"ok"\s*:\s*(true|false)', 1)), F.lit(""))
    return F.struct((F.coalesce(ok, F.lit("true")) == "true").alias("ok"), F.when(ok.isNull(), 0.5).otherwise(F.coalesce(number(answer, "confidence"), F.lit(1.0))).alias("confidence"))


def read_choice(answer: Column, draft: Column) -> Column:
    """The letter that the answer names on its own, upper case; none for NONE, A where it names none."""
    letter = F.nullif(F.regexp_extract(answer, r"(?:^|[^A-Za-z])([ABC])(?:[^A-Za-z]|$)", 1), F.lit(""))
    return F.when(answer.rlike(r"\bNONE\b"), "none").otherwise(F.coalesce(letter, F.lit("A")))


def read_plan(answer: Column, draft: Column) -> Column:
    """Steps (action, at) of known kinds within the draft's sentences, in the answer's order; none where it cannot be read."""
    steps = F.from_json(fb.json_text(answer), "array<struct<action: string, at: int>>")
    n = F.size(tx.sentences(draft))
    good = F.filter(steps, lambda s: s["action"].isin(ACTIONS) & (s["at"] >= 1) & (s["at"] <= n))
    return F.coalesce(good, F.array().cast("array<struct<action: string, at: int>>"))


def read_roles(answer: Column, draft: Column) -> Column:
    """One role for each sentence of the draft, BODY where the answer has too few."""
    roles = fb.json_list(answer)
    return F.transform(tx.sentences(draft), lambda s, i: F.coalesce(F.get(roles, i), F.lit("BODY")))


def read_slots(answer: Column, draft: Column, slots: int = 3) -> Column:
    """One line for each slot, cut or filled up with EMPTY; the draft's facts dealt evenly where there is no answer."""
    lines = F.filter(F.transform(F.split(answer, "\n"), tx.strip), lambda x: x != "")
    cut = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.coalesce(F.get(lines, i), F.lit("EMPTY")))
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, cut).otherwise(fb.dealt(F.filter(F.split(draft, r"\. "), lambda x: F.trim(x) != ""), slots))


READERS: dict[str, Callable[[Column, Column], Column]] = {"text": read_text, "variants": read_variants, "score": read_score, "verdict": read_verdict, "choice": read_choice, "plan": read_plan, "roles": read_roles, "slots": read_slots}


@dataclass(frozen=True)
class Task:
    """An operator that asks a generator: instruction and family of its answer."""

    instruction: str
    reads: str

    def read(self, answer: Column, draft: Column) -> Column:
        return READERS[self.reads](answer, draft)


#: By operator. Placeholders in braces are filled in by `told`.
TASKS = {
    "neutral_summary": Task("Restate the passage plainly, keep every fact, and write in the {perspective}.", "text"),
    "plan_content": Task("Distribute the facts over {n} slots, one line a slot, and leave a slot EMPTY rather than invent.", "slots"),
    "global_context": Task("Name the thesis, the intent and five keywords of the document, one line each.", "slots"),
    "extract_template": Task("Replace nouns, verbs and adjectives by [NP], [VP] and [ADJ]; keep all other words.", "text"),
    "style_dna": Task("Describe words, tone and structure of these examples, one line each.", "slots"),
    "rank_candidates": Task("Which candidate keeps the meaning and sounds most like the author? Answer with its letter, or NONE.", "choice"),
    "author_dna": Task("Describe in one paragraph how {author} writes.", "text"),
    "classify_rhetoric": Task("Answer with the letter of the kind: A observation, B argument, C definition.", "choice"),
    "style_match": Task('Rate meaning and style from 1 to 5 as {{"score": n}}.', "score"),
    "surgical_fix": Task("Make this one change and no other: {instruction}", "text"),
    "repair_plan": Task('List repairs as [{{"action": one of delete, merge_with_next, rewrite, split, insert, "at": sentence number}}].', "plan"),
    "repair_variants": Task("Write {n} variants of the sentence that do this: {instruction} One a line, each after VAR:.", "variants"),
    "sentence_variants": Task("Write {n} variants of the sentence with about {words} words each, one a line, each after VAR:.", "variants"),
    "refine_sentence": Task("Rewrite the sentence as the feedback asks: {feedback}", "text"),
    "sentence_for_slot": Task("Write one {type} sentence of about {words} words that says this.", "text"),
    "batch": Task("Write {n} sentences that fill the skeleton, one a line, each after VAR:.", "variants"),
    "batch_fallback": Task("Write {n} sentences about the subject, one a line, each after VAR:.", "variants"),
    "breed": Task("Combine the best of these parents into {n} new sentences, one a line, each after VAR:.", "variants"),
    "fresh": Task("Write {n} new sentences that say this in the author's manner, one a line, each after VAR:.", "variants"),
    "population": Task("Apply this operator {n} times: {operator}. One result a line, each after VAR:.", "variants"),
    "translate": Task("Say this in the manner of {author}; keep every fact.", "text"),
    "literal": Task("Say this as plainly as the source does; keep every fact.", "text"),
    "style_fallback": Task("Say this in the manner of {author}, in any structure.", "text"),
    "polish": Task("Bring the text closer to this manner: {style}.", "text"),
    "simplify_draft": Task("Say the draft more simply and lose no fact.", "text"),
    "narrative_arc": Task("Name each sentence's part in the paragraph as a list of OPEN, BODY, TURN or CLOSE.", "roles"),
    "smooth": Task("Smooth the joints between sentences; change nothing else.", "text"),
    "simplify": Task("Shorten long sentences; lose no fact.", "text"),
    "coherence": Task('Rate how well the sentences hang together from 1 to 5 as {{"score": n}}.', "score"),
    "meaning": Task('Does the text say what the source says? Answer {{"ok": true or false, "confidence": 0 to 1}}.', "verdict"),
    "logic": Task('Is the text free of contradictions? Answer {{"ok": true or false, "confidence": 0 to 1}}.', "verdict"),
    "entailment": Task('Does the sentence entail the statement? Answer {{"ok": true or false, "confidence": 0 to 1}}.', "verdict"),
    "sentence_fit": Task('Rate how well the draft fits template and statements from 1 to 5 as {{"score": n}}.', "score"),
    "evaluate_batch": Task('Rate each slot from 1 to 5 as {{"score": n}}.', "score"),
    "populations": Task("Which candidate fits the slot best? Answer with its letter, or NONE.", "choice"),
    "inject": Task("Work these missing words into the text: {words}.", "text"),
    "grammar": Task("Correct the grammar and change nothing else.", "text"),
    "style_polish": Task("Use more of the author's words: {words}.", "text"),
    "dynamic_style": Task("Follow this description of the author: {style}", "text"),
    "clone": Task("Fill the template with the content: {template}.", "text"),
    "audit_paragraph": Task('How distinctly does this sound like {author}, from 1 to 5? Answer {{"score": n}}.', "score"),
    "audit_template": Task('How characteristic of {author} is this template, from 1 to 5? Answer {{"score": n, "reason": "..."}}.', "score"),
}


def operator(name: str) -> Task:
    """The operator of a name; unknown names are an error."""
    if name not in TASKS:
        raise ValueError(f"unknown operator {name}; known: {', '.join(sorted(TASKS))}")
    return TASKS[name]


def told(name: str, **values: object) -> str:
    """An operator's instruction with its values filled in."""
    return operator(name).instruction.format_map(values)


def section(title: str, body: Column) -> Column:
    """A titled section; nothing where the body is null or empty."""
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {title}\n"), body))


def persona(author: Column, budget: Column | None = None) -> Column:
    """The system message: who speaks, and what words are limited."""
    return F.concat_ws("\n\n", F.concat(F.lit("You write as "), author, F.lit(".")), *([] if budget is None else [budget]))


def budget_section(forbidden: Column, warned: Column) -> Column:
    """Words that may not be used any more, and words to use with care."""
    lines = [F.when(F.size(words) > 0, F.concat(F.lit(f"{name}: "), F.array_join(F.array_sort(words), ", "))) for name, words in (("Forbidden", forbidden), ("Use with care", warned))]
    return section("Vocabulary", F.concat_ws("\n", *lines))


def blend(first: Column, second: Column, share: float) -> Column:
    """How two authors' manners are mixed."""
    return section("Manner", F.when(second.isNull(), first).otherwise(F.concat(first, F.lit(f" ({round(share * 100)}%) and "), second, F.lit(f" ({round((1 - share) * 100)}%)"))))


def generation_prompt(text: Column, example: Column, structure: Column, words: Column, mode: str = "STRICT") -> Column:
    """Few-shot prompt: example, structure (left out of the SAFETY mode), words to prefer, the text and the mode's constraint."""
    rules = {"STRICT": "Follow the structure exactly.", "LOOSE": "Follow the structure loosely.", "SAFETY": "Keep the meaning; any structure will do."}
    return F.concat_ws("\n\n", section("Example", example), *([] if mode == "SAFETY" else [section("Structure", structure)]), section("Words", F.array_join(words, ", ")), section("Text", text), F.lit(rules[mode]))


def style_constraints(profile: dict[str, Column]) -> Column:
    """A profile's measures as lines of a prompt."""
    return section("Constraints", F.concat_ws("\n", *(F.concat(F.lit(f"- {k}: "), v.cast("string")) for k, v in profile.items())))


def sections(c: Column) -> Column:
    """`## NAME` sections of a text as a map from name to body; of equal names the last counts."""

    def named(p: Column, i: Column) -> Column:
        return tx.let(F.split(p, "\n", 2), lambda x: F.struct(tx.strip(F.get(x, F.lit(0))).alias("name"), i.alias("at"), tx.strip(F.coalesce(F.get(x, F.lit(1)), F.lit(""))).alias("body")))

    def last(xs: Column) -> Column:
        return F.filter(xs, lambda x, i: F.coalesce(F.get(xs, i + 1)["name"] != x["name"], F.lit(True)))

    parts = tx.let(F.split(F.concat(F.lit("\n"), c), r"\n## ", -1), lambda x: F.slice(x, F.lit(2), F.size(x) - 1))
    found = tx.let(F.sort_array(F.transform(parts, named)), last)  # equal names are neighbours: one sort instead of a look at all that follow
    placed = F.sort_array(F.transform(found, lambda x: F.struct(x["at"].alias("at"), x["name"].alias("name"), x["body"].alias("body"))))
    return F.map_from_entries(F.transform(placed, lambda x: F.struct(x["name"].alias("name"), x["body"].alias("body"))))


def blocked_names(author: Column) -> Column:
    """Words of an author's name of more than two letters, which a text in the author's voice does not use."""
    return F.array_sort(F.array_distinct(F.filter(tx.tokens(author), lambda w: F.length(w) > 2)))
