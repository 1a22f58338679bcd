"""Triples of nested clauses against a plain interpreter."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from inkwell.functions import clauses as cs
from inkwell.functions import lexicon as lx


def base(w: str) -> str:
    cut = re.sub("(ed|ing|es|s)$", "", re.sub("(ied|ies)$", "y", w))
    return re.sub(r"([bdgklmnprt])\1$", r"\1", cut)


def plain(words: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    new = lambda subj=None, verb=None: {"subj": subj, "verb": verb, "obj": None, "agent": None, "passive": False}
    f, stack, out = new(), [], []
    prep = by = be = noun = False
    last = None

    def emit(x: dict) -> None:
        if x["verb"] is not None:
            one = (x["agent"], x["verb"], x["subj"]) if x["passive"] else (x["subj"], x["verb"], x["obj"])
            out.append((one[0] or "", base(one[1]), one[2] or ""))

    for w, kind in words:
        if (w in cs.RELATIVE and noun) or kind == "SCONJ":
            stack.append(f)
            f = new(last if w in cs.RELATIVE and noun else None)
            prep = by = be = noun = False
        elif kind in cs.NOUNS:
            if f["verb"] is not None and w in cs.NOMINATIVE and not prep:
                emit(f)
                if stack and stack[-1]["verb"] is None:
                    stack.pop()
                f = new(w)
            elif prep:
                if by and f["passive"]:
                    f = f | {"agent": w}
            elif f["verb"] is None:
                f = f | {"subj": w}
            elif f["obj"] is None or (noun and f["obj"] == last):
                f = f | {"obj": w}
            prep = by = be = False
            noun, last = True, w
        elif kind == "VERB":
            if f["verb"] is None:
                f = f | {"verb": w, "passive": be and re.search(cs.PARTICIPLE, w) is not None}
            else:
                emit(f)
                if stack:
                    outer = stack.pop()
                    emit(outer)
                    f = new(outer["subj"], w)
                else:
                    f = new(f["subj"], w)
            prep = by = be = noun = False
        elif kind == "ADP":
            prep, by, be, noun = True, w == "by", False, False
        elif kind == "AUX":
            be, noun = w in lx.BE_FORMS, False
        else:
            be, noun = be and kind == "ADV", False
    for x in [f, *reversed(stack)]:
        emit(x)
    return out


def test_folds_equal_plain_interpreter(spark):
    rng = random.Random(8)
    kinds = {"NOUN": ["river", "stone", "man"], "PRON": ["she", "he", "it", "who", "that"], "VERB": ["painted", "saw", "ran", "built"], "ADP": ["by", "of", "in"], "AUX": ["was", "is", "had"], "SCONJ": ["because", "that", "when"], "DET": ["the"], "ADV": ["slowly"], "CCONJ": ["and"], "NUM": ["42"]}
    rows = []
    for i in range(400):
        rows.append((i, [(rng.choice(kinds[k]), k) for k in rng.choices(list(kinds), k=rng.randrange(0, 14))]))
    frame = spark.createDataFrame(rows, "id int, t array<struct<word: string, tag: string>>")
    for r in frame.select("id", cs.clause_triples(F.col("t")).alias("x")).collect():
        assert [tuple(x) for x in r["x"]] == plain(rows[r["id"]][1]), rows[r["id"]]


def test_nested_clauses_have_their_own_triples(spark):
    cases = {
        "the man who saw the river built a bridge": [("man", "saw", "river"), ("man", "built", "bridge")],
        "because she painted the wall he saw the stone": [("she", "paint", "wall"), ("he", "saw", "stone")],
        "the wall was painted by the man": [("man", "paint", "wall")],
        "the river rose and took the stone": [("river", "rose", ""), ("river", "took", "stone")],
        "the man in the park saw a dog": [("man", "saw", "dog")],
    }
    rows = spark.createDataFrame([(t,) for t in cases], "s string")
    got = {r["s"]: [tuple(x) for x in r["x"]] for r in rows.select("s", cs.clause_triples(cs.tagged_words(F.col("s"))).alias("x")).collect()}
    assert got == cases
