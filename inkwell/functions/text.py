"""Column builders for splitting and counting text. All are plain Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ends a sentence while text is split; no text uses it.
BREAK = "\u0001"
WORD = r"[\p{L}\p{N}_]+"
#: Letters whose upper case is more than one letter, and what stands for it as one: the sharp s has one of its own, Greek ones a title case, others stay; two letters got an upper case later than SQL's tables.
LONGER = {x: "\u1e9e" if x == "\u00df" else x.title() if len(x.title()) == 1 else x for x in map(chr, range(0xD800)) if len(x.upper()) > 1} | {chr(i): chr(i) for i in range(0xFB00, 0xFB18) if len(chr(i).upper()) > 1} | {x: x for x in "\u019b\u0264"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def run(chars: str) -> str:
    """Pattern of a whole run of such characters. Where what follows does not fit it is not tried again from its middle, so a long run costs its length."""
    return f"(?<!{chars}){chars}++"


def strip(c: Column) -> Column:
    """Without the white space at its edges; only these are read, where a pattern would be tried at each letter."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def trim(c: Column) -> Column:
    """Without the blanks of any kind at its edges; line ends and tabs stay, as in SQL's trim."""
    return F.regexp_replace(c, rf"^\p{{Zs}}++|{run(r'\p{Zs}')}\z", "")


def upper_letter(c: Column) -> Column:
    """One letter in upper case, as one letter."""
    return F.when(c.isin(list(LONGER)), F.translate(c, "".join(LONGER), "".join(LONGER.values()))).otherwise(F.upper(c))


def cut_at_last(c: Column, mark: str) -> tuple[Column, Column]:
    """What ends with the last such mark, and what follows it: all of it, if there is none."""
    tail = F.substring_index(c, mark, -1)
    return F.substr(c, F.lit(1), F.length(c) - F.length(tail)), tail


def full(parts: Column) -> Column:
    """Trimmed parts without the empty ones."""
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def paragraphs(c: Column) -> Column:
    """Pieces between blank lines; if that gives one piece and it has line feeds, its lines."""
    return let(full(F.split(c, "\n\n")), lambda blocks: F.when((F.size(blocks) <= 1) & c.contains("\n"), full(F.split(c, "\n"))).otherwise(blocks))


def sentences(c: Column) -> Column:
    """Cuts after . ! ? where white space follows; the tail stays."""
    return full(F.split(F.regexp_replace(c, r"([.!?])\s+", "$1" + BREAK), BREAK))


def words(c: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def tokens(c: Column) -> Column:
    """Runs of letters, digits and underscores in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def count(c: Column) -> Column:
    return F.size(c).cast("long")


def among(items: Column, known: Sequence[str]) -> Column:
    """How many of the items the list has."""
    return F.size(F.filter(items, lambda x: x.isin(list(known)))).cast("long")


def has_any(c: Column, parts: Sequence[str]) -> Column:
    """Whether the text contains any of the parts, as characters."""
    return reduce(lambda a, b: a | b, (c.contains(p) for p in parts))


def starts_any(c: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.startswith(p) for p in parts))


def grams(items: Column, n: int) -> Column:
    """n-grams, joined by blanks; none where there are fewer items."""

    def cut(xs: Column) -> Column:
        return F.when(F.size(xs) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(xs, i, n), " ")))

    return let(items, cut)


def windows(items: Column, size: int, step: int) -> Column:
    """Windows of `size` items, `step` apart; items that fill none form one window."""

    def cut(xs: Column) -> Column:
        n = F.size(xs)
        many = F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1)), F.lit(step)), lambda i: F.slice(xs, i, size))
        return F.when(n == 0, F.array().cast("array<array<string>>")).otherwise(many)

    return let(items, cut)


def paragraph_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, para_idx (from 0), paragraph.

    Here and elsewhere empty arrays go out after an outer explode: for an inner
    one Spark asks first whether the array is empty, and makes it twice for that.
    """
    return docs.select("doc_id", "source", F.posexplode_outer(paragraphs(F.col("text"))).alias("para_idx", "paragraph")).where("para_idx IS NOT NULL")


def sentence_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, para_idx, sent_idx (both from 0), sentence."""
    return paragraph_rows(docs).select("doc_id", "source", "para_idx", F.posexplode_outer(sentences(F.col("paragraph"))).alias("sent_idx", "sentence")).where("sent_idx IS NOT NULL")
