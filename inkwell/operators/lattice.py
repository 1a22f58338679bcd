"""Tags of words in context: candidates of each word, a path through them, weights counted anew over a corpus.

A word of a closed class has the tags of the lists that hold it; any other word
those of its longest known suffix, down to the empty one. Tags follow each other
with weights of their own. The tags of a sentence are the path with the largest
sum; all weights are whole thousandths of logarithms, so sums are exact and ties
go to the tag that comes first. A round of counting decodes all texts where they
lie, adds up per task what was chosen, and makes weights of the sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import annotate as an
from ..sources.shared import kept

TAGS = an.TAGS
AT = {t: i for i, t in enumerate(TAGS)}
POSSESSIVES = ["his", "her", "its", "their", "my", "our", "your"]
OPEN = ("ADV", "VERB", "ADJ", "NOUN")
#: What a word cannot be.
NEVER = -100_000
LONGEST = 4
#: Suffixes of a counted model, the most frequent first; a longer one that is not among them falls back on a shorter one.
MOST_SUFFIXES = 4096
#: Different words that a task counts before it hands its sums on, and whose emissions it remembers.
MOST_WORDS = 100_000
#: First shares of the tags behind a suffix, and of the tags that follow a tag; what is not listed gets little.
SUFFIXES = {"": "NOUN 6 VERB 2 ADJ 2 ADV 1", "ly": "ADV 8 ADJ 1", "ed": "VERB 7 ADJ 2", "ing": "VERB 5 NOUN 3 ADJ 1", "s": "NOUN 6 VERB 3", "ness": "NOUN 9", "ity": "NOUN 9", "ion": "NOUN 8 VERB 1", "ment": "NOUN 8 VERB 1", "ous": "ADJ 8", "ful": "ADJ 7 NOUN 1", "ive": "ADJ 6 NOUN 2", "able": "ADJ 8", "ible": "ADJ 8", "al": "ADJ 6 NOUN 3", "ic": "ADJ 6 NOUN 3", "less": "ADJ 8 ADV 1", "ize": "VERB 8", "ise": "VERB 6 NOUN 2", "ify": "VERB 8"}
FOLLOWS = {
    "": "DET 4 PRON 4 NOUN 4 ADV 2 SCONJ 2 ADP 2 VERB 1 ADJ 2 NUM 1",
    "NUM": "NOUN 7 ADJ 2 ADP 2 NUM 1",
    "PRON": "VERB 6 AUX 4 NOUN 1 ADV 1",
    "DET": "NOUN 8 ADJ 4 NUM 1 ADV 1",
    "CCONJ": "NOUN 4 DET 3 PRON 2 ADJ 2 VERB 3",
    "SCONJ": "PRON 4 DET 4 NOUN 3 VERB 2 AUX 1",
    "AUX": "VERB 6 ADV 2 DET 2 ADJ 3 AUX 1 NOUN 1",
    "ADP": "DET 6 NOUN 5 PRON 2 ADJ 2 NUM 1",
    "ADV": "VERB 4 ADJ 3 ADV 1 ADP 1 PRON 1",
    "VERB": "DET 5 ADP 4 NOUN 3 ADV 2 PRON 2 ADJ 1 SCONJ 2",
    "ADJ": "NOUN 8 CCONJ 1 ADP 1 ADJ 1",
    "NOUN": "ADP 4 VERB 4 AUX 3 CCONJ 2 NOUN 2 SCONJ 2 PRON 1 ADV 1",
}
ENDS = "NOUN 6 VERB 3 ADJ 2 ADV 2 PRON 2 NUM 1 AUX 0.3 ADP 0.3"


def weights(shares: dict[str, float], names: Iterable[str] = TAGS, little: float = 0.1) -> list[int]:
    """Logarithms of the shares in thousandths; tags that are not among names never."""
    names = set(names)
    total = sum(shares.get(t, 0) + little for t in TAGS if t in names)
    return [round(1000 * math.log((shares.get(t, 0) + little) / total)) if t in names else NEVER for t in TAGS]


def shares(text: str) -> dict[str, float]:
    parts = text.split()
    return dict(zip(parts[::2], map(float, parts[1::2]), strict=True))


def closed() -> dict[str, list[str]]:
    """The tags of every word of a closed class: all lists that hold it."""
    out: dict[str, list[str]] = {}
    for name, rule in [*an.RULES, ("PRON", an.RELATIVES), ("SCONJ", ["that", "for"])]:
        for w in rule if isinstance(rule, list) else []:
            if name not in out.setdefault(w, []):
                out[w].append(name)
    for w in POSSESSIVES:
        out[w] = [*out.get(w, []), "DET"]
    return out


@dataclass(frozen=True)
class Model:
    """Weights by tag: of closed words, of suffixes (with the empty one), of each tag behind another (the last row is a sentence's begin), and as a sentence's last."""

    words: dict[str, list[int]]
    suffixes: dict[str, list[int]]
    follows: list[list[int]]
    ends: list[int]

    def emission(self, word: str) -> list[int]:
        if word.isdigit():
            return weights({"NUM": 1}, ["NUM"], 0)
        if word in self.words:
            return self.words[word]
        return next(self.suffixes[s] for n in range(min(LONGEST, len(word)), -1, -1) if (s := word[len(word) - n :]) in self.suffixes)


def first_model() -> Model:
    words = {w: weights({}, names, 1) for w, names in closed().items()}
    return Model(words, {s: weights(shares(x), OPEN) for s, x in SUFFIXES.items()}, [weights(shares(FOLLOWS[t])) for t in [*TAGS, ""]], weights(shares(ENDS)))


class Emissions:
    """The different emissions of a model as rows of one table, and the row of each word; the last words asked for are remembered."""

    def __init__(self, model: Model):
        self.known = {w: i for i, w in enumerate(model.words)}
        self.suffixes = {s: len(self.known) + i for i, s in enumerate(model.suffixes)}
        self.digits = len(self.known) + len(self.suffixes)
        self.table = np.array([*model.words.values(), *model.suffixes.values(), model.emission("0")], np.int64)
        self.seen: dict[str, int] = {}

    def row(self, word: str) -> int:
        if word.isdigit():
            return self.digits
        at = self.known.get(word)
        if at is None:
            size = len(word)
            at = next(self.suffixes[s] for n in range(min(LONGEST, size), -1, -1) if (s := word[size - n :]) in self.suffixes)
        return at

    def rows(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > MOST_WORDS:
            seen.clear()
        for w in words:
            if w not in seen:
                seen[w] = self.row(w)
        return np.fromiter((seen[w] for w in words), np.int64, len(words))


def walk(codes: np.ndarray, sizes: np.ndarray, table: np.ndarray, model: Model) -> np.ndarray:
    """Tags, by places of TAGS, of sentences laid end to end: words as rows of the table of emissions. All sentences go forward together, word by word."""
    follows, ends = np.array(model.follows, np.int64), np.array(model.ends, np.int64)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    begin, long = starts[order], sizes[order]
    live = np.searchsorted(-long, -np.arange(int(long[0]) if len(long) else 0), side="left")
    score = np.zeros((len(order), len(TAGS)), np.int64)
    back: list[np.ndarray] = []
    for t, n in enumerate(live):
        own = table[codes[begin[:n] + t]]
        if t == 0:
            score[:n] = follows[-1] + own
            back.append(np.zeros((n, len(TAGS)), np.int8))
            continue
        best, came = score[:n, :1] + follows[0], np.zeros((n, len(TAGS)), np.int8)
        if n < 64:
            ways = score[:n, :, None] + follows[None, :-1, :]
            best, came = ways.max(axis=1), ways.argmax(axis=1).astype(np.int8)
        else:
            for j in range(1, len(TAGS)):
                way = score[:n, j : j + 1] + follows[j]
                came[way > best] = j
                np.maximum(best, way, out=best)
        back.append(came)
        score[:n] = best + own
    out = np.zeros(int(sizes.sum()), np.int8)
    tag = (score + ends).argmax(axis=1)
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        out[begin[:n] + t] = tag[:n]
        tag[:n] = back[t][np.arange(n), tag[:n]]
    return out


def ranges(sizes: np.ndarray, most: int = 100_000) -> Iterator[tuple[int, int]]:
    """Ranges of sentences with about `most` words each; a longer one is its own range."""
    begin = size = 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(sizes):
        yield begin, len(sizes)


def decoded(column: pa.Array, model: Model, told: Emissions) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of an array of sentences: the different words, each word's place among them, each sentence's length (0 for null), and all tags end to end."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().dictionary_encode()
    names, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False)
    rows = told.rows(names)[codes] if names else codes
    ends = np.concatenate([[0], np.cumsum(sizes)])
    tags = [walk(rows[ends[a] : ends[b]], sizes[a:b], told.table, model) for a, b in ranges(sizes)]
    return names, codes, sizes, np.concatenate(tags) if tags else np.zeros(0, np.int8)


def decode(sentences: list[list[str]], model: Model) -> list[list[int]]:
    """The best path of each sentence, by places of TAGS."""
    _, _, sizes, tags = decoded(pa.array(sentences, pa.list_(pa.string())), model, Emissions(model))
    return [part.tolist() for part in np.split(tags, np.cumsum(sizes)[:-1])] if len(sizes) else []


def tagged(rows: DataFrame, tokens: str, model: Model, out: str = "tags") -> DataFrame:
    """rows with the tags of an array of lower-case words; null stays null, an empty array empty."""
    at = rows.columns.index(tokens)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, told = pa.array(TAGS, pa.string()), Emissions(sent.value)
        for batch in batches:
            column = batch.column(at)
            _, _, sizes, tags = decoded(column, sent.value, told)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, names.take(pa.array(tags)), mask=column.is_null())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, ArrayType(StringType()))]))


def counted(rows: DataFrame, tokens: str, model: Model) -> Model:
    """The model that the best paths of all rows make: one round of counting. Each task adds up what it has seen before it hands it on, MOST_WORDS different words at a time."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    width = len(TAGS)
    schema = "kind int, key string, " + ", ".join(f"_{i} long" for i in range(width))

    def told(known: Model, follows: np.ndarray, last: np.ndarray, seen: dict[str, int], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        def batch(kind: int, keys: pa.Array, rows: np.ndarray) -> pa.RecordBatch:
            some = rows.any(axis=1)
            keys, rows = keys.filter(pa.array(some)), rows[some]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), keys, *(pa.array(rows[:, i]) for i in range(width))], names=["kind", "key", *(f"_{i}" for i in range(width))])

        yield batch(0, pa.array([*(str(i) for i in range(width + 1)), "end"], pa.string()), np.vstack([follows, last]))
        words, of = list(seen), np.fromiter((1 if w in known.words else 0 if w.isdigit() else 2 for w in seen), np.int8, len(seen))
        yield batch(1, pa.array([words[i] for i in np.flatnonzero(of == 1)], pa.string()), counts[: len(seen)][of == 1])
        other, rows = pa.array([words[i] for i in np.flatnonzero(of == 2)], pa.string()), counts[: len(seen)][of == 2]
        sizes = pc.utf8_length(other).to_numpy()
        for n in range(LONGEST + 1):
            long = sizes >= n
            ends = pc.utf8_slice_codeunits(other.filter(pa.array(long)), -n) if n else pa.array([""] * len(other), pa.string())
            ends = ends.dictionary_encode()
            codes, keys = ends.indices.to_numpy(), ends.dictionary
            sums = [np.bincount(codes, weights=rows[long, i], minlength=len(keys)).astype(np.int64) for i in range(width)]
            yield batch(2, keys, np.stack(sums, axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lines = sent.value, Emissions(sent.value)
        follows, last, seen, counts = np.zeros((width + 1, width), np.int64), np.zeros(width, np.int64), {}, np.zeros((1024, width), np.int64)
        for batch in batches:
            names, codes, sizes, tags = decoded(batch.column(0), known, lines)
            if not len(tags):
                continue
            tags, sizes = tags.astype(np.int64), sizes[sizes > 0]
            before = np.concatenate([[width], tags[:-1]])
            before[np.cumsum(sizes)[:-1]] = width
            follows += np.bincount(before * width + tags, minlength=(width + 1) * width).reshape(width + 1, width)
            last += np.bincount(tags[np.cumsum(sizes) - 1], minlength=width)
            at = np.fromiter((seen.setdefault(w, len(seen)) for w in names), np.int64, len(names))
            if len(seen) > len(counts):
                counts = np.vstack([counts, np.zeros((len(seen), width), np.int64)])
            counts[at] += np.bincount(codes * width + tags, minlength=len(names) * width).reshape(len(names), width)
            if len(seen) > MOST_WORDS:
                yield from told(known, follows, last, seen, counts)
                follows, last, seen, counts = np.zeros_like(follows), np.zeros_like(last), {}, np.zeros((1024, width), np.int64)
        yield from told(known, follows, last, seen, counts)

    sums = [F.sum(f"_{i}").alias(f"_{i}") for i in range(width)]
    counts = rows.select(tokens).mapInArrow(run, schema).groupBy("kind", "key").agg(*sums).withColumn("total", sum((F.col(f"_{i}") for i in range(width)), F.lit(0)))
    counts = kept(counts, "counts", lean=True)  # two queries read it, and texts are decoded once
    small = counts.where("kind < 2").collect()  # as many rows as tags and closed words at most
    suffixes = counts.where("kind = 2").orderBy(F.desc("total"), "key").limit(MOST_SUFFIXES).collect()
    told_of = lambda r: {t: float(r[f"_{i}"]) for i, t in enumerate(TAGS)}
    follows = {r["key"]: weights(told_of(r), little=1) for r in small if r["kind"] == 0}
    words = {r["key"]: weights(told_of(r), [t for t, w in zip(TAGS, model.words[r["key"]], strict=True) if w > NEVER], 1) for r in small if r["kind"] == 1}
    known = {r["key"]: weights(told_of(r), OPEN, 1) for r in suffixes}
    return Model(model.words | words, {"": model.suffixes[""]} | known, [follows.get(str(i), model.follows[i]) for i in range(len(TAGS) + 1)], follows.get("end", model.ends))


def trained(rows: DataFrame, tokens: str, rounds: int = 2) -> Model:
    """The first model after some rounds of counting over all rows."""
    model = first_model()
    for _ in range(rounds):
        model = counted(rows, tokens, model)
    return model
