"""Language identification: script ranges narrow the candidates, Viterbi over word scores labels the spans.

A word is a run of letters of one script, in lower case. Each word is scored
for each learned language by its hashed n-grams and by itself; languages that
were not seen in the word's script are not candidates. A path over the words
that pays for every switch of language then labels the spans of a text that
mixes languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .runtime import chunks, clean, ready
from .subwords import documents, ngrams, remainder, training_rows

UNKNOWN = "und"
#: Bounds of the training sample.
ROWS, CHARS = 4000, 12_000_000
SIZES, BUCKETS = (1, 2, 3, 4), 1 << 17
#: Nats that a switch of language costs, about what four clear words say.
SWITCH = 8.0
#: Score of a language that is no candidate for a word's script.
RULED_OUT = -6.0
#: Share of its letters that a language must have in a script to be a candidate there.
IN_SCRIPT = 0.002
#: First and last code points of scripts (fixed values, by Unicode's blocks); other letters form one more script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x3134F)],
}
_table: list[np.ndarray] = []


def scripts() -> np.ndarray:
    """Script of each code point: 0 for no letter, then in the order of SCRIPTS, last the rest."""
    if not _table:
        out = np.where(tv.classes() == tv.LETTER, len(SCRIPTS) + 1, 0).astype(np.uint8)
        for k, ranges in enumerate(SCRIPTS.values(), 1):
            for low, high in ranges:
                part = out[low : high + 1]
                part[part > 0] = k
        _table.append(out)
    return _table[0]


@dataclass(frozen=True)
class Model:
    """Languages by code point, each bucket's log-likelihoods, and which languages are candidates in each script."""

    langs: list[str]
    logs: np.ndarray
    allowed: np.ndarray


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points in lower case, begin, end and script of each word, and each text's first word (one more at the end).

    Lower case is taken one code point at a time, so positions are those of the text.
    """
    codes, starts = tv.points(texts)
    codes = tv.lower(codes)
    kind = scripts()[codes]
    edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))
    real = kind[edge] > 0
    begin, end = edge[real], np.append(edge[1:], len(codes))[real]
    return codes, begin, end, kind[begin], np.append(np.searchsorted(begin, starts), len(begin))


def train(rows: list[tuple[int, str, object]]) -> Model:
    """Counts of hashed features by language, smoothed, as log-likelihoods around their mean."""
    langs = sorted({str(y) for *_, y in rows})
    number = {y: i for i, y in enumerate(langs)}
    counts = np.zeros((len(langs), BUCKETS))
    letters = np.zeros((len(SCRIPTS) + 2, len(langs)))
    for a, b in chunks([t for _, t, _ in rows]):
        codes, begin, end, script, cut = words([t for _, t, _ in rows[a:b]])
        label = np.repeat([number[str(y)] for *_, y in rows[a:b]], np.diff(cut))
        found, token = ngrams(codes, begin, end, SIZES, BUCKETS)
        counts += np.bincount(label[token] * BUCKETS + found, minlength=counts.size).reshape(counts.shape)
        np.add.at(letters, (script, label), end - begin)
    share = letters / np.maximum(1, letters.sum(axis=0))
    logs = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)) if langs else counts
    seen = counts.sum(axis=0) > 0
    logs = np.where(seen, logs - logs.mean(axis=0), 0) if langs else logs
    return Model(langs, logs.T.astype(np.float32), share >= IN_SCRIPT)


def score_words(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, script: np.ndarray, model: Model, memo: tv.Memo) -> np.ndarray:
    """Score of each word in each language: the mean of its features' log-likelihoods, weighed by its length."""

    def make(at: np.ndarray) -> np.ndarray:
        found, token = ngrams(codes, begin[at], end[at], SIZES, BUCKETS)
        n = np.bincount(token, minlength=len(at))
        own = np.stack([np.bincount(token, model.logs[found, k], len(at)) for k in range(len(model.langs))], axis=1)
        own *= (np.minimum(end[at] - begin[at], 12) / (3 * n))[:, None]
        here = model.allowed[script[at]]
        return np.where(here.any(axis=1, keepdims=True) & ~here, RULED_OUT, own)

    return memo.get(tv.hashes(codes, begin, end), make)


def settled(scores: np.ndarray, cut: np.ndarray, switch: float) -> np.ndarray:
    """For each text the language that all of it has on the best path, or -1 where the path may switch.

    A stay outside the language gains at most the greatest sum over
    consecutive words of another language's scores less its own. A path of m
    stays has m - 1 switches at least, as it may never use the language, and m
    is 2 at least; where no stay gains more than half of what one switch
    costs, no path that switches can be better. So this is exact, and most
    texts need nothing more.
    """
    out = np.full(len(cut) - 1, -1)
    full = np.flatnonzero(np.diff(cut) > 0)
    if not len(full):
        return out
    first = cut[full]
    total = np.add.reduceat(scores.astype(np.float64), first, axis=0)
    best = total.argmax(axis=1)
    text = np.repeat(np.arange(len(full)), np.diff(np.append(first, len(scores))))
    gain = np.zeros(len(full))
    own = scores[np.arange(len(scores)), best[text]].astype(np.float64)
    for k in range(scores.shape[1]):
        run = np.cumsum(scores[:, k] - own)
        run = np.concatenate(([0.0], run))
        low = run[:-1] - text * (2 * np.abs(run).max() + 1)
        low = np.minimum.accumulate(low) + text * (2 * np.abs(run).max() + 1)
        gain = np.maximum(gain, np.maximum.reduceat(run[1:] - low, first))
    out[full] = np.where(2 * gain <= switch, best, -1)
    return out


def viterbi(parts: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """Best path of each text, all texts one step at a time; of equal ways the one that stays, then the first language, wins."""
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    sizes = np.array([len(parts[i]) for i in order])
    flat = np.concatenate([parts[i] for i in order]).astype(np.float64)
    base = np.cumsum(sizes) - sizes
    value = np.zeros((len(order), flat.shape[1]))
    came, live = [], len(order)
    for t in range(sizes[0]):
        while sizes[live - 1] <= t:
            live -= 1
        now = value[:live]
        top = now.argmax(axis=1)
        most = now[np.arange(live), top][:, None] - (switch if t else 0)
        stay = now >= most
        came.append(np.where(stay, np.arange(flat.shape[1]), top[:, None]).astype(np.uint8))
        value[:live] = np.where(stay, now, most) + flat[base[:live] + t]
    out = [np.empty(0, np.int64)] * len(parts)
    at = value.argmax(axis=1)
    paths = np.empty(len(flat), np.int64)
    live = 0
    for t in range(sizes[0] - 1, -1, -1):
        while live < len(order) and sizes[live] > t:
            live += 1
        paths[base[:live] + t] = at[:live]
        at[:live] = came[t][np.arange(live), at[:live]]
    for k, i in enumerate(order):
        out[i] = paths[base[k] : base[k] + sizes[k]]
    return out


def label_texts(texts: list[str], model: Model, memo: tv.Memo, switch: float = SWITCH) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
    """Of each text the language of most letters, their share, and the spans (language, begin, end) in code points."""
    held: list[tuple] = []
    for a, b in chunks(texts):
        codes, begin, end, script, cut = words(texts[a:b])
        if not model.langs or not len(begin):
            held += [None] * (b - a)
            continue
        scores = score_words(codes, begin, end, script, model, memo)
        one = settled(scores, cut, switch)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[a:b]])
        for i in range(b - a):
            lo, hi = cut[i], cut[i + 1]
            if lo == hi:
                held.append(None)
            elif one[i] >= 0:
                size = int((end[lo:hi] - begin[lo:hi]).sum())
                held.append((int(one[i]), int(begin[lo] - starts[i]), int(end[hi - 1] - starts[i]), size))
            else:
                held.append((scores[lo:hi], begin[lo:hi] - starts[i], end[lo:hi] - starts[i]))
    mixed = [i for i, x in enumerate(held) if x is not None and len(x) == 3]
    paths = dict(zip(mixed, viterbi([held[i][0] for i in mixed], switch), strict=True)) if mixed else {}
    out: list[tuple[str, float, list[tuple[str, int, int]]]] = []
    for i, x in enumerate(held):
        if x is None:
            out.append((UNKNOWN, 0.0, []))
        elif i not in paths:
            out.append((model.langs[x[0]], 1.0, [(model.langs[x[0]], x[1], x[2])]))
        else:
            path, begin, end = paths[i], x[1], x[2]
            size = np.bincount(path, end - begin, len(model.langs))
            first = np.flatnonzero(np.diff(path, prepend=-1))
            last = np.append(first[1:], len(path)) - 1
            spans = [(model.langs[path[f]], int(begin[f]), int(end[e])) for f, e in zip(first, last, strict=True)]
            out.append((model.langs[int(size.argmax())], float(size.max() / size.sum()), spans))
    return out


def fit(docs: DataFrame, *, rows: int = ROWS, chars: int = CHARS) -> Model:
    """Learn from a bounded sample of the documents with a lang whose crc32(doc_id) mod 4 is not 2."""
    return train(training_rows(clean(docs, "doc_id", "text", "lang").where(remainder(4) != 2).withColumnRenamed("lang", "label"), rows, chars))


def label_spans(docs: DataFrame, model: Model, *, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score and spans (array of lang, begin, end) of every whole text.

    lang_pred is the language of most letters on the best path, score their
    share; a null text or one without letters is `und` with score 0 and no
    spans. Ties go to the language that comes first. Repeated rows are kept.
    """
    spark = ready(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)  # BUCKETS rows of one number a language
    span = pa.list_(pa.struct([("lang", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        memo = tv.Memo(max(1, len(known.langs)), bits=19 if len(known.langs) <= 8 else 16)
        for batch in batches:
            got = label_texts([t or "" for t in batch.column(1).to_pylist()], known, memo, switch)
            spans = [[{"lang": y, "begin": a, "end": b} for y, a, b in x[2]] for x in got]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array(spans, span)], names=["doc_id", "lang_pred", "score", "spans"])

    return documents(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<lang: string, begin: long, end: long>>")


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans: learned from the rows not held out, predicted for all."""
    held = F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out")
    return label_spans(docs, fit(docs)).select("doc_id", held, "lang_pred", "score", "spans")
