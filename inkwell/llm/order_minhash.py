"""Near-duplicate documents by order MinHash, verified by banded alignment.

A document is the sequence of its shingles of five words, and of two (lower
case, between white space), each labelled with the number of times it has come before. A
sketch takes the labelled shingles with the smallest values under one hash
function and joins them in text order; documents close in edits share many of
their sketches. Two documents are near copies if the longest common
subsequence of their words, L, is at least 0.8 of n1 + n2 - L. That is edit
similarity of words: up to one word in nine replaced, or a quarter put in.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textvec as tv
from .runtime import chunks, clean, components, keep, ready

WORDS, SIMILAR = 5, 0.8
#: Sketches of each document: (words in a shingle, sketches, labelled shingles in one). Five-word shingles tell texts apart that
#: share common phrases; at the threshold they miss near copies with many words put in, which break up most of them, so the
#: larger part are of pairs. With one word in nine replaced two texts share 0.39 of the former and 0.65 of the latter and miss
#: each other with probability 4e-4; with a quarter put in (0.16 and 0.5) with 0.07.
NUMBERS = ((WORDS, 12, 2), (2, 18, 3))
#: Texts of up to SHORT words have SHORT_NUMBER sketches of two pairs each; of up to TINY words all twos of their pairs, which
#: near copies of at least four words share without exception. Two near copies differ in length by a quarter of the shorter
#: one at most, so the ranges overlap by so much.
TINY, SHORT, SHORT_NUMBER = 9, 38, 30
#: Documents of a bucket in one block, and pairs that a document aligns first.
BLOCK, FIRST = 768, 4
#: Eighths of the buckets that are compared one after the other, and pairs that a document hands on from a block pair there:
#: what the first eighth links need not be compared in the others. A bucket that left pairs out is compared again with
#: GROWTH times as many.
WAVES, GROWTH = ((0, 1, 8), (1, 8, 32)), 16
#: Least bits for each word in a document's bitmap of words, and most bits of one.
SPARSE, BITS = 6, 1 << 17
#: Bits of the filter on the ids of documents to be aligned: at most FILTER / 64 rows are broadcast (4 MB).
FILTER = 1 << 24
#: Pairs of one document that one task meets.
HUB = 2000


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts, and each text's first word (one more at the end)."""
    codes, starts = tv.points(texts)
    codes = tv.lower(codes)
    begin, end = tv.spans(tv.classes()[codes] != tv.SPACE)
    return tv.hashes(codes, begin, end), np.append(np.searchsorted(begin, starts), len(begin))


def labelled_values(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Each value hashed with the number of times that its text has had it before; cut: each text's first (one more at the end)."""
    key = values ^ tv.mix(np.repeat(np.arange(len(cut) - 1), np.diff(cut)).astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = np.concatenate(([False], key[order[1:]] == key[order[:-1]])) if len(order) else np.zeros(0, bool)
    if not same.any():
        return values
    i = np.arange(len(order))
    seen = np.empty(len(order), np.uint64)
    seen[order] = i - np.maximum.accumulate(np.where(same, 0, i))
    return np.where(seen > 0, tv.mix(values + seen * tv.POWERS[2]), values)


def text_marks(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Two hashes of each text's words, zero without words."""
    n = np.diff(cut)
    at = (np.arange(len(h)) - np.repeat(cut[:-1], n)).astype(np.uint64)
    marks = np.zeros((2, len(n)), np.uint64)
    full = np.flatnonzero(n > 0)
    if len(full):
        for k in range(2):
            marks[k, full] = np.add.reduceat(tv.mix(h ^ tv.mix(at * np.uint64(2) + np.uint64(k + 1))), cut[full])
    return marks


def shingles(h: np.ndarray, cut: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Labelled shingles of all texts, and each text's first (one more at the end). A text of fewer than `words` words has none."""
    m = np.maximum(np.diff(cut) - words + 1, 0)
    edge = np.concatenate(([0], np.cumsum(m)))
    where = np.repeat(cut[:-1] - edge[:-1], m) + np.arange(edge[-1])
    own = np.zeros(len(where), np.uint64)
    for j in range(words):
        own = own * tv.POWERS[0] + h[where + j]
    return labelled_values(tv.mix(own), edge), edge


def sketches(h: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The sketches of one text from its words' hashes and its labelled five-word shingles."""
    if len(h) < 4:
        return np.zeros(0, np.uint64)
    out, first = [], 0
    pairs = shingles(h, np.array([0, len(h)]), 2)[0]
    if len(h) <= TINY:
        i, j = np.triu_indices(len(pairs), 1)
        out.append(tv.mix(tv.mix(pairs[i] + tv.POWERS[4]) * tv.POWERS[3] + pairs[j]))
    if 0.8 * TINY <= len(h) <= SHORT:
        out.append(tv.mix(_taken(pairs, SHORT_NUMBER, 2) + tv.POWERS[4]))
    if len(h) >= 0.8 * SHORT:
        for words, number, taken in NUMBERS:
            out.append(tv.mix(_taken(own if words == WORDS else pairs, number, taken, first) + np.uint64(words)))
            first += number
    return np.concatenate(out)


def _taken(labels: np.ndarray, number: int, taken: int, first: int = 0) -> np.ndarray:
    """For each of `number` hash functions from the one numbered `first` its smallest labelled shingles, hashed in text order."""
    n, out = len(labels), np.empty(number, np.uint64)
    odd = tv.mix(np.arange(first + 1, first + number + 1, dtype=np.uint64)) | np.uint64(1)
    taken = min(taken, n)
    step = max(1, 4_000_000 // n)
    for a in range(0, number, step):
        values = labels[None, :] * odd[a : a + step, None]
        if n > 8 * taken:
            below = values < np.uint64(min(2**64 - 1, int(2.0**64 * 4 * taken / n)))
            row, col = np.nonzero(below)
            size = np.bincount(row, minlength=len(values))
            if (size < taken).any():
                short = np.flatnonzero(size < taken)
                keep_rows = ~np.isin(row, short)
                more = np.argpartition(values[short], taken - 1, axis=1)[:, :taken]
                row = np.concatenate([row[keep_rows], np.repeat(short, taken)])
                col = np.concatenate([col[keep_rows], more.ravel()])
            order = np.lexsort((values[row, col], row))
            row, col = row[order], col[order]
            begin = np.searchsorted(row, np.arange(len(values)))
            best = col[begin[:, None] + np.arange(taken)]
        else:
            best = np.argsort(values, axis=1, kind="stable")[:, :taken]
        best.sort(axis=1)
        h = np.arange(first + a, first + a + len(values), dtype=np.uint64)
        for k in range(taken):
            h = tv.mix(h * tv.POWERS[3] + labels[best[:, k]])
        out[a : a + step] = h
    return out


def bitmap(labels: np.ndarray) -> bytes:
    """A text's labelled words as the set bits of a power of two of bits, at least SPARSE for each word up to BITS."""
    size = min(BITS, max(64, 1 << (SPARSE * len(labels) - 1).bit_length()))
    bits = np.zeros(size, np.uint8)
    bits[(tv.mix(labels) & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def signatures(docs: DataFrame, *, words: int = WORDS) -> DataFrame:
    """doc_id, h (hash of the text), two hashes of the words (null without words), n words, the sketches and the bitmap of every whole text."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in chunks(texts):
                h, cut = words_of(texts[a:b])
                own, edge = shingles(h, cut, words)
                bags = labelled_values(h, cut)
                got = [sketches(h[i:j], own[k:m]).view(np.int64) for i, j, k, m in zip(cut[:-1], cut[1:], edge[:-1], edge[1:], strict=True)]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in got]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(got)))
                maps = pa.array([bitmap(bags[i:j]) if len(x) else None for i, j, x in zip(cut[:-1], cut[1:], got, strict=True)], pa.binary())
                marks = (pa.array(m.view(np.int64), mask=np.diff(cut) == 0) for m in text_marks(h, cut))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a).cast(pa.int64()) for c in (0, 1)), *marks, pa.array(np.diff(cut)), lists, maps], names=["doc_id", "h", "mark1", "mark2", "n", "sketches", "bits"])

    return clean(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, mark1 long, mark2 long, n long, sketches array<long>, bits binary")


def chain(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Which of these points (in order of `at`, then falling `to`) form a longest chain that rises in both."""
    if len(to) < 2 or (np.diff(to) > 0).all():
        return np.arange(len(to))
    tails, last, before = [], [], np.full(len(to), -1)
    for i, x in enumerate(to.tolist()):
        k = bisect_left(tails, x)
        if k:
            before[i] = last[k - 1]
        if k == len(tails):
            tails.append(x)
            last.append(i)
        else:
            tails[k], last[k] = x, i
    out = [last[-1]]
    while before[out[-1]] >= 0:
        out.append(int(before[out[-1]]))
    return np.array(out[::-1])


def anchored(a: np.ndarray, b: np.ndarray, words: int = WORDS) -> int:
    """Length of a common subsequence that follows common shingles: never more than the longest one's, and mostly equal."""
    la, lb = (shingles(x, np.array([0, len(x)]), words)[0] for x in (a, b))
    _, at, to = np.intersect1d(la, lb, assume_unique=True, return_indices=True)
    order = np.argsort(at, kind="stable")
    best = chain(at[order], to[order])
    at, to = at[order][best], to[order][best]
    if not len(at):
        return 0
    points = np.unique(((at[:, None] + np.arange(words)) * (len(b) + 1) + (len(b) - to[:, None] - np.arange(words))).ravel())
    at, to = points // (len(b) + 1), len(b) - points % (len(b) + 1)
    best = chain(at, to)
    at, to = at[best], to[best]
    step = np.flatnonzero((np.diff(at) == np.diff(to)) & (np.diff(at) > 1))  # words replaced one by one
    size = np.diff(at)[step] - 1
    off = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + 1
    return len(at) + int((a[np.repeat(at[step], size) + off] == b[np.repeat(to[step], size) + off]).sum())


def banded(a: np.ndarray, b: np.ndarray, below: int, above: int) -> int:
    """Longest common subsequence that skips at most `below` elements of a and `above` of b, row by row within that band."""
    width = below + above + 1
    row = np.zeros(width, np.int64)  # row[k] belongs to b's prefix of i - below + k elements
    padded = np.concatenate([np.zeros(below, np.uint64), b, np.zeros(above + 1 + len(a), np.uint64)])
    inside = np.arange(width) - below
    for i in range(len(a)):
        j = inside + i  # a[i] against b[j]: the new entry k ends at b[j]
        hit = (padded[i : i + width] == a[i]) & (j >= 0) & (j < len(b))
        row = np.maximum(np.append(row[1:], 0), row + hit)
        row = np.maximum.accumulate(row)
    return int(row.max())


def aligned(a: np.ndarray, b: np.ndarray, similar: float = SIMILAR, words: int = WORDS) -> float:
    """L / (n1 + n2 - L) of two sequences of words, or 0 where it stays below `similar`.

    What both begin and end with is common. Of the rest a chain along common
    shingles gives a common subsequence; where that is too short, but the
    words in any order would do, the band that a similar pair cannot leave is
    searched row by row.
    """
    total = len(a) + len(b)
    need = similar / (1 + similar) * total - 1e-9
    least = min(len(a), len(b))
    if least < need:
        return 0.0
    differ = np.flatnonzero(a[:least] != b[:least])
    head = int(differ[0]) if len(differ) else least
    differ = np.flatnonzero(a[len(a) - least + head :][::-1] != b[len(b) - least + head :][::-1])
    tail = int(differ[0]) if len(differ) else least - head
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    size = head + tail
    if len(x) and len(y):
        one, two = (np.unique(v, return_counts=True) for v in (x, y))
        _, i, j = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
        if size + np.minimum(one[1][i], two[1][j]).sum() < need:
            return 0.0
        more = anchored(x, y, words)
        if size + more < need:
            more = banded(x, y, int(len(a) - need), int(len(b) - need))
        size += more
    return size / (total - size) if size >= need else 0.0


def beside(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """pairs (a, b and more) with the value of each end as _a and _b. values: one row (doc_id, value) per document.

    One document can be the first end of very many pairs, so the second ends'
    values are joined first; a first end of over HUB pairs is then met in
    parts, to each of which its value is sent.
    """
    name = values.columns[1]
    many = pairs.groupBy(F.col("a").alias("_h")).count().where(F.col("count") > HUB).select("_h", F.ceil(F.col("count") / HUB).cast("int").alias("_parts"))
    many = keep(many, "hubs")
    right = pairs.join(values.select(F.col("doc_id").alias("b"), F.col(name).alias("_b")), "b")
    left = values.select(F.col("doc_id").alias("_d"), F.col(name).alias("_a"))
    if many.isEmpty():
        return right.join(left, F.col("a") == F.col("_d")).drop("_d")
    right = right.join(many, F.col("a") == F.col("_h"), "left").withColumn("_part", F.pmod(F.xxhash64("b"), F.coalesce("_parts", F.lit(1)))).drop("_h", "_parts")
    left = left.join(many, F.col("_d") == F.col("_h"), "left").select("_d", "_a", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_at"))
    return right.join(left, (F.col("a") == F.col("_d")) & (F.col("_part") == F.col("_at"))).drop("_d", "_part", "_at")


def verified(pairs: DataFrame, texts: DataFrame, *, words: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose texts are near copies. texts: one row per doc_id."""
    both = beside(pairs.select("a", "b"), texts.select("doc_id", "text")).select("a", "b", F.col("_a").alias("ta"), F.col("_b").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = ([t or "" for t in batch.column(c).to_pylist()] for c in (2, 3))
            good: list[int] = []
            for s, e in chunks([x if len(x) > len(y) else y for x, y in zip(one, two, strict=True)]):
                (p, cp), (q, cq) = words_of(one[s:e]), words_of(two[s:e])
                good += [s + i for i in range(e - s) if aligned(p[cp[i] : cp[i + 1]], q[cq[i] : cq[i + 1]], similar, words) > 0]
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return both.mapInArrow(run, "a long, b long")


def place(column: str) -> Column:
    """The bit of an id in the filter."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(FILTER))


def filter_words(ids: DataFrame) -> DataFrame:
    """(word, _bits): a filter of FILTER bits on the column doc_id, in words of 64 bits; of fixed size whatever the corpus."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place("doc_id") % 64).cast("int"))
    return ids.select(F.floor(place("doc_id") / 64).cast("long").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("_bits"))


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is among ids, which are distinct. The filter drops most other documents before any text is shuffled; the join after it is exact."""
    near = rows.where(F.col("doc_id").isNotNull()).join(F.broadcast(filter_words(ids)), F.floor(place("doc_id") / 64).cast("long") == F.col("word")).where(F.getbit("_bits", (place("doc_id") % 64).cast("int")) == 1)
    return near.select(*rows.columns).join(ids, "doc_id")  # a semi-join would be moved below the filter


def involved(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """One text for each document that a pair names: of a doc_id with several, that with the smallest hash."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    return among(clean(docs, "doc_id", "text"), ids).groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def labelled(rows: DataFrame, column: str, reached: DataFrame, out: str) -> DataFrame:
    """Adds the component of a column's document, itself if it has no link."""
    parts = reached.select(F.col("id").alias("_id"), F.col("component").alias("_part"))
    return rows.join(parts, F.col(column) == F.col("_id"), "left").withColumn(out, F.coalesce("_part", column)).drop("_id", "_part")


def distances(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Bits in which each row of `one` differs from each row of `two`, of the same width."""
    out = np.empty((len(one), len(two)), np.int64)
    step = max(1, 500_000 // max(1, two.size))
    for a in range(0, len(one), step):
        out[a : a + step] = np.bitwise_count(one[a : a + step, None, :] ^ two[None, :, :]).sum(axis=2, dtype=np.int64)
    return out


def here_first(x: np.ndarray, y: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """Which pairs of rows share none of these sketches; 0 fills a row up."""
    out = np.ones(len(x), bool)
    for s in range(0, len(x), 4096):
        a, b = sketches[x[s : s + 4096]], sketches[y[s : s + 4096]]
        same = np.zeros(len(a), bool)
        for k in range(a.shape[1]):
            same |= ((a[:, k, None] == b) & (a[:, k, None] != 0)).any(axis=1)
        out[s : s + 4096] = ~same
    return out


def earlier(sketches: list[np.ndarray], key: int, wave: tuple[int, int]) -> np.ndarray:
    """Of each row the sketches of the wave that come before this bucket's, in a matrix filled up with 0."""
    own = [x[(x < key) & (x % 8 >= wave[0]) & (x % 8 < wave[1]) & (x != 0)] for x in sketches]
    out = np.zeros((len(own), max([1, *map(len, own)])), np.int64)
    for i, x in enumerate(own):
        out[i, : len(x)] = x
    return out


def block_pairs(side: np.ndarray, ids: np.ndarray, n: np.ndarray, part: np.ndarray, bits: list[bytes], limit: int, similar: float = SIMILAR, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Pairs (smaller id, larger id, share of bits that differ) of one block pair that differ in class and may be near copies, and whether any was left out.

    side: 0 and 1 where rows of side 0 meet those of side 1 only, 2 where all
    meet. before: each row's sketches whose buckets come first; a pair that
    shares one of them is met there. Each row hands on its `limit` nearest by bitmap. Two near copies
    share at least `need` words, so at most n1 + n2 - 2 need bits differ: no
    near copy is dropped by that. A wider bitmap is folded to the narrower
    one's width; lengths of near copies are so close that one fold serves.
    """
    width = np.array([len(x) // 8 for x in bits])
    far: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for w in np.unique(width):
        at, up = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        own = np.frombuffer(b"".join(bits[i] for i in at), np.uint64).reshape(len(at), w)
        if len(up):
            wide = np.frombuffer(b"".join(bits[i] for i in up), np.uint64).reshape(len(up), 2 * w)
            own, at = np.concatenate([own, wide[:, :w] | wide[:, w:]]), np.concatenate([at, up])
        low = width[at] == w
        # parts in order of size, so that each row meets only rows of other parts
        _, code, size = np.unique(part[at], return_inverse=True, return_counts=True)
        order = np.lexsort((at, code, -size[code]))
        at, own, low, code = at[order], own[order], low[order], code[order]
        edges = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1], [True])))
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            if e == len(at):
                break
            step = max(1, 200_000 // (len(at) - e))
            for c in range(s, e, step):
                i, j = np.arange(c, min(e, c + step)), np.arange(e, len(at))
                total = n[at[i]][:, None] + n[at[j]][None, :]
                most = total - 2 * (similar / (1 + similar) * total - 1e-9)
                fit = (np.minimum(n[at[i]][:, None], n[at[j]][None, :]) >= np.maximum(n[at[i]][:, None], n[at[j]][None, :]) * similar) & (low[i][:, None] | low[j][None, :])
                fit &= (side[at[i]][:, None] != side[at[j]][None, :]) | (side[at[i]][:, None] == 2)
                if not fit.any():
                    continue
                i, j = i[fit.any(axis=1)], j[fit.any(axis=0)]
                kept = np.ix_(i - c, j - e)
                apart = distances(own[i], own[j])
                x, y = np.nonzero(fit[kept] & (apart <= most[kept]))
                far.append((at[i[x]].astype(np.int32), at[j[y]].astype(np.int32), (apart[x, y] / total[kept][x, y]).astype(np.float32)))
    x, y, d = (np.concatenate(c) for c in zip(*far, strict=True)) if far else (np.zeros(0, np.int32),) * 3
    if before is not None and len(x):
        mine = here_first(x, y, before)
        x, y, d = x[mine], y[mine], d[mine]
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), False
    a, b = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
    pairs = np.arange(len(x), dtype=np.int32)
    ends, whose = np.concatenate([x, y]), np.concatenate([pairs, pairs])
    order = np.lexsort((b[whose], a[whose], d[whose], ends))
    first = np.flatnonzero(np.diff(ends[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    chosen = np.unique(whose[order][rank < limit])
    return a[chosen], b[chosen], d[chosen], len(chosen) < len(x)


def likely(pairs: DataFrame, bits: DataFrame, *, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, na, b, nb) that bitmaps do not rule out, as (a, b): see `block_pairs`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for na, nb, one, two in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "_a", "_b")), strict=True):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                while len(x) != len(y):
                    x, y = (x, y) if len(x) < len(y) else (y, x)
                    y = y[: len(y) // 2] | y[len(y) // 2 :]
                ok.append(int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) <= na + nb - 2 * (similar / (1 + similar) * (na + nb) - 1e-9))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return beside(pairs.select("a", "na", "b", "nb"), bits.select("doc_id", "bits")).mapInArrow(run, "a long, b long")


def blocks_apart(placed: DataFrame, main: DataFrame, bits: DataFrame, limit: int, wave: tuple[int, int], *, similar: float = SIMILAR) -> DataFrame:
    """(key, a, b, d, more): pairs of different classes that a bucket holds and bitmaps do not rule out, and the share of bits that differ.

    A bucket of up to BLOCK documents is one block. Of a larger one the class
    that has most of it and the rest are dealt into blocks of about BLOCK
    documents by a hash; every block of the rest meets every block, each two
    in one task. A pair that meets in several buckets of the wave is handed on
    by the first. more: pairs of that task were left out, as each document
    hands on its `limit` nearest ones there.
    """
    rows = placed.join(main.select("k", "main", "total", (F.floor((F.col("most") - 1) / BLOCK) + 1).alias("_m"), (F.floor((F.col("total") - F.col("most") - 1) / BLOCK) + 1).alias("_r")), F.col("key") == F.col("k"))
    rows = rows.withColumn("_rest", F.col("part") != F.col("main")).withColumn("_own", F.pmod(F.xxhash64("a", "key"), F.when(F.col("_rest"), F.col("_r")).otherwise(F.col("_m"))))
    small = F.col("total") <= BLOCK
    alone = rows.where(small).select("key", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), "a", "na", "part", F.lit(2).alias("side"))
    rows = rows.where(~small)
    # blocks of the rest are numbered from 0, those of the main class are -1, -2 and so on
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_r") - 1), lambda r: F.struct(F.least(r, F.col("_own")).alias("lo"), F.greatest(r, F.col("_own")).alias("hi")))
    mains = F.transform(F.sequence(F.lit(1).cast("long"), F.col("_m")), lambda m: F.struct((-m).alias("lo"), F.col("_own").alias("hi")))
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_r") - 1), lambda r: F.struct((-F.col("_own") - 1).alias("lo"), r.alias("hi")))
    rows = rows.select("key", "a", "na", "part", "_rest", "_own", F.explode(F.when(F.col("_rest"), F.concat(others, mains)).otherwise(met)).alias("_p"))
    side = F.when(F.col("_p.lo") == F.col("_p.hi"), 2).when(F.col("_rest") & (F.col("_own") == F.col("_p.hi")), 1).otherwise(0)
    rows = alone.union(rows.select("key", F.col("_p.lo").alias("lo"), F.col("_p.hi").alias("hi"), "a", "na", "part", side.alias("side")))
    rows = rows.join(bits.withColumnRenamed("doc_id", "_d"), F.col("a") == F.col("_d")).drop("_d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            key = t.column("key")[0].as_py()
            before = earlier([np.array(x, np.int64) for x in t.column("sketches").to_pylist()], key, wave)
            a, b, d, more = block_pairs(*(t.column(c).to_numpy() for c in ("side", "a", "na", "part")), t.column("bits").to_pylist(), limit, similar, before)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([key] * len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.float32()), pa.array([more] * len(a), pa.bool_())], names=["key", "a", "b", "d", "more"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if held and tuple(key[s]) != last:
                    yield done()
                held.append(batch.slice(s, e - s))
                last = tuple(key[s])
        if held:
            yield done()

    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "key long, a long, b long, d float, more boolean")


def still_apart(members: DataFrame, reached: DataFrame, bits: DataFrame, limit: int, wave: tuple[int, int], *, similar: float = SIMILAR) -> DataFrame:
    """(key, a, b, d, more): pairs of a bucket that lie in different components and may be near copies.

    Buckets of all sizes are compared block by block, see `blocks_apart`; a
    pair is due if it meets in one bucket. The bucket's smallest document is
    left out: every other one was held against it before. bits: doc_id, bitmap and sketches of every
    document in members. wave: the eighths of the buckets that members holds.
    """
    placed = keep(labelled(members.where("a <> b"), "a", reached, "part").select("key", "a", "na", "part"), "placed")
    parts = placed.groupBy("key", "part").agg(F.count("*").alias("n"))
    main = parts.groupBy(F.col("key").alias("k")).agg(F.sum("n").alias("total"), F.count("*").alias("parts"), F.max(F.struct("n", (-F.col("part")).alias("p"))).alias("m")).where("parts > 1")
    main = keep(main.select("k", "total", F.col("m.n").alias("most"), (-F.col("m.p")).alias("main")), "main")
    return blocks_apart(placed, main, bits, limit, wave, similar=similar)


def closest(due: DataFrame, limit: int) -> DataFrame:
    """The pairs (a, b) that are among the `limit` nearest of one of their documents."""
    ends = due.select(F.col("a").alias("id"), "a", "b", "d").union(due.select(F.col("b").alias("id"), "a", "b", "d"))
    order = Window.partitionBy("id").orderBy("d", "a", "b")
    return ends.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).select("a", "b").distinct()


def told_apart(signed: DataFrame) -> DataFrame:
    """(id, h, node): the rows of ids that have several texts, but those with the smallest hash, whose node is the id itself. Nodes are hashes that no id equals."""
    rows = signed.where("doc_id is not null").select(F.col("doc_id").alias("id"), "h")
    twice = rows.groupBy("id").agg(F.min(F.coalesce("h", F.lit(0))).alias("_h"), F.max(F.coalesce("h", F.lit(0))).alias("_last")).where("_h <> _last").drop("_last")
    twice = keep(twice, "twice")
    if twice.isEmpty():
        return signed.sparkSession.createDataFrame([], "id long, h long, node long")
    others = rows.join(twice, "id").where("coalesce(h, 0) <> _h").select("id", "h").distinct()
    salt = 0
    while True:
        nodes = keep(others.withColumn("node", F.xxhash64(F.lit(salt), "id", "h")), "nodes")
        if nodes.join(rows.select(F.col("id").alias("node")), "node", "left_semi").isEmpty() and nodes.select("node").distinct().count() == nodes.count():
            return nodes
        salt += 1


def by_node(rows: DataFrame, apart: DataFrame) -> DataFrame:
    """rows (doc_id, h and more) with the node of each as doc_id, and the id as _own."""
    known = apart.select(F.col("id").alias("_i"), F.col("h").alias("_x"), "node")
    found = rows.join(known, (F.col("doc_id") == F.col("_i")) & F.col("h").eqNullSafe(F.col("_x")), "left")
    return found.withColumn("_own", F.col("doc_id")).withColumn("doc_id", F.coalesce("node", "doc_id")).drop("_i", "_x", "node")


def classes(docs: DataFrame, *, words: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id, kept for every row: class_id is the smallest doc_id reachable over near copies, kept marks the class's document.

    Equal word sequences fall into one class first, and one of them goes on.
    Each document is aligned with one other: of the smallest documents of its
    buckets (sketches) the one that it meets most often. A large group of near
    copies becomes one class by that, or a few. Each document is then aligned
    with the smallest ones of its buckets that are in another class still. What
    the buckets still hold of different classes follows in WAVES, see
    `still_apart`: each document is aligned with its nearest ones of other
    classes, then with all that are in another class still; a bucket that left
    pairs out is compared again. Null texts and
    texts without words are alone. Rows that repeat a doc_id are judged each by
    its own text, so one doc_id can be in several classes; rows alike in both
    are all kept or none. A null doc_id has class null and is kept.
    """
    return placed_rows(docs, words=words, similar=similar).select("doc_id", "class_id", "kept")


def placed_rows(docs: DataFrame, *, words: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """doc_id, h (hash of the text), node (the id in the graph of near copies), class_id, kept: see `classes`."""
    signed = keep(signatures(docs, words=words), "signed")
    apart = told_apart(signed)
    single = apart.isEmpty()
    docs = clean(docs, "doc_id", "text")
    if not single:
        signed = keep(by_node(signed, apart), "signed")
        docs = by_node(docs.withColumn("h", F.xxhash64("text")), apart).select("doc_id", "text")
    copies = signed.where("mark1 is not null and doc_id is not null").groupBy(F.col("mark1").alias("m1"), F.col("mark2").alias("m2")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").drop("last")
    known = signed.join(copies, (F.col("mark1") == F.col("m1")) & (F.col("mark2") == F.col("m2")), "left")
    firsts = keep(known.select(*(["_own"] if not single else []), "h", "doc_id", F.coalesce("first", "doc_id").alias("first"), "n", F.when(F.col("doc_id") == F.coalesce("first", "doc_id"), F.col("sketches")).alias("sketches")), "firsts")
    sketched = firsts.where("size(sketches) > 0").dropDuplicates(["doc_id"])
    rows = sketched.select("doc_id", "n", F.explode("sketches").alias("key"))
    buckets = rows.groupBy(F.col("key").alias("k")).agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("last")).where("b <> last").drop("last")
    members = keep(rows.join(buckets, F.col("key") == F.col("k")).select("key", F.col("doc_id").alias("a"), F.col("n").alias("na"), "b"), "members")

    held = among(signed.where("bits is not null").select("doc_id", "bits", "sketches"), members.select(F.col("a").alias("doc_id")).distinct())
    bits = keep(held.groupBy("doc_id").agg(F.min(F.struct("bits", "sketches")).alias("m")).select("doc_id", "m.*"), "bits")
    sizes = sketched.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"))
    near = F.least("na", "nb") >= F.greatest("na", "nb") * similar
    met = members.where("a <> b").groupBy("a", "na", "b").agg(F.count("*").alias("times")).join(sizes, "b").where(near)
    met = keep(met, "met")

    found = docs.sparkSession.createDataFrame([], "a long, b long")
    tested, reached, rounds = found, None, 0
    most = met.groupBy("a").agg(F.max_by(F.struct("na", "b", "nb"), F.struct("times", -F.col("b"))).alias("m")).select("a", "m.*")

    def align(pairs: DataFrame) -> None:
        """Verify the pairs and follow what they link."""
        nonlocal found, tested, reached, rounds
        rounds += 1
        tested = tested.union(pairs)
        if rounds % 4 == 0:  # else plans grow with the rounds
            tested, found = keep(tested, "tested"), keep(found, "found")
        more = keep(verified(pairs, keep(involved(docs, pairs), "texts"), words=words, similar=similar), "links")
        if reached is None or not more.isEmpty():
            found = found.union(more)
            reached = components(found)

    align(keep(likely(most, bits, similar=similar).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs"))
    apart = labelled(labelled(met.select("a", "na", "b", "nb"), "a", reached, "pa"), "b", reached, "pb").where("pa <> pb").drop("pa", "pb")
    rest = likely(apart, bits, similar=similar).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    align(keep(rest.join(tested, ["a", "b"], "left_anti"), "pairs"))
    for low, high, handed in WAVES:
        wave = members.where(F.pmod("key", F.lit(8)).between(low, high - 1))
        while True:
            met = keep(still_apart(wave, reached, bits, handed, (low, high), similar=similar), "due")
            due = keep(met.groupBy("a", "b").agg(F.min("d").alias("d")).join(tested, ["a", "b"], "left_anti"), "apart")
            if not due.isEmpty():
                now = keep(closest(due, FIRST), "pairs")
                align(now)
                rest = labelled(labelled(due.select("a", "b").join(now, ["a", "b"], "left_anti"), "a", reached, "pa"), "b", reached, "pb").where("pa <> pb")
                rest = keep(rest.select("a", "b"), "pairs")
                if not rest.isEmpty():
                    align(rest)
            again = met.where("more").select("key").distinct()
            if again.isEmpty():
                break
            wave = wave.join(again, "key", "left_semi")
            handed *= GROWTH
    out = labelled(firsts, "first", reached, "root")
    if single:
        return out.select("doc_id", "h", F.col("doc_id").alias("node"), F.col("root").alias("class_id"), F.coalesce(F.col("doc_id") == F.col("root"), F.lit(True)).alias("kept"))
    told = out.groupBy(F.col("root").alias("_root")).agg(F.min(F.struct("_own", "doc_id")).alias("m"))
    out = out.join(told, F.col("root") == F.col("_root"), "left")
    return out.select(F.col("_own").alias("doc_id"), "h", F.col("doc_id").alias("node"), F.col("m._own").alias("class_id"), F.coalesce(F.col("doc_id") == F.col("m.doc_id"), F.lit(True)).alias("kept"))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is not among ids (one row for each, in a table). Only rows that hit a filter of fixed size are shuffled for the exact join."""
    words = filter_words(ids)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    sure = docs.select(F.struct(*columns).alias("_row"), F.col("doc_id").alias("_d"))
    marked = sure.join(F.broadcast(words), F.floor(place("_d") / 64).cast("long") == F.col("word"), "left")
    hit = F.coalesce(F.getbit("_bits", (place("_d") % 64).cast("int")) == 1, F.lit(False))
    passed = marked.where(~hit).select("_row")
    rest = marked.where(hit).select("_row", "_d").join(ids.select(F.col("doc_id").alias("_i")), F.col("_d") == F.col("_i"), "left_anti").select("_row")
    return passed.union(rest).select(*(F.col("_row")[c].alias(c) for c in docs.columns))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each class, all columns kept: of rows alike in doc_id and text one stays, whichever text it is that a repeated doc_id has."""
    found = keep(placed_rows(docs), "classes")
    several = keep(found.where("node <> doc_id").select("doc_id").distinct(), "several")
    repeated = keep(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id").union(several).distinct(), "repeated")
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    out = without(docs, keep(gone.join(repeated, "doc_id", "left_anti"), "dropped"))
    if repeated.isEmpty():
        return out
    columns = [F.col(f"`{c}`") for c in docs.columns]
    stays = found.where("kept").join(repeated, "doc_id").select(F.col("doc_id").alias("_i"), F.coalesce("h", F.lit(0)).alias("_x")).distinct()
    rows = out.select(F.struct(*columns).alias("_row"), F.col("doc_id").alias("_d"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_h"))
    rows = rows.join(stays, (F.col("_d") == F.col("_i")) & (F.col("_h") == F.col("_x")), "left_semi")
    one = rows.groupBy("_d", "_h").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row")).select(*(F.col("_row")[c].alias(c) for c in docs.columns))
    return without(out, repeated).union(one)
