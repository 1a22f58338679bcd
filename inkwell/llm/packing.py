"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Lengths are whole numbers up to the capacity, so a histogram of lengths, of
bounded size, says all that packing needs. The plan is made on that histogram:
documents above one third of the capacity are matched greedily, at most two to
a sequence (the longest with the longest that fits beside it), and smaller
documents go, longest first, into the smallest gap that holds them. The plan
speaks of ranges of ranks within a length; each document then finds its place
from its own rank, which is worked out without gathering a length in one task.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .runtime import chunks, clean, keep, ready, running

CAPACITY = 4096
END_ID = 1
#: A plan of more rows than this is joined by shuffle instead of broadcast (6 numbers a row: 5 MB).
BROADCAST_ROWS = 100_000
#: Ids kept for known words in a worker, 4 bytes each.
POOL = 1_500_000

_encoders: dict[str, Encoder] = {}


def plain() -> np.ndarray:
    """Code points that normalisation leaves alone but for simple lower case; texts with others go to the tokenizer whole."""
    ok = np.zeros(0x110000, bool)
    for low, high in ((0x20, 0x7F), (0xA0, 0x130), (0x131, 0x300), (0x400, 0x483), (0x2010, 0x2028), (0x2030, 0x205F), (0x20AC, 0x20AD)):
        ok[low:high] = True
    ok[[9, 10, 11, 12, 13]] = True
    return ok


class Encoder:
    """The tokenizer's ids for whole batches of texts.

    The tokenizer works on each distinct piece of text between its own split
    points; what it says is remembered, so common words are encoded once.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already, and threads hold memory of their own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = plain()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.memo = tv.Memo(2, bits=19, kind=np.int32)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, words: list[str]) -> np.ndarray:
        """Puts the ids of each word in the pool; returns (offset, number of ids)."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter((len(x) for x in ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        rows = np.stack([self.used + np.cumsum(sizes) - sizes, sizes], axis=1).astype(np.int32)
        self.used += len(flat)
        return rows

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if self.used > POOL:
            self.forget()
        apart: dict[int, np.ndarray] = {}
        codes, starts = tv.points(texts)
        if not self.plain[codes].all():
            odd = np.flatnonzero(~np.logical_and.reduceat(self.plain[codes], starts))
            apart |= {int(i): self.whole(texts[i]) for i in odd}
        for i, t in enumerate(texts):
            if "<|" in t and i not in apart and any(x in t for x in self.specials):
                apart[i] = self.whole(t)
        if apart:
            texts = ["" if i in apart else t for i, t in enumerate(texts)]
        codes, starts = tv.points([t.lower() for t in texts])
        begin, end = split(codes)
        rows = self.memo.get(h := tv.hashes(codes, begin, end), lambda at: self.learn(tv.strings(codes, begin[at], end[at])))
        del h
        offset, size = rows[:, 0].astype(np.int64), rows[:, 1].astype(np.int64)
        flat = self.pool[np.repeat(offset - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        last = np.concatenate(([0], np.cumsum(size)))
        cut = last[np.append(np.searchsorted(begin, starts), len(begin))]
        return [apart[i] if i in apart else flat[cut[i] : cut[i + 1]] for i in range(len(texts))]


def split(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokenizer's pieces begin and end: contractions, runs of letters, single numerals, runs of other marks."""
    kind = tv.classes()[codes]
    before = np.concatenate(([tv.SPACE], kind[:-1]))
    edge = kind != before
    edge |= kind == tv.NUMBER
    mark = np.flatnonzero(codes == 39)
    mark = mark[before[mark] != tv.OTHER]
    if len(mark):
        padded = np.concatenate([codes, np.zeros(3, np.uint32)])
        one, two = padded[mark + 1], padded[mark + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for found, n in ((mark[short], 2), (mark[long], 3)):
            edge[found + 1] = False
            edge[found + n] = True
    at = np.flatnonzero(edge)
    real = kind[at] != tv.SPACE
    nxt = np.append(at[1:], len(codes))
    return at[real], nxt[real]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenise whole texts and cut those longer than the capacity.

    Rows: doc_id, piece, start, length, ids_crc32, and ids (array) if asked
    for. A null text is an empty one; each document ends in end_id, so every
    document has a piece. Repeated rows are kept. Null doc_ids stay null.
    """
    ready(docs.sparkSession)
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    kinds += [("ids", pa.list_(pa.int32()))] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts):
                rows: list[tuple] = []
                for i, ids in enumerate(known.encode(texts[a:b]), a):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        rows.append((i, piece, start, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] * with_ids)))
                columns = [list(c) for c in zip(*rows, strict=True)]
                arrays = [keys.take(pa.array(columns[0], pa.int64())).cast(pa.int64())] + [pa.array(c, kind) for c, (_, kind) in zip(columns[1:], kinds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in kinds])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return clean(docs, "doc_id", "text").mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Places for counts[length] pieces of each length.

    Rows (length, first_rank, n, first_bin, bins, offset): the pieces of this
    length with ranks first_rank .. first_rank+n-1 go round the bins first_bin
    .. first_bin+bins-1, each round starting `length` further than the one
    before, the first at `offset`.
    """
    left = {s: n for s, n in counts.items() if n}
    rank = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    bins = 0

    def put(size: int, n: int, first: int, count: int, offset: int) -> None:
        rows.append((size, rank[size], n, first, count, offset))
        rank[size] += n
        left[size] -= n

    def gap(size: int, first: int, count: int) -> None:
        if size and count:
            if size not in gaps:
                gaps[size] = []
                insort(order, size)
            gaps[size].append((first, count))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        if at < 0:
            n = left[a]
            put(a, n, bins, n, 0)
            gap(capacity - a, bins, n)
        elif (b := large[at]) == a:
            n = left[a] // 2
            if n:
                put(a, 2 * n, bins, n, 0)
                gap(capacity - 2 * a, bins, n)
            else:  # the last one of its length: beside the longest shorter one
                b = large[at - 1] if at else 0
                n = 1
                put(a, 1, bins, 1, 0)
                if b:
                    put(b, 1, bins, 1, a)
                gap(capacity - a - b, bins, 1)
        else:
            n = min(left[a], left[b])
            put(a, n, bins, n, 0)
            put(b, n, bins, n, a)
            gap(capacity - a - b, bins, n)
        bins += n
        large = [x for x in large if left[x]]

    for s in sorted((s for s in left if left[s]), reverse=True):
        while left[s]:
            at = bisect_left(order, s)
            if at == len(order):
                each = capacity // s
                n = -(-left[s] // each)
                gap(capacity, bins, n)
                bins += n
                continue
            g = order[at]
            first, count = gaps[g].pop()
            if not gaps[g]:
                del gaps[g], order[at]
            each = g // s
            full = min(count, left[s] // each)
            if full:
                put(s, full * each, first, full, capacity - g)
                gap(g - each * s, first, full)
                gap(g, first + full, count - full)
            else:
                n = left[s]
                put(s, n, first, 1, capacity - g)
                gap(g - n * s, first, 1)
                gap(g, first + 1, count - 1)
    return rows


def pack(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...).

    Each sequence is filled from 0 without gaps. Pieces are ranked within
    their length by a hash of (doc_id, piece); equal rows take any order among
    themselves. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan(counts, capacity)
    places = spark.createDataFrame(rows, "_length long, _rank long, _n long, _bin long, _bins long, _offset long")
    places = F.broadcast(places) if len(rows) <= BROADCAST_ROWS else places.hint("merge")
    ranked = running(pieces, ["length"], [F.col("doc_id"), F.col("piece")], F.lit(1), "_at", sum(counts.values()))
    on = (F.col("length") == F.col("_length")) & (F.col("_at") >= F.col("_rank")) & (F.col("_at") < F.col("_rank") + F.col("_n"))
    k = F.col("_at") - F.col("_rank")
    placed = ranked.join(places, on)
    return placed.select(*(F.col(f"`{c}`") for c in pieces.columns), (F.col("_bin") + k % F.col("_bins")).alias("sequence_id"), (F.col("_offset") + F.floor(k / F.col("_bins")).cast("long") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack all documents; one row per piece."""
    return pack(keep(token_pieces(docs, tokenizer, capacity=capacity, end_id=end_id, with_ids=with_ids), "pieces"), capacity=capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the length of each document's piece for attention masks.

    Needs the ids column. A sequence holds at most `capacity` ids, so each
    group is of bounded size.
    """
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("_p"))
    return parts.select("sequence_id", F.flatten(F.col("_p.ids")).alias("ids"), F.col("_p.length").alias("piece_lengths"))
