"""Word vectors from a corpus, and likeness of texts by them.

Words that stand near each other are counted as pairs; how much oftener than by
chance they meet (positive pointwise mutual information, in whole millionths,
so that sums are exact) weighs a sum of the neighbours' random signs. The signs
are read off a digest of the neighbour, so nothing is looked up or stored for
them, and a vector has WIDTH whole numbers whatever the vocabulary.

Texts are kept once as chunks of numbered words. Pairs are counted in SLICES
turns, each over the words of one slice, and a turn's shuffle is deleted before
the next one begins: the disk holds an eighth of the pairs at any time.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.shared import kept

WINDOW, WIDTH = 4, 32
#: Parts in which a word's pairs meet its total: frequent words have a pair with most of the vocabulary.
SALTS = 16
MICRO = 1_000_000
#: Turns in which pairs are counted, words of a chunk at least (but for a task's last), and pairs that a bucket of a turn holds, repeats counted, if words were equally frequent.
SLICES, CHUNK, BUCKET = 8, 1 << 22, 3_000_000
LOW = (1 << 32) - 1


def with_total(rows: DataFrame, totals: DataFrame, word: str, other: str, out: str, salts: int = SALTS) -> DataFrame:
    """rows with the total of one of their words. The rows of a word meet it in `salts` parts by their other word.

    The parts grow with the vocabulary, `salts` times over, which Spark's estimate does not see; so they are never sent to the driver.
    """
    parts = totals.select(F.col("word").alias("_w"), F.col("total").alias(out), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_part")).hint("merge")
    return rows.withColumn("_at", F.pmod(F.xxhash64(other), F.lit(salts)).cast("int")).join(parts, (F.col(word) == F.col("_w")) & (F.col("_at") == F.col("_part"))).drop("_w", "_at", "_part")


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers in as many bytes as the largest needs, all lowest bytes first, compressed."""
    numbers = numbers.astype("<u8")
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    places = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(numbers).to_bytes(8, "little") + pa.compress(places.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(data[9:], width * n, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<i8").ravel()


def chunked(texts: DataFrame, tokens: str, window: int, least: int) -> DataFrame:
    """Texts of two words or more in chunks: for each different word of a chunk a row with its place among them and its total there, and a row with all places end to end and the texts' sizes."""

    def told(chunk: int, held: list[pa.DictionaryArray], sizes: np.ndarray) -> pa.RecordBatch:
        flat = pa.chunked_array(held).unify_dictionaries()
        names, codes = flat.chunk(0).dictionary, np.concatenate([c.indices.to_numpy() for c in flat.chunks])
        before = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        near = np.minimum(before, window) + np.minimum(np.repeat(sizes, sizes) - 1 - before, window)
        n, total = len(names), np.bincount(codes, weights=near, minlength=len(names)).astype(np.int64)
        own = [pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([packed(x)], pa.binary())]) for x in (codes, sizes)]
        words = [pa.array(np.append(np.arange(n), n), pa.int32()), pa.concat_arrays([names, pa.nulls(1, names.type)]), pa.array(np.append(total, 0))]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n + 1, chunk, np.int64)), *words, *own], names=["chunk", "place", "word", "total", "codes", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = (TaskContext.get().partitionId() * (1 << 32) + i for i in itertools.count())
        held, sizes = [], []
        for batch in batches:
            column = batch.column(0)
            column = column.filter(pc.greater(pc.fill_null(pc.list_value_length(column), 0), 1))
            if len(column):
                held.append(column.flatten().dictionary_encode())
                sizes.append(pc.list_value_length(column).to_numpy().astype(np.int64))
            if sum(map(len, held)) >= least:
                yield told(next(names), held, np.concatenate(sizes))
                held, sizes = [], []
        if held:
            yield told(next(names), held, np.concatenate(sizes))

    return texts.select(tokens).mapInArrow(run, "chunk long, place int, word string, total long, codes binary, sizes binary")


def numbered(word: str, salt: int) -> Column:
    """A word's number: above, the WIDTH signs of its digest (a set bit is minus), and 32 bits of another one below."""
    signs = F.conv(F.translate(F.md5(word), "0123456789abcdef", "0000000011111111"), 2, 10).cast("long")
    return F.shiftleft(signs, 32).bitwiseOR(F.xxhash64(F.lit(salt), F.col(word)).bitwiseAND(F.lit(LOW)))


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (ids & LOW) % buckets


def told_chunks(rows: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    """Of each chunk the numbers and totals of its words, in order of their buckets, its words by their places in that order, and its texts' sizes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at, ids, totals = (right[c].to_numpy() for c in ("place", "id", "tw"))
        by = np.argsort(bucket_of(ids, buckets), kind="stable")
        new = np.empty(len(at), np.int64)
        new[at[by]] = np.arange(len(at))
        codes = new[unpacked(left["codes"][0].as_py())]
        made = [packed(x) for x in (ids[by], totals[by], codes)]
        return pa.table({"ids": [made[0]], "totals": [made[1]], "codes": [made[2]], "sizes": left["sizes"].combine_chunks()})

    return rows.groupBy("chunk").cogroup(words.groupBy("of")).applyInArrow(run, "ids binary, totals binary, codes binary, sizes binary")


def met(chunks: DataFrame, turn: int, parts: int, window: int, frequent: float) -> DataFrame:
    """The pairs of a turn's words, counted by chunk, for each bucket: centres with totals and how many others each has; the others' numbers and totals; by pair the other's place and n.

    A pair is sent to its centre's bucket, where it serves the centre's vector
    or, if the other is frequent, the other's: so the pairs of a frequent word
    are dealt out by the word it meets.
    """

    def of(ids: np.ndarray, totals: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> dict[str, list]:
        buckets = bucket_of(ids, parts * SLICES)
        cuts = np.searchsorted(buckets, np.arange(turn * parts, (turn + 1) * parts + 1))
        at = np.flatnonzero((codes >= cuts[0]) & (codes < cuts[-1]))
        text, often = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), totals > frequent
        keys = []
        for step in (x * o for o in range(1, window + 1) for x in (1, -1)):
            here = at[: np.searchsorted(at, len(codes) - step)] if step > 0 else at[np.searchsorted(at, -step) :]
            here = here[text[here] == text[here + step]]
            a, b = codes[here], codes[here + step]
            both = a << 32 | b
            keys.append(both[~often[a] | often[b]])
        keys = np.sort(np.concatenate(keys))
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        n, keys = np.diff(np.append(first, len(keys))), keys[first]
        centre, other = keys >> 32, keys & LOW
        ends = np.searchsorted(centre, cuts)
        out: dict[str, list] = {k: [] for k in ("bucket", "ids", "totals", "runs", "near", "nears", "at", "n")}
        for k in np.flatnonzero(np.diff(ends)):
            own, runs = np.unique(centre[ends[k] : ends[k + 1]], return_counts=True)
            near, place = np.unique(other[ends[k] : ends[k + 1]], return_inverse=True)
            out["bucket"].append(int(k))
            for name, x in (("ids", ids[own]), ("totals", totals[own]), ("runs", runs), ("near", ids[near]), ("nears", totals[near]), ("at", place), ("n", n[ends[k] : ends[k + 1]])):
                out[name].append(packed(x))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                out = of(*(unpacked(batch.column(c)[i].as_py()) for c in ("ids", "totals", "codes", "sizes")))
                yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *(pa.array(x, pa.binary()) for x in list(out.values())[1:])], names=list(out))

    return chunks.mapInArrow(run, "bucket int, ids binary, totals binary, runs binary, near binary, nears binary, at binary, n binary")


def summed(whole: float, frequent: float, pairs: pa.Table) -> pa.Table:
    """id, vector: what a bucket's pairs add to the vectors of its words and of the frequent ones."""
    rows = {c: [unpacked(x.as_py()) for x in pairs[c]] for c in pairs.column_names if c != "bucket"}

    def joined(ids: str, totals: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        known, first, place = np.unique(np.concatenate(rows[ids]), return_index=True, return_inverse=True)
        return known, np.concatenate(rows[totals])[first], np.split(place, np.cumsum([len(x) for x in rows[ids]])[:-1])

    ids, tw, own = joined("ids", "totals")
    nears, tn, near = joined("near", "nears")
    keys = np.concatenate([np.repeat(o, r) << 32 | x[a] for o, r, x, a in zip(own, rows["runs"], near, rows["at"], strict=True)])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    n, keys = np.add.reduceat(np.concatenate(rows["n"])[order], first), keys[first]
    centre, other = keys >> 32, keys & LOW
    gain = np.log((n.astype(np.float64) * whole) / (tw[centre].astype(np.float64) * tn[other].astype(np.float64)))
    w = np.floor(np.maximum(gain, 0.0) * MICRO + 0.5).astype(np.int64)

    def signs(x: np.ndarray) -> np.ndarray:
        return (1 - 2 * ((x[:, None] >> np.arange(63, 63 - WIDTH, -1)) & 1)).astype(np.int8)

    def sums(word: np.ndarray, met: np.ndarray, use: np.ndarray, known: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        use = use[np.argsort(word[use], kind="stable")]
        out = np.zeros((len(known), WIDTH), np.int64)
        for part in np.array_split(use, len(use) // 65_536 + 1) if len(use) else []:
            at = word[part]
            begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            out[at[begin]] += np.add.reduceat(w[part, None] * sign[met[part]], begin, axis=0)
        some = np.unique(word[use])
        return known[some], out[some]

    found = [sums(centre, other, np.flatnonzero((w > 0) & (tw[centre] <= frequent)), ids, signs(nears)), sums(other, centre, np.flatnonzero((w > 0) & (tn[other] > frequent)), nears, signs(ids))]
    vectors = np.concatenate([v for _, v in found])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * WIDTH, pa.int32()), pa.array(vectors.ravel()))
    return pa.table({"id": pa.array(np.concatenate([i for i, _ in found])), "vector": lists})


def vectors(texts: DataFrame, tokens: str = "tokens", *, window: int = WINDOW, name: str = "pairs", chunk: int = CHUNK, bucket: int = BUCKET, only: DataFrame | None = None) -> DataFrame:
    """word, total (places near others), vector (WIDTH whole numbers) of every word that stands near another, or of those in `only`. A null or single-word text adds none."""
    rows = kept(chunked(texts, tokens, window, chunk), "texts", lean=True)
    words = rows.where("word IS NOT NULL").select("chunk", "place", "word", "total")
    for salt in itertools.count():
        totals = kept(words.groupBy("word").agg(F.sum("total").alias("total")).withColumn("id", numbered("word", salt)), "totals", lean=True)
        all_of = totals.agg(F.sum("total"), F.count("id"), F.countDistinct("id")).first()
        if all_of[1] == all_of[2]:  # else two words have one number
            break
    whole = all_of[0] or 0
    parts = -(-whole // (SLICES * bucket)) or 1
    frequent = whole / (4 * SLICES * parts)
    placed = with_total(words.select("chunk", "place", "word"), totals, "word", "chunk", "tw", 1).select(F.col("chunk").alias("of"), "place", "tw", numbered("word", salt).alias("id"))
    chunks = kept(told_chunks(rows.where("word IS NULL").select("chunk", "codes", "sizes"), placed, parts * SLICES), "chunks", lean=True)
    if only is not None:
        totals = kept(totals.join(only.select("word").distinct(), "word", "left_semi"), "wanted", lean=True)
    sums = []
    for turn in range(SLICES):
        pairs = met(chunks, turn, parts, window, frequent)
        part = pairs.groupBy("bucket").applyInArrow(lambda t: summed(float(whole), frequent, t), "id long, vector array<long>")
        sums.append(kept(part if only is None else part.join(totals.select("id"), "id", "left_semi"), name, lean=True))
    made = reduce(DataFrame.unionAll, sums).groupBy("id").agg(*(F.sum(F.get("vector", F.lit(j))).alias(f"_{j}") for j in range(WIDTH)))
    made = made.select("id", F.array(*(F.col(f"_{j}") for j in range(WIDTH))).alias("vector"))
    zero = F.array_repeat(F.lit(0).cast("long"), WIDTH)
    return totals.join(made, "id", "left").select("word", "total", F.coalesce("vector", zero).alias("vector"))


def unit(vector: Column) -> Column:
    """The vector at length 1, in doubles; null if it is zero."""

    def scaled(v: Column) -> Column:
        size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return F.when(size > 0, F.transform(v, lambda x: x / size))

    return tx.let(F.transform(vector, lambda x: x.cast("double")), scaled)


def like(a: Column, b: Column) -> Column:
    """Cosine of two vectors of length 1, rounded; 0 where one is null."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.round(dot, 6), F.lit(0.0))


def asked(each: DataFrame, space: DataFrame) -> DataFrame:
    """word, vector of the words of each that the space has, kept."""
    return kept(space.join(each.select("word").distinct(), "word", "left_semi").select("word", "vector"), "asked", lean=True)


def in_turns(each: DataFrame, key: list[str], made: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What is made of the rows of each key, SLICES-th by SLICES-th: rows with vectors are many times as wide as their words, and only one turn's are on the disk."""
    at = F.pmod(F.xxhash64(*key), F.lit(SLICES))
    return reduce(DataFrame.unionAll, [kept(made(each.where(at == turn)), name, lean=True) for turn in range(SLICES)])


def with_vectors(each: DataFrame, key: str, sides: Iterable[str], space: DataFrame) -> DataFrame:
    """key and, for each side, an array of (word, vector), sorted by word: the words meet their vectors in a join and come back to their key."""
    found = each.join(space.select(F.col("word").alias("_w"), unit(F.col("vector")).alias("vector")), F.col("word") == F.col("_w"), "left")
    lists = [F.sort_array(F.collect_list(F.when(F.col("side") == n, F.struct("word", "vector")))).alias(n) for n in sides]
    return found.groupBy(key).agg(*lists)


def coverage(rows: DataFrame, key: str, original: Column, generated: Column, space: DataFrame, least: float) -> DataFrame:
    """key, n, missing: the original's words, and those that the output has neither as they are nor by a word at least so like."""

    def side(name: str, items: Column) -> Column:
        return F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda w: F.struct(F.lit(name).alias("side"), w.alias("word")))

    def made(part: DataFrame) -> DataFrame:
        both = with_vectors(part, key, "ab", known)
        return both.select(key, F.size("a").alias("n"), F.transform(lost, lambda x: x["word"]).alias("missing"))

    lost = F.filter("a", lambda x: ~F.exists("b", lambda y: (x["word"] == y["word"]) | (like(x["vector"], y["vector"]) >= least)))
    each = rows.select(key, F.explode_outer(F.concat(side("a", original), side("b", generated))).alias("_x"))
    each = kept(each.select(key, "_x.side", "_x.word"), "words", lean=True)
    known = asked(each, space)
    return in_turns(each, [key], made, "coverage")


def means(rows: DataFrame, key: list[str], words: Column, space: DataFrame) -> DataFrame:
    """key, vector: the sum of the vectors of a text's words, as whole numbers."""

    def made(part: DataFrame) -> DataFrame:
        found = part.join(known.withColumnRenamed("word", "_word"), F.col("word") == F.col("_word"))
        sums = found.groupBy(*key).agg(*(F.sum(F.get("vector", F.lit(j))).alias(f"_{j}") for j in range(WIDTH)))
        return sums.select(*key, F.array(*(F.col(f"_{j}") for j in range(WIDTH))).alias("vector"))

    each = kept(rows.select(*key, F.explode(words).alias("word")), "words", lean=True)
    known = asked(each, space)
    return in_turns(each, key, made, "means")
