"""Ranked lexical search by inverted treaps.

Documents are tokenised once, where they lie, to the query terms that they
hold; a table of these counts is kept and gives the corpus statistics. Each
task then takes its documents by shards. In a shard every term has a treap of
its postings: a search tree by doc_id that is a heap by impact, so the impact
at a subtree's root is the largest in its range of documents. A query walks
the treaps of its terms together, most promising range first: the impacts at
the roots sum to a bound for the range; a range whose bound cannot enter the
best k is dropped, others are divided at their strongest posting. Ranges of
few documents are scored in one piece, and so is what is left when a walk has
become longer than scoring. The best of a task's earlier shards bound its later
ones. No posting is shuffled; a task hands on k rows a query.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import clean, keep, ready, trim

#: A term, once A-Z are lower-cased; in UTF-8 all that is not ASCII lies above 0x7F.
TERM, GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
TOP = 10
#: Bytes of a text that are tokenised at a time.
PIECE = 1 << 20
#: Documents and postings in a shard, and documents in a range that is scored in one piece.
DOCS, POSTINGS, LEAF = 8192, 1_500_000, 256
#: Terms, with repeats, of the queries that one pass over the documents answers; further queries have further passes.
BLOCK = 500_000
#: Pairs of query and document in one task.
WORK = 100_000_000


def pieces(text: bytes, most: int = PIECE) -> Iterator[bytes]:
    """The lower-cased text in pieces that divide no term."""
    text, at = text.lower(), 0
    while at < len(text):
        gap = GAP.search(text, at + most) if at + most < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def counted(text: bytes, vocabulary: dict[bytes, int]) -> tuple[int, list[int], list[int]]:
    """All terms of the text with repeats, the numbers of those in the vocabulary, and how often each occurs."""
    n, found = 0, Counter()
    for piece in pieces(text):
        terms = TERM.findall(piece)
        n += len(terms)
        found.update(map(vocabulary.get, terms))
    found.pop(None, None)
    return n, list(found), list(found.values())


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms, with repeats), terms and counts of every document that has a term, by numbers of the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value
        for batch in batches:
            ids, texts = batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.binary())
            rows = [(i, *counted(t.as_py() or b"", own)) for i, t in enumerate(texts)]
            rows = [r for r in rows if r[1]]
            at = pa.array([r[0] for r in rows], pa.int64())
            lists = (pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([ids.take(at), pa.array([r[1] for r in rows], pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])
            trim()

    return clean(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def nearest(impact: np.ndarray, first: np.ndarray, last: np.ndarray, step: int) -> np.ndarray:
    """For each posting the next one of its list in the direction of `step` with a larger impact (to the left: or an equal one), or -1.

    All postings follow the pointers of those they have reached, so the ways double.
    """
    at = np.arange(len(impact), dtype=np.int32)
    to = at + np.int32(step)
    to[(to < first) | (to >= last)] = -1
    live = np.flatnonzero(to >= 0)
    while len(live):
        ahead = to[live]
        beyond = impact[ahead] >= impact[live] if step < 0 else impact[ahead] > impact[live]
        live, ahead = live[~beyond], ahead[~beyond]
        to[live] = to[ahead]
        live = live[to[live] >= 0]
    return to


class Shard:
    """Some documents in order of doc_id, and a treap of the postings of each term."""

    def __init__(self, ids: np.ndarray, missing: np.ndarray, n: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], weights: np.ndarray, corpus: tuple[int, int]):
        order = np.lexsort((ids, missing))
        self.ids, self.missing = ids[order], missing[order]
        sizes = np.array([len(t) for t in terms], np.int64)[order]
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.terms = np.concatenate([terms[i] for i in order] or [np.zeros(0, np.int32)])
        tf = np.concatenate([counts[i] for i in order] or [np.zeros(0, np.int32)]).astype(np.int64)
        total, words = corpus
        m = 100 - 75 + 75 * n[order] * total // words
        self.impacts = weights[self.terms] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes)))
        by = np.argsort(self.terms, kind="stable")
        self.doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)[by]
        self.impact = self.impacts[by]
        self._grow(self.terms[by])

    def _grow(self, terms: np.ndarray) -> None:
        """left, right: the children of each posting; root: the top posting of each term that the shard holds."""
        new = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.zeros(0, np.int64)
        size = np.diff(np.append(new, len(terms)))
        first, last = (np.repeat(x, size).astype(np.int32) for x in (new, new + size))
        before, after = (nearest(self.impact, first, last, step) for step in (-1, 1))
        # the parent is the weaker of the two; on a tie the left one stands above the right one
        to_left = (before >= 0) & ((after < 0) | (self.impact[before] < self.impact[after]))
        to_right = (after >= 0) & ~to_left
        self.left, self.right = (np.full(len(terms), -1, np.int32) for _ in range(2))
        self.right[before[to_left]] = np.flatnonzero(to_left)
        self.left[after[to_right]] = np.flatnonzero(to_right)
        tops = np.flatnonzero(~to_left & ~to_right)
        self.root = dict(zip(terms[tops].tolist(), tops.tolist(), strict=True))

    def inside(self, node: int, lo: int, hi: int) -> int:
        """The top posting, at or below the node, of the documents lo to hi (exclusive); -1 if there is none."""
        while node >= 0:
            at = self.doc.item(node)
            if at < lo:
                node = self.right.item(node)
            elif at >= hi:
                node = self.left.item(node)
            else:
                break
        return node

    def scored(self, lo: int, hi: int, often: np.ndarray) -> np.ndarray:
        """The scores of the documents lo to hi (exclusive)."""
        a, b = self.starts[lo], self.starts[hi]
        sums = np.concatenate(([0], np.cumsum(often[self.terms[a:b]] * self.impacts[a:b])))
        return sums[self.starts[lo + 1 : hi + 1] - a] - sums[self.starts[lo:hi] - a]


class Best:
    """The k best of one query so far: score falling, then doc_id rising, a missing doc_id last."""

    def __init__(self, top: int):
        self.top, self.rows = top, []

    def enters(self, score: int, missing: bool, doc_id: int) -> bool:
        return score > 0 and (len(self.rows) < self.top or (-score, missing, doc_id) < self.rows[-1])

    def add(self, score: int, missing: bool, doc_id: int) -> None:
        if self.enters(score, missing, doc_id):
            self.rows = sorted([*self.rows, (-score, missing, doc_id)])[: self.top]

    def add_all(self, shard: Shard, lo: int, scores: np.ndarray) -> None:
        least = -self.rows[-1][0] if len(self.rows) == self.top else 1
        at = np.flatnonzero(scores >= max(1, least))
        at = at[np.lexsort((at, -scores[at]))][: self.top]
        for i in at.tolist():
            self.add(int(scores[i]), bool(shard.missing[lo + i]), int(shard.ids[lo + i]))


def walk(shard: Shard, query: dict[int, int], often: np.ndarray, best: Best, leaf: int = LEAF) -> int:
    """Put the query's best documents of the shard into `best`; returns the number of documents scored. often: the query's terms as a vector over the vocabulary."""
    roots = [(shard.root[t], n) for t, n in query.items() if t in shard.root]
    if not roots:
        return 0
    weights = [n for _, n in roots]
    impact, done, scored = shard.impact, 0, 0
    most = 64 + 4 * len(shard.ids) // leaf

    def bound(nodes: list[int]) -> int:
        return sum(impact.item(x) * w for x, w in zip(nodes, weights, strict=True) if x >= 0)

    start = [x for x, _ in roots]
    heap = [(-bound(start), 0, len(shard.ids), start)]
    while heap:
        top, lo, hi, nodes = heapq.heappop(heap)
        if not best.enters(-top, bool(shard.missing[lo]), int(shard.ids[lo])):
            continue  # ranges after it can still hold a tie with a smaller doc_id
        if hi - lo <= leaf or done >= most:
            best.add_all(shard, lo, shard.scored(lo, hi, often))
            scored += hi - lo
            continue
        done += 1
        strongest = max((k for k, x in enumerate(nodes) if x >= 0), key=lambda k: impact.item(nodes[k]) * weights[k])
        cut = shard.doc.item(nodes[strongest])
        best.add_all(shard, cut, shard.scored(cut, cut + 1, often))
        scored += 1
        for a, b in ((lo, cut), (cut + 1, hi)):
            if a < b:
                below = [shard.inside(x, a, b) for x in nodes]
                value = bound(below)
                if best.enters(value, bool(shard.missing[a]), int(shard.ids[a])):
                    heapq.heappush(heap, (-value, a, b, below))
    return scored


def items_of(items: DataFrame, blocks: int, block: int) -> list[tuple[int | None, dict[bytes, int]]]:
    """The queries of one block, as (item_id, terms with how often): the texts of rows that share an item_id are one query."""
    rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).select("item_id", "text").distinct().collect()
    found: dict[int | None, Counter] = {}
    for r in rows:
        own = found.setdefault(r["item_id"], Counter())
        for piece in pieces((r["text"] or "").encode()):
            own.update(TERM.findall(piece))
    return sorted(((i, dict(c)) for i, c in found.items() if c), key=lambda x: (x[0] is None, x[0] or 0))


def search(docs: DataFrame, items: DataFrame, *, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of each item with the highest scores above 0, equal scores by doc_id, a null doc_id last.

    Each row of docs is a document; a null or empty text has no term and is
    never found. Rows of items that share an item_id are one item with the
    terms of all their different texts; items without a term have no row. Other
    columns are ignored.
    """
    ready(docs.sparkSession)
    items = clean(items, "item_id", "text").select(F.col("item_id").cast("long"), "text")
    words = items.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    blocks = max(1, -(-words // block))
    parts = [_searched(docs, items_of(items, blocks, b), top) for b in range(blocks)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
    return ranked.where(F.col("rank") <= top).select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def _searched(docs: DataFrame, queries: list[tuple[int | None, dict[bytes, int]]], top: int) -> DataFrame:
    """The best of every task for the queries of one block."""
    spark = docs.sparkSession
    schema = "item_id long, doc_id long, score long"
    vocabulary = {t: k for k, t in enumerate(sorted({t for _, own in queries for t in own}))}
    if not vocabulary:
        return spark.createDataFrame([], schema)
    table = keep(postings(docs, vocabulary), "postings")
    total, words = table.agg(F.count(F.lit(1)), F.sum("n")).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most a row for each term of the block
        weights[term] = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
    sent = spark.sparkContext.broadcast(([(i, {vocabulary[t]: n for t, n in own.items()}) for i, own in queries], weights))
    due = -(-total * len(queries) // WORK)
    if due > table.rdd.getNumPartitions():
        table = table.repartition(due)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = sent.value
        best = [Best(top) for _ in asked]
        often = np.zeros(len(weights), np.int64)
        for shard in shards(batches, weights, (total, words)):
            for (_, query), own in zip(asked, best, strict=True):
                at = list(query)
                often[at] = list(query.values())
                walk(shard, query, often, own)
                often[at] = 0
        rows = [(i, None if missing else doc_id, -score) for (i, _), own in zip(asked, best, strict=True) for score, missing, doc_id in own.rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["item_id", "doc_id", "score"])

    return table.mapInArrow(run, schema)


def shards(batches: Iterator[pa.RecordBatch], weights: np.ndarray, corpus: tuple[int, int]) -> Iterator[Shard]:
    """The rows of the postings table, some at a time."""
    ids, missing, n, terms, counts, held = [], [], [], [], [], 0

    def made() -> Shard:
        return Shard(np.array(ids, np.int64), np.array(missing, bool), np.array(n, np.int64), terms, counts, weights, corpus)

    for batch in batches:
        own = batch.column(0)
        known, gone = own.fill_null(2**63 - 1).to_numpy(zero_copy_only=False), own.is_null().to_numpy(zero_copy_only=False)
        sizes = batch.column(1).to_numpy()
        cuts = batch.column(2).offsets.to_numpy()
        values = [batch.column(k).values.to_numpy(zero_copy_only=False) for k in (2, 3)]
        base = batch.column(3).offsets.to_numpy()
        for i in range(batch.num_rows):
            if cuts[i] == cuts[i + 1]:
                continue  # it counts in the statistics, but no query can find it
            ids.append(known[i])
            missing.append(gone[i])
            n.append(sizes[i])
            terms.append(values[0][cuts[i] : cuts[i + 1]])
            counts.append(values[1][base[i] : base[i + 1]])
            held += cuts[i + 1] - cuts[i]
            if len(ids) >= DOCS or held >= POSTINGS:
                yield made()
                ids, missing, n, terms, counts, held = [], [], [], [], [], 0
                trim()
    if ids:
        yield made()


SQL = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS row, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT row, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
f AS (SELECT row, doc_id, term, count(*) AS tf FROM t GROUP BY row, doc_id, term),
s AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY row),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM s),
m AS (SELECT row, 100 - 75 + ((75 * n * docs) // words) AS m FROM s, c),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, c GROUP BY term, docs),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item_id, term, count(*) AS often FROM i GROUP BY item_id, term),
r AS (SELECT q.item_id, f.row, f.doc_id, CAST(sum(q.often * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * m.m))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN w USING (term) JOIN m ON m.row = f.row GROUP BY q.item_id, f.row, f.doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10"""
