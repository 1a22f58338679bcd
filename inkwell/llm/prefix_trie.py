"""The trie of conversations that begin alike, by a global range sort.

A conversation is the array of its turns, each a digest of role and text. The
arrays are sorted over all partitions by range; one sweep down a partition
compares each array with the one before it and keeps a stack of open nodes,
one a depth: the common prefix stays open, what lies deeper closes and is
handed to its parent. A node that the first or the last array of a partition
belongs to may go on in the next one. Its parts are added up by a grouping;
what the sweep took to begin or to end at the edge, but goes on, is set right
from the two arrays that meet there. So no node needs its members in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import clean, keep, ready

#: A word: a run without blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Every EVERY conversations share a head, of which a conversation takes fewer than HEADS turns.
EVERY, HEADS = 20, 4
WIDE = 16
#: Bytes of ids that are handed on in one row.
IDS = 1 << 16
#: Rows of the sweep: a node that lies within the partition, a part of one that may not, ids that end at such a node, the partition's edges.
CLOSED, PART, ENDS, EDGES = range(4)
COLUMNS = "kind int, pid int, seq long, node binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, first binary, last binary, words array<long>"
SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def arrays(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of turn, digest in hexadecimal, words): by turn, null first, equal turns by digest. Null role or text is empty; rows without a conv_id belong to no conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = clean(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    turns = turns.select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("one"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def rebuilt(conversations: DataFrame, *, every: int = EVERY, heads: int = HEADS) -> DataFrame:
    """conv_id, key (the digests one after the other), words: every conversation begins with turns of its group's first one."""
    own = arrays(conversations)
    group = F.col("conv_id") - F.col("conv_id") % every
    first = arrays(conversations.where(F.col("conv_id") % every == 0)).select(F.col("conv_id").alias("_group"), F.slice("turns", F.lit(1), F.lit(heads - 1)).alias("_head"))
    taken = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    joined = own.join(first, group == F.col("_group"), "left")
    head = F.when(F.col("_head").isNotNull(), F.slice("_head", F.lit(1), taken)).otherwise(F.slice("turns", F.lit(1), F.lit(0)))
    turns = F.concat(head, F.slice("turns", taken + 1, F.size("turns") + 1))
    both = joined.select("conv_id", turns.alias("turns"))
    return both.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))


def common(a: bytes, b: bytes) -> int:
    """Turns that both arrays begin with."""
    if a == b:
        return len(a) // WIDE
    most, k = min(len(a), len(b)) // WIDE, 0
    while k < most and a[k * WIDE : (k + 1) * WIDE] == b[k * WIDE : (k + 1) * WIDE]:
        k += 1
    return k


def child(node: bytes, turn: bytes) -> bytes:
    return hashlib.md5(node + turn, usedforsecurity=False).digest()


ROOT = child(b"", b"")


class Node:
    """An open node: what its closed subtrees have added so far."""

    def __init__(self, node: bytes, parent: bytes | None, words: int, edge: bool):
        self.node, self.parent, self.words, self.edge = node, parent, words, edge
        self.members, self.least, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.ends = hashlib.sha256()
        self.ending = False

    def joined(self, conv_id: int, members: int = 1) -> None:
        self.members += members
        self.least = conv_id if self.least is None else min(self.least, conv_id)


class Sweep:
    """One partition's arrays, in order; rows collects what is handed on."""

    def __init__(self, pid: int):
        self.pid, self.rows, self.stack = pid, [], []
        self.first = self.last = None
        self.words: list[int] = []
        self.ids = bytearray()
        self.seq, self.at = 0, b""

    def emit(self, kind: int, **values: object) -> None:
        self.rows.append({"kind": kind, "pid": self.pid, **values})

    def flush(self) -> None:
        """Hand on the ids of the array at hand that are due."""
        if self.ids:
            self.emit(ENDS, seq=self.seq, node=self.stack[-1].node, ends=bytes(self.ids))
            self.seq += 1
            self.ids = bytearray()

    def close(self, depth: int, edge: bool = False) -> None:
        """Close all nodes deeper than depth."""
        while len(self.stack) > depth + 1:
            own = self.stack.pop()
            saved, leaves = own.saved + (own.members - 1) * own.words, own.leaves or 1
            # the ids of the first and of the last array's node are handed on in blocks, all others' are complete
            whole = own.ending and not own.edge and not (edge and own.node == self.at)
            self.emit(PART if edge or own.edge else CLOSED, node=own.node, parent=own.parent, depth=len(self.stack), conv_id=own.least, n_convs=own.members, n_children=own.children, n_leaves=leaves, saved_tokens=saved, ends=own.ends.hexdigest().encode() if whole else None)
            if self.stack:
                above = self.stack[-1]
                above.joined(own.least, own.members)
                above.leaves += leaves
                above.saved += saved

    def add(self, key: bytes, conv_id: int, words: list[int]) -> None:
        depth, edge = len(key) // WIDE, self.first is None
        if edge:
            self.first, self.words = key, words
            self.stack.append(Node(ROOT, None, 0, True))
        elif key != self.last:
            if self.stack[-1].edge:
                self.flush()  # the first array's ids may go on from the partition before
            self.ids = bytearray()
            self.close(common(self.last, key))
        for k in range(len(self.stack) - 1, depth):
            above = self.stack[-1]
            above.children += 1
            self.stack.append(Node(child(above.node, key[k * WIDE : (k + 1) * WIDE]), above.node, words[k], edge))
        own, shown = self.stack[-1], str(conv_id).encode()
        own.joined(conv_id)
        own.ends.update(b"," + shown if own.ending else shown)
        own.ending = True
        self.ids += b"," + shown if self.ids else shown
        if len(self.ids) > IDS:
            self.flush()
        self.last = key

    def finish(self) -> None:
        if self.first is not None:
            self.flush()
            self.at = self.stack[-1].node
            self.close(-1, edge=True)
            self.emit(EDGES, first=self.first, last=self.last, words=self.words)


def _batches(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema=schema)


def _arrow(columns: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def swept(rows: DataFrame) -> DataFrame:
    """The rows of all partitions' sweeps over the sorted arrays."""
    ready(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, own = _arrow(COLUMNS), Sweep(TaskContext.get().partitionId())
        for batch in batches:
            for key, conv_id, words in zip(*(batch.column(c) for c in range(3)), strict=True):
                own.add(key.as_py(), conv_id.as_py(), words.as_py())
                if len(own.rows) >= 2000:
                    yield _batches(own.rows, schema)
                    own.rows = []
        own.finish()
        yield _batches(own.rows, schema)

    return rows.select("key", "conv_id", "words").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(run, COLUMNS)


CORRECTED = "node binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def corrected(edges: DataFrame) -> DataFrame:
    """What the parts that meet at the partitions' edges have counted too often or not at all. edges: a row for each partition."""
    order = Window.orderBy("pid")
    met = edges.select("first", "words", "last", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(CORRECTED)
        for batch in batches:
            rows: list[dict] = []
            for r in batch.to_pylist():
                if r["before"] is not None:  # nodes down to this depth go on: their child on the way is not new, their turns are shared
                    depth = common(r["before"], r["first"])
                    worth = sum(r["words"][:depth])
                    for k, node, parent in way(r["first"], depth):
                        rows.append({"node": node, "parent": parent, "depth": k, "n_convs": 0, "n_children": -int(k < depth), "n_leaves": 0, "saved_tokens": worth})
                        worth -= r["words"][k - 1] if k else 0
                if r["after"] is not None and r["after"].startswith(r["last"]):  # the last array's node has more below it or beside it
                    rows += [{"node": node, "parent": parent, "depth": k, "n_convs": 0, "n_children": 0, "n_leaves": -1, "saved_tokens": 0} for k, node, parent in way(r["last"], len(r["last"]) // WIDE)]
            yield _batches(rows, schema)

    return met.mapInArrow(run, CORRECTED)


def way(key: bytes, depth: int) -> Iterator[tuple[int, bytes, bytes | None]]:
    """(depth, node, parent) from the root down."""
    node, parent = ROOT, None
    yield 0, node, parent
    for k in range(depth):
        node, parent = child(node, key[k * WIDE : (k + 1) * WIDE]), node
        yield k + 1, node, parent


def digested(blocks: DataFrame) -> DataFrame:
    """node, sha: of each node's ids, block by block. The digest needs the ids of a node one after the other, so a task reads them as a stream and holds one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, own = None, None
        schema = _arrow("node binary, sha string")
        for batch in batches:
            done: list[dict] = []
            for at, ids in zip(batch.column(0), batch.column(1), strict=True):
                if at.as_py() != node:
                    if own:
                        done.append({"node": node, "sha": own.hexdigest()})
                    node, own = at.as_py(), hashlib.sha256(ids.as_py())
                else:
                    own.update(b"," + ids.as_py())
            yield _batches(done, schema)
        yield _batches([{"node": node, "sha": own.hexdigest()}] if own else [], schema)

    return blocks.repartition("node").sortWithinPartitions("node", "pid", "seq").select("node", "ends").mapInArrow(run, "node binary, sha string")


def trie(arrays: DataFrame) -> DataFrame:
    """The nodes of the trie of arrays (conv_id, key, words); conv_id is unique."""
    rows, none = keep(swept(arrays), "sweep"), F.sha2(F.lit(""), 256)
    names = [c.split()[0] for c in CORRECTED.split(", ")]
    sha = F.col("ends").cast("string").alias("_sha")
    parts = rows.where(F.col("kind") == PART).select(*names, sha).unionByName(corrected(rows.where(F.col("kind") == EDGES)).withColumn("_sha", F.lit(None).cast("string")))
    whole = parts.groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in SUMS), F.max("_sha").alias("_sha"))
    shas = digested(rows.where(F.col("kind") == ENDS))
    whole = whole.join(shas.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(*names, F.coalesce("_sha", "sha", none).alias("ends_sha256"))
    closed = rows.where(F.col("kind") == CLOSED).select(*names, F.coalesce(sha, none).alias("ends_sha256"))
    nodes = keep(closed.unionByName(whole), "nodes")
    above = nodes.where("n_children > 0").select(F.col("node").alias("_node"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(above, F.col("parent") == F.col("_node"), "left")
    return out.select("conv_id", "depth", "parent_conv_id", *SUMS, "ends_sha256")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every distinct beginning of the rebuilt conversations.

    Rows without a conv_id are left out; a null role or text is empty; rows of
    one conversation and turn go by a digest of role and text, so repeated rows
    are turns one after the other. An empty table has no node, not even the
    root. A conversation is one row, as large as 16 bytes and a number a turn.
    """
    return trie(rebuilt(clean(conversations, "conv_id", "turn", "role", "text")))


SQL = r"""WITH t AS (SELECT conv_id, turn, md5(length(r) || ':' || r || x) AS d, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, list({'d': d, 'w': w} ORDER BY turn NULLS FIRST, d) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda a, s: list_reduce(list_prepend(xor(a, s), range(8)), lambda b, i: CASE WHEN b % 2 = 1 THEN xor(b // 2, CAST(3988292384 AS BIGINT)) ELSE b // 2 END)), CAST(4294967295 AS BIGINT)) % 4 AS h FROM c),
r AS (SELECT h.conv_id, list_concat(coalesce(g.own, [])[1:h.h], h.own[h.h + 1:]) AS turns FROM h LEFT JOIN c AS g ON g.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, len(turns) AS size, k, array_to_string(list_transform(turns[1:k], lambda x: x.d), '') AS node, CASE WHEN k > 0 THEN turns[k].w ELSE 0 END AS w FROM r, unnest(range(len(turns) + 1)) AS u(k)),
n AS (SELECT node, any_value(k) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = k), '')) AS ends_sha256 FROM p GROUP BY node),
f AS (SELECT substr(node, 1, 32 * (depth - 1)) AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(f.n_children, 0) AS n_children FROM n LEFT JOIN f USING (node)),
s AS (SELECT substr(node, 1, CAST(32 * k AS INTEGER)) AS node, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * w) AS BIGINT) AS saved_tokens FROM m, unnest(range(depth + 1)) AS u(k) GROUP BY 1)
SELECT m.conv_id, m.depth, a.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256 FROM m JOIN s USING (node) LEFT JOIN m AS a ON m.depth > 0 AND a.node = substr(m.node, 1, CAST(32 * (m.depth - 1) AS INTEGER))"""
