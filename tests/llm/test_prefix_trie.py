"""The conversation trie: against its SQL and a plain trie, however the rows are dealt over partitions."""

from __future__ import annotations

import hashlib
import os
import random
import zlib

import duckdb
import pytest

from inkwell.llm import prefix_trie, queries

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(convs: dict[int, list[tuple]]) -> list[tuple]:
    """The contract by dictionaries: convs are the original conversations, turns as (role, text)."""
    built = {c: convs.get(c - c % 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + own[h:] for c, own in convs.items()}
    nodes: dict[tuple, list[int]] = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    below = {p: [q for q in nodes if q[: len(p)] == p] for p in nodes}
    kids = {p: [q for q in below[p] if len(q) == len(p) + 1] for p in nodes}
    out = []
    for p, members in nodes.items():
        ends = sorted(c for c in members if len(built[c]) == len(p))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].split()) for q in below[p] if q)
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids[p]), sum(not kids[q] for q in below[p]), saved, sha))
    return sorted(out, key=str)


def invented(seed: int, convs: int, hot: int) -> dict[int, list[tuple]]:
    rng = random.Random(seed)
    words = ["a b", "c", "d e f", "", "g h i j"]
    own = {rng.randrange(60): [(rng.choice("ua"), rng.choice(words)) for _ in range(rng.randrange(0, 6))] for _ in range(convs)}
    return own | {100 + i: [("u", "hi there"), ("a", "x")] for i in range(hot)} | {300 + i: [("u", "hi there"), ("a", "x"), ("u", str(i % 3))] for i in range(hot // 2)}


@pytest.mark.parametrize("parts", [1, 3, 17, 60])
def test_trie_equals_plain_for_any_partitions(spark, parts, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 20)
    convs = {c: t for c, t in invented(parts, 40, 40).items() if t}
    rows = [(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        assert sorted(map(tuple, got.select(NAMES).collect()), key=str) == plain(convs)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_turnless_and_odd_rows(spark):
    """Conversation 41 has one turn, takes h of an absent head, and may so have none."""
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in range(200)}
    bare = next(c for c in range(41, 60) if h[c] == 3)
    rows = [(bare, 0, "u", "x"), (0, None, None, None), (0, 0, "u", "a b"), (0, 0, "u", "a b"), (0, 0, "a", "z"), (1, 5, "u", "own"), (1, 7, "u", "last one"), (None, 0, "u", "lost")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as depth", "2 as key", "3 as words")
    got = sorted(map(tuple, prefix_trie.conversation_trie(frame).select(NAMES).collect()), key=str)
    digest = lambda t: hashlib.md5(f"{len(t[0])}:{t[0]}{t[1]}".encode()).hexdigest()
    same = sorted([("u", "a b"), ("u", "a b"), ("a", "z")], key=digest)
    assert got == plain({bare: [("u", "x")], 0: [("", ""), *same], 1: [("u", "own"), ("u", "last one")]})
    only = prefix_trie.conversation_trie(frame.where(f"conv_id = {bare}")).select(NAMES).collect()
    assert [tuple(r) for r in only] == [(bare, 0, None, 1, 0, 1, 0, hashlib.sha256(str(bare).encode()).hexdigest())]
    assert prefix_trie.conversation_trie(frame.limit(0)).count() == 0


def test_very_long_conversation(spark):
    rows = [(c, i, "u", f"w{i} and more" * (50 if i == 9 else 1)) for c in (0, 20, 40) for i in range(3000)] + [(60, 0, "u", "x" * 1_000_000)]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 3002 and max(r["n_convs"] for r in got if r["depth"]) == 3
    assert next(r["n_leaves"] for r in got if r["depth"] == 0) == 2


@here
def test_trie_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = con.sql(prefix_trie.SQL).select(*map(duckdb.ColumnExpression, NAMES)).fetchall()
    got = queries.op13_conversation_trie(spark, SF).select(NAMES).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
