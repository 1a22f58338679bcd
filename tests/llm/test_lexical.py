"""Ranked search: treaps against plain trees, walks against scoring everything, the query against its SQL."""

from __future__ import annotations

import os
import random
import re

import duckdb
import numpy as np
import pytest
from rows import TEXTS, documents

from inkwell.llm import lexical, queries

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def shard(rng: random.Random, docs: int, vocabulary: int, same: bool = False) -> lexical.Shard:
    terms = [np.array(sorted(rng.sample(range(vocabulary), rng.randrange(1, vocabulary))), np.int32) for _ in range(docs)]
    if same:
        terms = [terms[rng.randrange(3)] for _ in range(docs)]
    counts = [np.array([1 if same else rng.randrange(1, 6) for _ in t], np.int32) for t in terms]
    n = np.array([9 if same else rng.randrange(5, 400) for _ in range(docs)], np.int64)
    ids = np.array(rng.sample(range(docs * 3), docs), np.int64)
    return lexical.Shard(ids, np.zeros(docs, bool), n, terms, counts, np.array([rng.randrange(0, 9000) for _ in range(vocabulary)], np.int64), (docs, int(n.sum())))


def test_treaps_are_search_trees_and_heaps():
    rng = random.Random(1)
    for _ in range(30):
        s = shard(rng, rng.randrange(1, 60), rng.randrange(2, 8), rng.random() < 0.3)
        seen = []

        def visit(node: int, lo: int, hi: int, most: int, s=s, seen=seen) -> None:
            if node >= 0:
                assert lo <= s.doc[node] < hi and s.impact[node] <= most
                seen.append(node)
                visit(s.left[node], lo, s.doc[node], s.impact[node])
                visit(s.right[node], s.doc[node] + 1, hi, s.impact[node])

        for node in s.root.values():
            visit(node, 0, len(s.ids), 2**62)
        assert sorted(seen) == list(range(len(s.doc)))


@pytest.mark.parametrize("leaf", [1, 4, 256])
def test_walks_equal_scoring_everything(leaf):
    rng = random.Random(leaf)
    for _ in range(60):
        same = rng.random() < 0.4
        parts = [shard(rng, rng.randrange(1, 90), 12, same) for _ in range(3)]
        query = {t: rng.randrange(1, 3) for t in rng.sample(range(12), rng.randrange(1, 6))}
        often = np.zeros(12, np.int64)
        often[list(query)] = list(query.values())
        best, want = lexical.Best(5), []
        for s in parts:
            lexical.walk(s, query, often, best, leaf)
            want += [(-int(x), False, int(i)) for x, i in zip(s.scored(0, len(s.ids), often), s.ids, strict=True) if x > 0]
        assert best.rows == sorted(want)[:5]


def test_walks_leave_documents_out():
    """One term alone finds its best k at the top of its treap."""
    rng = random.Random(3)
    s = shard(rng, 5000, 6)
    often = np.zeros(6, np.int64)
    often[2] = 1
    assert lexical.walk(s, {2: 1}, often, lexical.Best(10), 64) < 1500


def test_pieces_divide_no_term():
    text = "Ab1 é-cd 日本x!".encode() * 50
    for most in (1, 3, 7, 10_000):
        assert [t for p in lexical.pieces(text, most) for t in lexical.TERM.findall(p)] == lexical.TERM.findall(text.lower())
    known = {b"\xc3\xa9": 0, b"cd": 1, b"ab": 2}
    assert lexical.counted(text, known) == (200, [0, 1], [50, 50])
    assert [t.decode() for t in lexical.TERM.findall("ÀB_c\x7f\x80Z".encode().lower())] == re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "Àb_c\x7f\x80z")


def sql(con: duckdb.DuckDBPyConnection) -> list[tuple]:
    return sorted(con.sql(lexical.SQL).select(*map(duckdb.ColumnExpression, ["item_id", "rank", "doc_id", "score"])).fetchall(), key=str)


@here
def test_search_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    got = queries.op12_ranked_search(spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == sql(con) and len(got) > 100


def test_search_edges_and_blocks(spark):
    docs = documents(spark)
    items = spark.createDataFrame([(1, "the lazy DOG words"), (1, "the lazy DOG words"), (2, None), (3, ""), (4, "token ünïcödé and and"), (None, "words WITHOUT an id"), (5, "zzz"), (6, "WORD1 word2 more"), (4, "dog")], "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as score")
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r[:2] for r in TEXTS])
    con.sql("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into benchmark values (?, ?)", [tuple(r) for r in items.select("item_id", "text").collect()])
    want = sql(con)
    for block in (lexical.BLOCK, 3):
        assert sorted(map(tuple, lexical.search(docs, items, block=block).collect()), key=str) == want
    assert lexical.search(docs.limit(0), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0
