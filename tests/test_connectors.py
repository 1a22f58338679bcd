"""Connectors and first letters as SQL has them, also where a letter has a longer upper case."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from inkwell.functions import rewrite as rw
from inkwell.functions import text as tx
from inkwell.plans import pairs


def test_connectors_leave_one_letter_and_blanks_as_sql(spark):
    texts = ["However, ßer.", "It is ᾳ here.", "Thus ﬁne", " However, it stood.　", "It is it\t", "Hence ŉa", "However, ", "plain ß"]
    want = duckdb.execute(f"SELECT CASE WHEN regexp_matches(trim(t), '{pairs.STARTERS}') THEN upper(regexp_replace(trim(t), '{pairs.STARTERS}', '')[1]) || regexp_replace(trim(t), '{pairs.STARTERS}', '')[2:] ELSE trim(t) END FROM (SELECT unnest(?) AS t)", [texts]).fetchall()
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(rw.without_connector(F.col("t")).alias("r")).collect()
    assert [r["r"] for r in got] == [w[0] for w in want] and got[0]["r"] == "ẞer."


def test_upper_letters_as_sql(spark):
    letters = [chr(i) for i in (*range(1, 0x590), *range(0x1E00, 0x2000), *range(0xFB00, 0xFB18))]
    want = [r[0] for r in duckdb.execute("SELECT upper(unnest(?))", [letters]).fetchall()]
    got = [r["u"] for r in spark.createDataFrame([(x,) for x in letters], "c string").select(tx.upper_letter(F.col("c")).alias("u")).collect()]
    assert got == want
