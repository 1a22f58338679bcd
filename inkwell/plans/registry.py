"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Paragraphs and sentences as the library splits them.
PARAS = r"""pieces AS (SELECT doc_id, source, text, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS blocks FROM documents),
paras AS (SELECT doc_id, source, CAST(i - 1 AS INTEGER) AS para_idx, p AS paragraph FROM (SELECT doc_id, source, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (
  SELECT doc_id, source, CASE WHEN len(blocks) <= 1 AND contains(text, chr(10)) THEN list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') ELSE blocks END AS l FROM pieces)))"""
SENTS = (
    PARAS
    + r""",
sents AS (SELECT doc_id, source, para_idx, CAST(i - 1 AS INTEGER) AS sent_idx, s AS sentence FROM (SELECT doc_id, source, para_idx, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (
  SELECT doc_id, source, para_idx, list_filter(list_transform(string_split(regexp_replace(paragraph, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM paras)))"""
)


def words_sql(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def tokens_sql(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def list_sql(items: list[str]) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def among_sql(items: str, known: list[str]) -> str:
    return f"len(list_filter({items}, lambda x: list_contains({list_sql(known)}, x)))"


def any_sql(text: str, parts: list[str], test: str = "contains") -> str:
    return "(" + " OR ".join(f"{test}({text}, '{p.replace(chr(39), chr(39) * 2)}')" for p in parts) + ")"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Rows(Protocol):
    """Rows that exist alike in Spark and in SQL."""

    def df(self, spark: SparkSession, sf_dir: str = "") -> DataFrame: ...

    def cte(self) -> str: ...


def over(cases: Rows, rows: Rows, sql: str, extra: str = "") -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Registers an operator over DataFrames twice: on a table's rows under its name, and on small cases that reach every branch under name_cases.

    sql: what follows the rows' definition. extra: more definitions before it.
    """

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        for name, own in ((f.__name__, rows), (f"{f.__name__}_cases", cases)):
            QUERIES[name] = lambda spark, sf_dir, own=own: f(own.df(spark, sf_dir))
            SQL[name] = f"WITH {own.cte()}{', ' + extra if extra else ''}{sql if sql.startswith(',') else ' ' + sql}"
        return f

    return add
