"""Tables that exist alike in Spark and in SQL: small ones, and ones made from the supplied tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

KINDS = {"int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


def literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, str):
        parts = ["'" + p.replace("'", "''") + "'" for p in x.split("\n")]
        return "(" + " || chr(10) || ".join(parts) + ")" if len(parts) > 1 else parts[0]
    if isinstance(x, list):
        return "[" + ", ".join(map(literal, x)) + "]"
    return repr(x)


@dataclass(frozen=True)
class Fixture:
    """Rows under a schema such as `id int, text string`."""

    name: str
    schema: str
    rows: list[tuple]

    def df(self, spark: SparkSession, sf_dir: str = "") -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def cte(self) -> str:
        fields = [f.strip().split(" ") for f in self.schema.split(", ")]
        raw = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        casts = ", ".join(f"CAST(c{i} AS {KINDS[kind]}) AS {name}" for i, (name, kind) in enumerate(fields))
        return f"{self.name} AS (SELECT {casts} FROM (VALUES {raw}) v({', '.join(f'c{i}' for i in range(len(fields)))}))"


@dataclass(frozen=True)
class Made:
    """Rows made from a supplied table; sql defines them, under the name, after whatever they need."""

    name: str
    sql: str
    build: Callable[[SparkSession, str], DataFrame]

    def df(self, spark: SparkSession, sf_dir: str = "") -> DataFrame:
        return self.build(spark, sf_dir)

    def cte(self) -> str:
        return self.sql
