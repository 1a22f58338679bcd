"""Reading texts and keeping an author's artefacts as Parquet, one directory per author."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def author_key(name: Column) -> Column:
    """One form of an author's name for writers and readers alike."""
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", "_")


def read_texts(spark: SparkSession, path: str, author: str) -> DataFrame:
    """Whole text files: doc_id (a hash of the path), source, text."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return rows.select(F.xxhash64("file").alias("doc_id"), author_key(F.lit(author)).alias("source"), "text")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a schema; corrupt lines become nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def save(rows: DataFrame, path: str, by: str = "source") -> None:
    """Write or replace the authors present in rows, under their keys; others stay. An author's rows go to as many tasks as their size asks for."""
    mode = rows.sparkSession.conf.get("spark.sql.sources.partitionOverwriteMode")
    rows.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.withColumn(by, author_key(F.col(by))).hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(path)
    finally:
        rows.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", mode)


def load(spark: SparkSession, path: str, author: str | None = None, by: str = "source") -> DataFrame:
    """An author's rows, or all: the filter prunes directories."""
    rows = spark.read.parquet(path)
    return rows if author is None else rows.where(F.col(by) == author_key(F.lit(author)))


def upsert(profiles: DataFrame, changes: DataFrame, key: str = "name") -> DataFrame:
    """profiles with the rows of changes in place of those with the same key."""
    return profiles.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def inventory(docs: DataFrame, words: Column) -> DataFrame:
    """Documents, languages, words and rows without text of each author."""
    return docs.groupBy("source").agg(F.count("*").alias("documents"), F.countDistinct("lang").alias("languages"), F.sum(words).cast("long").alias("words"), F.round(F.avg(words), 4).alias("mean_words"), F.count_if(F.col("text").isNull()).alias("without_text"))


def presence(docs: DataFrame) -> DataFrame:
    """How many rows have each column."""
    counts = docs.agg(F.count("*").alias("_all"), *(F.count(F.col(f"`{c}`")).alias(c) for c in docs.columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("present"), F.col("_all").alias("rows")) for c in docs.columns))).alias("x")).select("x.*")


def _path(spark: SparkSession, path: str) -> tuple[object, object]:
    """A path and its file system, whatever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _path(spark, path)
    return bool(system.exists(at))


def drop(spark: SparkSession, path: str) -> bool:
    """Delete a whole collection; whether there was one."""
    at, system = _path(spark, path)
    return bool(system.exists(at)) and bool(system.delete(at, True))


def forget(spark: SparkSession, path: str, author: str, by: str = "source") -> bool:
    """Delete one author's rows of a collection; whether there were any. An author is a directory, so nothing else is read or written."""
    if not exists(spark, path):
        return False
    key = spark.range(1).select(author_key(F.lit(author)).alias("k")).first()["k"]
    found = [r[by] for r in load(spark, path, by=by).select(by).distinct().where(author_key(F.col(by)) == key).collect()]  # spellings of one name
    folder = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return any([drop(spark, f"{path.rstrip('/')}/{by}={folder(str(name))}") for name in found])
