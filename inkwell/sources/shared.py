"""Tables in the folder that driver and executors share: lineage ends there, and a lost executor costs no earlier work."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, else the context's folder, else one beside the warehouse; a temporary folder serves only a local master."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if context.master.startswith("local"):
        made = tempfile.mkdtemp(prefix="inkwell-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        context.setCheckpointDir(made)
        return made
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_inkwell"


#: Whether shuffle files go as soon as the query that wrote them has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, name: str, *, lean: bool = False) -> DataFrame:
    """df written as Parquet in the shared folder and read again. The application's folder is deleted when its driver ends in order.

    lean: less disk; the table is packed closer, and the shuffle files of the writing are deleted when it is done.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    home = f"{shared_dir(spark)}/inkwell-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(home)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    to = f"{home}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    if lean:
        spark.conf.set(CLEANUP, "true")
    try:
        (df.write.option("compression", "zstd") if lean else df.write).mode("overwrite").parquet(to)
    finally:
        if lean:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(to)
