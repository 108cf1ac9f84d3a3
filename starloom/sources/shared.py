"""Tables that are written once and read by all that follows, in the folder that executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI under the one that spark.checkpoint.dir names; a local session without it uses a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "starloom-shared")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table: what is derived from it several times is made once, and a lost executor costs no more than its tasks."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """df for a join that shuffles both its sides: Spark takes the size of compressed files for that of a table, however many
    rows are made of each of theirs, and would send such a table whole through the driver's memory."""
    return df.hint("merge")


def removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
