"""Candidates that arrive in a folder, each processed once.

An addition: the batch drivers resume by an anti-join with their ledger; here the checkpoint remembers the files, the
watermarked state drops repeats among recent arrivals, and the anti-join with the ledger makes a replayed batch add nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import resume


def arrivals(spark: SparkSession, folder: str, schema: str, late: str = "1 hour") -> DataFrame:
    """Rows of the Parquet files of a folder as they come, one for each file name within the time that repeats may be late."""
    rows = spark.readStream.schema(schema).parquet(folder).withColumn("arrived", F.current_timestamp())
    return rows.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["file"])


def follow(candidates: DataFrame, work, ledger_path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that runs work (a DataFrame to ledger rows with file and status) on new candidates and appends to a Parquet ledger."""

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            rows = resume(rows, spark.read.parquet(ledger_path))
        work(rows.drop("arrived")).write.mode("append").parquet(ledger_path)

    return candidates.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
