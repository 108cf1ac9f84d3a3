"""Stars of a remote database: its own filters, read in ranges side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stars import bright_stars

#: What is read of a star.
STAR = ("source_id", "ra", "dec", "phot_g_mean_mag", "b")


def star_table(spark: SparkSession, url: str, table: str, partitions: int = 64, on: str = "source_id", **options: str) -> DataFrame:
    """The columns of STAR of a database's table, by partitions that are ranges of a column of whole numbers.

    The ranges lie between the column's ends, which the database is asked for; rows without the column are in the first.
    Filters and columns that are chosen later are the database's work.  options (driver, user, fetchsize, ...) are the reader's.
    """
    source = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    ends = source.load().agg(F.min(on), F.max(on)).head()
    if ends[0] is None or ends[0] == ends[1]:
        return source.load().select(*STAR)
    ranges = {"partitionColumn": on, "lowerBound": str(ends[0]), "upperBound": str(ends[1] + 1), "numPartitions": str(partitions)}
    return source.options(**ranges).load().select(*STAR)


def remote_stars(spark: SparkSession, url: str, table: str, mag_limit: float = 15.0, lat_min: float = 5.0, ra: tuple | None = None, dec: tuple | None = None, partitions: int = 64, **options: str) -> DataFrame:
    """bright_stars of a database's table; no others leave the database."""
    return bright_stars(star_table(spark, url, table, partitions, **options), mag_limit, lat_min, ra, dec)
