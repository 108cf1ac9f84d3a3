"""Targets: selected, in the footprint, isolated; and evenly spaced subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dealt, kept
from .catalog import half_diagonal, select_redshift, stamp_side, with_geometry
from .spatial import clear_of, resolve_bricks


def galaxy_targets(galaxies: DataFrame, bricks: DataFrame, zcut: float = 0.05, min_nexp: int = 1, size_mult: float = 1.5, min_size: int = 64, sga_margin: float = 1.5) -> DataFrame:
    """Isolated galaxies with the brick that covers them, by right ascension."""
    atlas = with_geometry(galaxies)
    chosen = select_redshift(atlas, zcut).withColumn("size_px", stamp_side(size_mult, min_size)).withColumn("id", F.col("sga_id"))
    found = chosen.join(dealt(resolve_bricks(chosen, bricks, min_nexp)), "id")
    clear = clear_of(found.withColumn("extra", half_diagonal(F.col("size_px"))).withColumn("exclude", F.col("sga_id")), atlas, sga_margin)
    return clear.select("sga_id", "galaxy", "ra", "dec", "d26", "size_px", "group_name", "group_ra", "brick", "hemisphere").orderBy("ra", "sga_id")


def ranked(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """(df with _rank, its place from 0 on in an order; number of rows), sorted by range and never in one task.

    The sorted runs are written; what comes to the driver is one count for each of them, from which each run's first rank is known.
    """
    spark = df.sparkSession
    rows = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    run = F.shiftright("_at", 33)
    counts = sorted(rows.groupBy(run.alias("run")).agg(F.min("_at").alias("first"), F.count("*").alias("n")).collect())
    starts, total = [], 0
    for r in counts:
        starts.append((r.run, r.first, total))
        total += r.n
    found = rows.withColumn("_run", run).join(F.broadcast(spark.createDataFrame(starts, "_run long, _first long, _before long")), "_run")
    return found.withColumn("_rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_run", "_first", "_before"), total


def subsample(df: DataFrame, order: list[str], sample: int | None = None, limit: int | None = None) -> DataFrame:
    """Rows at evenly spaced ranks of an order, then the first of them; all rows if the sample isn't smaller than they are."""
    if sample:
        rows, n = ranked(df, order)
        df = rows.drop("_rank")
        if sample < n:
            picks = sorted({round(i * ((n - 1) / max(sample - 1, 1))) for i in range(sample)})  # halves go to the even rank
            df = rows.join(F.broadcast(df.sparkSession.createDataFrame([(i,) for i in picks], "_rank long")), "_rank", "left_semi").drop("_rank")
    return df.orderBy(*order).limit(limit) if limit else df


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows drawn without replacement by the order of their keys' hashes under a seed; rows with equal keys stay in no order."""
    drawn = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return df.orderBy(drawn, key).limit(n)
