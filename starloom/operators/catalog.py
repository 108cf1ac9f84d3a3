"""Galaxy atlas: radii, shapes, selection and stamp sizes."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.views import PIXSCALE


def positive(c: Column) -> Column:
    """c > 0 as NumPy has it: false for NaN."""
    return (c > 0) & ~F.isnan(c)


def with_geometry(galaxies: DataFrame) -> DataFrame:
    """Adds r26 (arcsec) and cleans ba (1 unless in (0, 1]) and pa (0 for NaN and null, the largest double for an infinite one)."""
    most = sys.float_info.max
    r26 = F.when(positive(F.col("sma_sb26")), F.col("sma_sb26")).otherwise(F.col("d26") * 30.0)
    ba = F.when(positive(F.col("ba")) & (F.col("ba") <= 1), F.col("ba")).otherwise(1.0)
    return galaxies.withColumn("r26", r26).withColumn("ba", ba).withColumn("pa", F.greatest(F.least(F.coalesce(F.nanvl("pa", F.lit(0.0)), F.lit(0.0)), F.lit(most)), F.lit(-most)))


def isophotal_radius(sb: float) -> Column:
    """Radius at a surface brightness beyond 26, by the growth from 25 to 26 or a quarter of r26 without it."""
    r26, r25 = F.col("sma_sb26"), F.col("sma_sb25")
    grown = F.greatest(F.when(positive(r25), r26 - r25).otherwise(r26 * 0.25), r26 * 0.1)
    base = F.when(positive(r26), r26).otherwise(F.col("d26") * 30.0)
    return base + F.when(positive(r26), grown).otherwise(F.col("d26") * 30.0 * 0.25) * max(sb - 26.0, 0.0)


def select_redshift(galaxies: DataFrame, zcut: float = 0.05) -> DataFrame:
    return galaxies.where(positive(F.col("z_leda")) & (F.col("z_leda") < zcut))


def stamp_side(size_mult: float = 1.5, min_size: int = 64) -> Column:
    return F.greatest(F.rint(size_mult * F.col("d26") * 60.0 / PIXSCALE).cast("int"), F.lit(min_size))


def half_diagonal(side: Column) -> Column:
    return F.sqrt(F.lit(2.0)) * 0.5 * side * PIXSCALE
