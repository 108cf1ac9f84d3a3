"""Pixel masks: flags of pixels, and shapes of detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import positive

#: Bits 2 to 7 of maskbits: bright stars and saturation; bit 12: an atlas galaxy.
BRIGHT_BITS, GALAXY_BIT = 252, 4096
INVALID, BRIGHT, SOURCE, GALAXY = 1, 2, 4, 8
BANDS = ("g", "r", "z")


def invalid() -> Column:
    """Without coverage in some band."""
    return ~(positive(F.col("ivar_g")) & positive(F.col("ivar_r")) & positive(F.col("ivar_z")))


def bright() -> Column:
    return F.col("mask").bitwiseAND(BRIGHT_BITS) != 0


def galaxy_bit() -> Column:
    return F.col("mask").bitwiseAND(GALAXY_BIT) != 0


def share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def source_shapes(tractor: DataFrame, psf_fwhm_r: Column, radius_factor: float = 2.0, psf_factor: float = 1.25, least: float = 1.0) -> DataFrame:
    """Adds point, radius, axis_ratio and angle of detections."""
    point = F.trim("type").isin("PSF", "DUP")
    e = F.hypot("shape_e1", "shape_e2")
    radius = F.when(point, F.greatest(psf_fwhm_r * psf_factor, F.lit(least))).otherwise(F.greatest(F.col("shape_r") * radius_factor, F.lit(least)))
    ratio = F.when(point | (e <= 0), 1.0).otherwise((1.0 - e) / (1.0 + e))
    return tractor.withColumn("point", point).withColumn("radius", radius).withColumn("axis_ratio", ratio).withColumn("angle", F.degrees(F.atan2("shape_e2", "shape_e1")) * 0.5)
