"""Bright stars, stars in frames, and the older frame conventions."""

from __future__ import annotations

from math import cos, pi, sin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import separation
from ..sources.views import PIXSCALE
from .spatial import farthest_corner, met, nearest_centre, reaching


def bright_stars(stars: DataFrame, mag_limit: float = 15.0, lat_min: float = 5.0, ra: tuple | None = None, dec: tuple | None = None) -> DataFrame:
    """Stars brighter than a limit and off the galactic plane; bounds need both ends, and RA isn't wrapped.

    Every test is a comparison of a column with a number, so that files and databases can make it.
    """
    rows = stars.where((F.col("phot_g_mean_mag") < mag_limit) & ((F.col("b") >= lat_min) | (F.col("b") <= -lat_min)))
    for name, bounds in (("ra", ra), ("dec", dec)):
        if bounds is not None and None not in bounds:
            rows = rows.where(F.col(name).between(*bounds))
    return rows.select("source_id", "ra", "dec", "phot_g_mean_mag", "b")


def star_sidecars(frames: DataFrame, stars: DataFrame, maglim: float = 15.0, scale: float = PIXSCALE) -> DataFrame:
    """Stars within each frame (id, ra, dec, size_arcsec): brighter than a limit, within the half-diagonal, and their
    pixel in the frame.  East-west offsets aren't wrapped at RA 0."""
    half = F.lit(0.5) * F.sqrt(F.lit(2.0)) * F.col("size_arcsec")
    near = reaching(frames.select("id", F.col("ra").alias("ra0"), F.col("dec").alias("dec0"), "size_arcsec"), half, "ra0", "dec0", True)
    pairs = met(stars.where(F.col("phot_g_mean_mag") < maglim).select("source_id", "ra", "dec", "phot_g_mean_mag"), near, sphere=True)
    pairs = pairs.withColumn("sep_arcsec", separation(F.col("ra"), F.col("dec"), F.col("ra0"), F.col("dec0"))).where(F.col("sep_arcsec") <= half)
    size = F.rint(F.col("size_arcsec") / scale)
    pairs = pairs.withColumn("x_pix", size / 2 - (F.col("ra") - F.col("ra0")) * F.cos(F.radians("dec0")) * 3600.0 / scale).withColumn("y_pix", size / 2 + (F.col("dec") - F.col("dec0")) * 3600.0 / scale)
    inside = (F.col("x_pix") >= 0) & (F.col("x_pix") < size) & (F.col("y_pix") >= 0) & (F.col("y_pix") < size)
    return pairs.where(inside).select("id", "source_id", F.col("ra").alias("ra_deg"), F.col("dec").alias("dec_deg"), F.col("phot_g_mean_mag").alias("gmag"), "sep_arcsec", (F.col("sep_arcsec") / scale).alias("sep_pix"), "x_pix", "y_pix")


def legacy_sizes(galaxies: DataFrame, na: float = 3.0, scale: float = PIXSCALE) -> DataFrame:
    """Frame sizes as the older scripts have them: cut off for galaxies, rounded and held to 16..512 for fields and retries."""
    arcsec = F.col("d26") * na * 30.0
    clamped = F.least(F.lit(512), F.greatest(F.lit(16), F.rint(arcsec / scale).cast("int")))
    return galaxies.select("sga_id", (arcsec / scale).cast("int").alias("galaxy_px"), clamped.alias("field_px"), arcsec.alias("size_arcsec"))


def legacy_fields(galaxies: DataFrame, n: int = 6, away: float = 5.0) -> DataFrame:
    """n field positions on a circle of away * D26 / 2 around each galaxy; dec held to the poles, RA not wrapped.

    The circle is widened in RA by the declination, also by one beyond the poles; right at a pole it isn't.
    """
    spots = F.array(*[F.struct(F.lit(360.0 * i / n).alias("angle_deg"), F.lit(cos(2 * pi * i / n)).alias("c"), F.lit(sin(2 * pi * i / n)).alias("s")) for i in range(n)])
    rows = galaxies.select("sga_id", "ra", "dec", (F.col("d26") * away * 30.0 / 3600.0).alias("radius"), F.explode(spots).alias("p"))
    wide = F.when(F.abs("dec") != 90, F.col("radius") / F.cos(F.radians("dec"))).otherwise(F.col("radius"))
    dec = F.least(F.lit(90.0), F.greatest(F.lit(-90.0), F.col("dec") + F.col("radius") * F.col("p.s")))
    return rows.select("sga_id", F.col("p.angle_deg").alias("angle_deg"), (F.col("ra") + wide * F.col("p.c")).alias("field_ra"), dec.alias("field_dec"))


def parse_listing(files: DataFrame) -> DataFrame:
    """Fields in the names of frames; null where a name doesn't have them."""
    stem = F.regexp_replace("name", r"\.jpeg$", "")
    found = [F.regexp_extract(stem, r"_RA([-0-9.]+)_Dec([-0-9.]+)_size([-0-9.]+)$", i).try_cast("double") for i in (1, 2, 3)]
    return files.select("name", "length", F.get(F.split("name", "_"), F.lit(1)).try_cast("long").alias("sga_id"), *(c.alias(n) for c, n in zip(found, ("ra", "dec", "size_arcsec"), strict=True)))


def legacy_missing(galaxies: DataFrame, listing: DataFrame, threshold: int = 500) -> DataFrame:
    """Galaxies without a file, then those with one below a size; the last name of a galaxy counts."""
    last = parse_listing(listing).where("sga_id is not null").groupBy("sga_id").agg(F.max_by("length", "name").alias("length"))
    rows = galaxies.select("sga_id", "ra", "dec", "d26").join(last, "sga_id", "left")
    missing = rows.where("length is null").withColumn("state", F.lit("missing"))
    broken = rows.where(F.col("length") < threshold).withColumn("state", F.lit("broken"))
    return missing.unionByName(broken)


def missing_counts(galaxies: DataFrame, listing: DataFrame, threshold: int = 500) -> DataFrame:
    """One row: galaxies in all, ids with a file in the listing, galaxies missing and broken, and both together."""
    states = legacy_missing(galaxies, listing, threshold)
    n = states.agg(F.count_if(F.col("state") == "missing").alias("n_missing"), F.count_if(F.col("state") == "broken").alias("n_broken"), F.count("*").alias("n_retry"))
    total = galaxies.agg(F.count("*").alias("n_galaxies"))
    files = parse_listing(listing).agg(F.count_distinct("sga_id").alias("n_files"))
    return total.join(F.broadcast(files)).join(F.broadcast(n))


def legacy_footprint(galaxies: DataFrame, bricks: DataFrame, min_nexp: int = 1) -> DataFrame:
    """(sga_id) of galaxies inside the nearest brick of either hemisphere, whose exposures in all bands together are enough."""
    near = nearest_centre(galaxies.withColumn("id", F.col("sga_id")), bricks, at_most=farthest_corner(bricks))
    width = F.pmod(F.col("ra2") - F.col("ra1") + 360.0, F.lit(360.0))
    inside = (F.pmod(F.col("ra") - F.col("ra1") + 360.0, F.lit(360.0)) <= width) & F.col("dec").between(F.col("dec1"), F.col("dec2"))
    return near.where(inside & (F.col("nexp_g") + F.col("nexp_r") + F.col("nexp_z") >= min_nexp)).select(F.col("id").alias("sga_id")).distinct()
