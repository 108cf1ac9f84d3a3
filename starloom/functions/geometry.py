"""Positions on the sphere and on a tangent plane, as column expressions (degrees and arcseconds)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_vector(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    a, d = F.radians(ra), F.radians(dec)
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def chord_length(degrees: Column) -> Column:
    """Straight distance between unit vectors that far apart."""
    return F.sin(F.radians(degrees) / 2) * 2


def chord(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    parts = [(x - y) * (x - y) for x, y in zip(unit_vector(ra1, dec1), unit_vector(ra2, dec2), strict=True)]
    return F.sqrt(parts[0] + parts[1] + parts[2])


def elliptical_radius(east: Column, north: Column, pa: Column, ba: Column) -> Column:
    """Semi-major axis of the ellipse (position angle from north to east, axis ratio ba) through an offset."""
    t = F.radians(pa)
    return F.hypot(east * F.sin(t) + north * F.cos(t), (north * F.sin(t) - east * F.cos(t)) / ba)


def offset_position(ra: Column, dec: Column, arcsec: Column, pa: Column) -> tuple[Column, Column]:
    """Where a great-circle step of so many arcseconds along pa ends; RA in [0, 360)."""
    d, t, p = F.radians(dec), F.radians(arcsec / 3600.0), F.radians(pa)
    s = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.sin(d) * F.cos(t) + F.cos(d) * F.sin(t) * F.cos(p)))
    turn = F.atan2(F.sin(p) * F.sin(t) * F.cos(d), F.cos(t) - F.sin(d) * s)
    return F.pmod(ra + F.degrees(turn), F.lit(360.0)), F.degrees(F.asin(s))


def tangent_offsets(ra: Column, dec: Column, ra0: Column, dec0: Column, at_dec: Column) -> tuple[Column, Column]:
    """(east, north) arcseconds from (ra0, dec0) to (ra, dec), RA scaled at at_dec, over RA 0 the short way."""
    east = (F.pmod(ra - ra0 + 180.0, F.lit(360.0)) - 180.0) * F.cos(F.radians(at_dec)) * 3600.0
    return east, (dec - dec0) * 3600.0


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle arcseconds by the chord, which keeps its digits where the arc is small."""
    return F.degrees(F.asin(F.least(F.lit(1.0), chord(ra1, dec1, ra2, dec2) / 2))) * 7200.0


def to_pixel(ra: Column, dec: Column, ra0: Column, dec0: Column, scale: Column, crpix: float | Column) -> tuple[Column, Column]:
    """Gnomonic projection about (ra0, dec0) onto pixels of scale arcseconds, counted from 0, east to the left; crpix from 1."""
    d, d0, a = F.radians(dec), F.radians(dec0), F.radians(ra - ra0)
    below = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(a)
    xi = F.degrees(F.cos(d) * F.sin(a) / below) * 3600.0
    eta = F.degrees((F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(a)) / below) * 3600.0
    return crpix - 1 - xi / scale, crpix - 1 + eta / scale


def to_world(x: Column, y: Column, ra0: Column, dec0: Column, scale: Column, crpix: float | Column) -> tuple[Column, Column]:
    """The inverse of to_pixel."""
    xi, eta = F.radians((crpix - 1 - x) * scale / 3600.0), F.radians((y - (crpix - 1)) * scale / 3600.0)
    d0 = F.radians(dec0)
    below = F.cos(d0) - eta * F.sin(d0)
    ra = ra0 + F.degrees(F.atan2(xi, below))
    dec = F.degrees(F.atan2(F.sin(d0) + eta * F.cos(d0), F.hypot(xi, below)))
    return F.pmod(ra, F.lit(360.0)), dec
