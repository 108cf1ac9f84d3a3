"""Tangent-plane projections with a full matrix, as column expressions, and their local slopes.

A frame is the columns ra0, dec0 (degrees at the reference pixel), crpix1, crpix2 (counted from 1) and cd11, cd12, cd21, cd22
(arcseconds of the plane for a pixel's step: east by x, east by y, north by x, north by y), so that frames may be rotated,
flipped or sheared.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAME = ("ra0", "dec0", "crpix1", "crpix2", "cd11", "cd12", "cd21", "cd22")


class Frame(NamedTuple):
    ra0: Column
    dec0: Column
    crpix1: Column
    crpix2: Column
    cd11: Column
    cd12: Column
    cd21: Column
    cd22: Column


def frame(prefix: str = "") -> Frame:
    """The frame of a row, whose columns may have a prefix."""
    return Frame(*[F.col(prefix + c) for c in FRAME])


def north_up(ra0: Column, dec0: Column, scale: Column, crpix: Column) -> Frame:
    """Pixels of scale arcseconds, east to the left."""
    return Frame(ra0, dec0, crpix, crpix, -scale, F.lit(0.0), F.lit(0.0), scale)


def pixel(f: Frame, ra: Column, dec: Column) -> tuple[Column, Column]:
    """Where a position is in a frame, in pixels from 0."""
    d, d0, a = F.radians(dec), F.radians(f.dec0), F.radians(ra - f.ra0)
    below = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(a)
    xi = F.degrees(F.cos(d) * F.sin(a) / below) * 3600.0
    eta = F.degrees((F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(a)) / below) * 3600.0
    det = f.cd11 * f.cd22 - f.cd12 * f.cd21
    return (f.cd22 * xi - f.cd12 * eta) / det + f.crpix1 - 1, (f.cd11 * eta - f.cd21 * xi) / det + f.crpix2 - 1


def _turned(degrees: Column) -> Column:
    """Degrees in [0, 360), with the roundings of the usual double remainder, which differences of a pixel's step show."""
    return (degrees % 360.0 + 360.0) % 360.0


def world(f: Frame, x: Column, y: Column) -> tuple[Column, Column]:
    """The inverse of pixel; RA in [0, 360)."""
    dx, dy = x + 1 - f.crpix1, y + 1 - f.crpix2
    xi, eta = F.radians((f.cd11 * dx + f.cd12 * dy) / 3600.0), F.radians((f.cd21 * dx + f.cd22 * dy) / 3600.0)
    d0 = F.radians(f.dec0)
    below = F.cos(d0) - eta * F.sin(d0)
    dec = F.degrees(F.atan2(F.sin(d0) + eta * F.cos(d0), F.sqrt(xi * xi + below * below)))
    return _turned(f.ra0 + F.degrees(F.atan2(xi, below))), dec


def continued(ra: Column, dec: Column, ra0: Column, dec0: Column) -> tuple[Column, Column]:
    """The same point by the numbers that go on from (ra0, dec0): RA within 90 degrees of ra0, and a declination that may pass the poles, as dec0's may."""
    over = F.abs(F.pmod(ra - ra0 + 180.0, F.lit(360.0)) - 180.0) > 90.0
    d = F.when(over, 180.0 - dec).otherwise(dec)
    return F.when(over, F.pmod(ra + 180.0, F.lit(360.0))).otherwise(ra), d + F.round((dec0 - d) / 360.0) * 360.0


def jacobian(f: Frame, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """(east by x, east by y, north by x, north by y) in arcseconds for steps of one pixel from (x, y), over RA 0 the short way."""
    ra, dec = world(f, x, y)
    wide = F.cos(F.radians(dec))
    out = []
    for at in ((x + 1.0, y), (x, y + 1.0)):
        a, d = world(f, *at)
        out.append(((_turned(a - ra + 180.0) - 180.0) * wide * 3600.0, (d - dec) * 3600.0))
    return out[0][0], out[1][0], out[0][1], out[1][1]


def with_jacobian(frames: DataFrame, width: Column, height: Column) -> DataFrame:
    """Adds je_x, je_y, jn_x and jn_y at the centre of each frame."""
    return frames.withColumns(dict(zip(("je_x", "je_y", "jn_x", "jn_y"), jacobian(frame(), (width - 1) / 2.0, (height - 1) / 2.0), strict=True)))
