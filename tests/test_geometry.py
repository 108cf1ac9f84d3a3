"""Properties of the sphere and plane expressions."""

import numpy as np
from pyspark.sql import functions as F

from starloom.functions import geometry as G


def frame(spark, **columns):
    rows = list(zip(*(np.asarray(c, float).tolist() for c in columns.values()), strict=True))
    return spark.createDataFrame(rows, list(columns))


def test_points_on_an_ellipse_return_its_axis(spark):
    rng = np.random.default_rng(1)
    a, ba, pa, t = rng.uniform(1, 50, 200), rng.uniform(0.1, 1, 200), rng.uniform(0, 180, 200), rng.uniform(0, 2 * np.pi, 200)
    major, minor, p = a * np.cos(t), a * ba * np.sin(t), np.radians(pa)
    east, north = major * np.sin(p) - minor * np.cos(p), major * np.cos(p) + minor * np.sin(p)
    df = frame(spark, e=east, n=north, pa=pa, ba=ba, a=a).select("a", G.elliptical_radius(*map(F.col, ("e", "n", "pa", "ba"))).alias("r")).toPandas()
    assert np.allclose(df.a, df.r, atol=1e-9)


def test_a_step_ends_as_far_away_as_asked_even_near_poles(spark):
    rng = np.random.default_rng(2)
    dec = np.concatenate([rng.uniform(-89.9, 89.9, 100), [89.99, -89.99, 0, 0]])
    ra, sep, pa = rng.uniform(0, 360, 104), rng.uniform(1, 7200, 104), rng.uniform(0, 360, 104)
    df = frame(spark, ra=ra, dec=dec, sep=sep, pa=pa)
    to_ra, to_dec = G.offset_position(*map(F.col, ("ra", "dec", "sep", "pa")))
    out = df.withColumn("r2", to_ra).withColumn("d2", to_dec).withColumn("back", G.separation(*map(F.col, ("ra", "dec", "r2", "d2")))).toPandas()
    assert np.allclose(out.sep, out.back, rtol=1e-6, atol=1e-2)
    assert ((out.r2 >= 0) & (out.r2 < 360)).all()


def test_pixels_and_positions_are_inverse(spark):
    rng = np.random.default_rng(3)
    ra0, dec0 = rng.uniform(0, 360, 100), rng.uniform(-80, 80, 100)
    x, y = rng.uniform(-100, 200, 100), rng.uniform(-100, 200, 100)
    df = frame(spark, ra0=ra0, dec0=dec0, x=x, y=y)
    ra, dec = G.to_world(F.col("x"), F.col("y"), F.col("ra0"), F.col("dec0"), F.lit(0.262), F.lit(33.0))
    df = df.withColumn("ra", ra).withColumn("dec", dec)
    px, py = G.to_pixel(F.col("ra"), F.col("dec"), F.col("ra0"), F.col("dec0"), F.lit(0.262), F.lit(33.0))
    out = df.withColumn("px", px).withColumn("py", py).toPandas()
    assert np.allclose(out.x, out.px, atol=1e-5) and np.allclose(out.y, out.py, atol=1e-5)


def test_half_even_rounding_of_stamp_sides(spark):
    from starloom.operators.catalog import stamp_side

    df = frame(spark, d26=[0.01, 1.0, 2.5]).select(stamp_side().alias("s")).toPandas()
    assert df.s.tolist() == [64, round(1.5 * 60 / 0.262), round(1.5 * 150 / 0.262)]
