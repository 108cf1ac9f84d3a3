"""Cell joins against brute force, also over RA 0 and at the poles, and their plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import spatial


def sky(n, seed, poles=True):
    rng = np.random.default_rng(seed)
    dec = np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
    ra = rng.uniform(0, 360, n)
    if poles:
        dec[: n // 4] = rng.choice([-1, 1], n // 4) * rng.uniform(89.2, 90, n // 4)
        ra[n // 4 : n // 2] = rng.uniform(-0.5, 0.5, n // 2 - n // 4) % 360
        dec[n // 4 : n // 2] = rng.uniform(-2, 2, n // 2 - n // 4)
    return ra, dec


def vectors(ra, dec):
    a, d = np.radians(ra), np.radians(dec)
    return np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], axis=1)


@pytest.mark.parametrize("arcsec", [600.0, 3000.0])
def test_neighbours_are_those_of_brute_force(spark, arcsec):
    ra, dec = sky(400, 5)
    df = spark.createDataFrame([(i, float(a), float(d)) for i, (a, d) in enumerate(zip(ra, dec, strict=True))], "id long, ra double, dec double")
    got = spatial.neighbours(df, df.withColumnRenamed("id", "other"), arcsec)
    pairs = [(r.id, r.other) for r in got.collect()]
    v = vectors(ra, dec)
    chord = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(chord <= 2 * np.sin(np.radians(arcsec / 3600) / 2))), strict=True))
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_clearance_is_that_of_brute_force(spark):
    rng = np.random.default_rng(8)
    ra, dec = sky(300, 9)
    r26, ba, pa = rng.uniform(10, 900, 300), rng.uniform(0.2, 1, 300), rng.uniform(0, 180, 300)
    rows = [(i, *map(float, x)) for i, x in enumerate(zip(ra, dec, r26, ba, pa, strict=True))]
    atlas = spark.createDataFrame(rows, "sga_id long, ra double, dec double, r26 double, ba double, pa double")
    pos = atlas.select(F.col("sga_id").alias("id"), "ra", "dec", F.lit(120.0).alias("extra"), F.col("sga_id").alias("exclude"))
    got = {r.id for r in spatial.blocked(pos, atlas).collect()}
    want = set()
    for i in range(300):
        north = (dec[i] - dec) * 3600
        east = ((ra[i] - ra + 180) % 360 - 180) * np.cos(np.radians(dec[i])) * 3600
        p = np.radians(pa)
        ell = np.hypot(east * np.sin(p) + north * np.cos(p), (north * np.sin(p) - east * np.cos(p)) / ba)
        close = (ell <= 1.5 * r26 + 120 / ba) & (np.hypot(east, north) <= 1.5 * r26 + 120)
        close[i] = False
        if close.any():
            want.add(i)
    assert got == want


def test_no_nested_loops_in_the_spatial_plans(spark, capsys):
    from starloom.plans import catalogue

    for name in ("resolve_bricks", "clearance_targets", "overlapping", "star_sidecars", "neighbours"):
        catalogue.REGISTRY[name](spark, "/root/testdata/sf0.001").explain("formatted")
        plan = capsys.readouterr().out
        assert "CartesianProduct" not in plan
        nested = [x for x in plan.split("\n\n") if "BroadcastNestedLoopJoin" in x and "Join condition: None" not in x and "Arguments" in x]
        assert not nested, name


def test_a_position_on_a_shared_edge_gets_one_brick(spark):
    bricks = spark.createDataFrame(
        [("south", "a", 359.875, 0.0, 359.75, 0.0, -0.125, 0.125, 1, 1, 1), ("south", "b", 0.125, 0.0, 0.0, 0.25, -0.125, 0.125, 1, 1, 1), ("south", "c", 0.375, 0.0, 0.25, 0.5, -0.125, 0.125, 0, 1, 1)],
        "hemisphere string, brickname string, ra double, dec double, ra1 double, ra2 double, dec1 double, dec2 double, nexp_g int, nexp_r int, nexp_z int",
    )
    pos = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.25, 0.125), (3, 0.3, 0.0), (4, 359.8, 0.0), (5, 0.1, 0.2)], "id long, ra double, dec double")
    got = {r.id: r.brick for r in spatial.resolve_bricks(pos, bricks).collect()}
    assert got == {1: "a", 2: "b", 4: "a"}


def test_the_nearest_centre_is_found_however_far(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    unit = lambda ra, dec: np.stack([np.cos(np.radians(dec)) * np.cos(np.radians(ra)), np.cos(np.radians(dec)) * np.sin(np.radians(ra)), np.sin(np.radians(dec))], -1)
    b = [("south", f"s{i}", float(r), float(d)) for i, (r, d) in enumerate(zip(rng.uniform(0, 360, 9), rng.uniform(-90, 30, 9), strict=True))] + [("north", "n0", 10.0, 89.0), ("north", "n1", 359.9, 60.0)]
    p = [(i, float(r), float(d)) for i, (r, d) in enumerate(zip(rng.uniform(0, 360, 40), rng.uniform(-90, 90, 40), strict=True))] + [(40, b[0][2], b[0][3]), (41, 180.0, -90.0)]
    bricks = spark.createDataFrame([(*x, 0.0, 0.0, 0.0, 0.0, 1, 1, 1) for x in b], "hemisphere string, brickname string, ra double, dec double, ra1 double, ra2 double, dec1 double, dec2 double, nexp_g int, nexp_r int, nexp_z int")
    from starloom.operators import spatial

    got = {(r.id, r.hemisphere): r.brickname for r in spatial.nearest_centre(spark.createDataFrame(p, "id long, ra double, dec double"), bricks).collect()}
    for i, ra, dec in p:
        for side in ("south", "north"):
            own = [x for x in b if x[0] == side]
            far = np.linalg.norm(unit(np.array([x[2] for x in own]), np.array([x[3] for x in own])) - unit(ra, dec), axis=1)
            assert got[i, side] == own[int(np.argmin(far))][1]
    assert len(got) == 2 * len(p)


def test_ranks_without_one_task(spark):
    from pyspark.sql import functions as F

    from starloom.operators import select

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    rows, n = select.ranked(df, ["k"])
    assert n == 1000 and all(r.k == r._rank for r in rows.collect())
    got = [r.k for r in select.subsample(df, ["k"], 26, 20).orderBy("k").collect()]
    assert got == [round(i * (999 / 25)) for i in range(20)]
    assert select.subsample(df, ["k"], 5000).count() == 1000 and [r.k for r in select.subsample(df, ["k"], 1).collect()] == [0]
    assert select.subsample(df.limit(0), ["k"], 3).collect() == []


def crowd(n, seed):
    """Half of the positions within an arcminute of one place near RA 0."""
    ra, dec = sky(n, seed)
    rng = np.random.default_rng(seed)
    ra[: n // 2] = (359.99 + rng.uniform(0, 1 / 60, n // 2)) % 360
    dec[: n // 2] = 20 + rng.uniform(0, 1 / 60, n // 2)
    return ra, dec


def test_a_crowded_cell_is_split_and_pairs_stay_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spatial, "FULL", 40)
    ra, dec = crowd(600, 3)
    df = spark.createDataFrame([(i, float(a), float(d)) for i, (a, d) in enumerate(zip(ra, dec, strict=True))], "id long, ra double, dec double")
    others = df.withColumnsRenamed({"id": "other", "ra": "ora", "dec": "odec"})
    p, b = spatial.leaves(df, spatial.reaching(others, F.lit(3.0), "ora", "odec", True))
    sizes = p.groupBy("cell_n", "cell_y", "cell_x").count().agg(F.max("count"), F.max("cell_n"), F.sum("count")).head()
    assert sizes[0] <= 40 and sizes[1] >= 3 and sizes[2] == 600  # without the split one cell would hold some 100 or more
    assert b.count() < 2 * 600
    v = vectors(ra, dec)
    chord = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    for arcsec in (3.0, 2000.0):
        pairs = [(r.id, r.other) for r in spatial.neighbours(df, df.withColumnRenamed("id", "other"), arcsec).collect()]
        want = set(zip(*map(np.ndarray.tolist, np.nonzero(chord <= 2 * np.sin(np.radians(arcsec / 3600) / 2))), strict=True))
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_rows_at_one_place_end_the_splits(spark, monkeypatch):
    monkeypatch.setattr(spatial, "FULL", 5)
    monkeypatch.setattr(spatial, "DEEPEST", 3)
    df = spark.range(30).select("id", F.lit(12.3).alias("ra"), F.lit(-4.5).alias("dec"))
    assert spatial.neighbours(df, df.withColumnRenamed("id", "other"), 1.0).count() == 900


def beyond(n, seed):
    """Positions near the poles and elsewhere whose declinations go on beyond the poles, some of them several times around."""
    rng = np.random.default_rng(seed)
    ra = (358 + rng.uniform(0, 4, n)) % 360
    dec = rng.choice([-90.0, -210.0, -270.0, -330.0, 30.0, -450.0], n) + rng.uniform(-0.5, 0.5, n)
    return ra, dec


@pytest.mark.parametrize("arcsec", [200.0, 1500.0])
def test_declinations_beyond_the_poles_keep_their_neighbours(spark, arcsec):
    ra, dec = beyond(400, 4)
    df = spark.createDataFrame([(i, float(a), float(d)) for i, (a, d) in enumerate(zip(ra, dec, strict=True))], "id long, ra double, dec double")
    others = df.withColumnsRenamed({"id": "other", "ra": "ora", "dec": "odec"})
    near = spatial.reaching(others, F.lit(arcsec), "ora", "odec", True)
    tall = near.agg(F.max(F.col("_y1") - F.col("_y0")), F.min("_y1")).head()
    assert tall[0] <= 2 * arcsec / 3600 + 1e-6 and tall[1] >= -90  # boxes stay on the sphere: they reached from a pole to the declination
    pairs = [(r.id, r.other) for r in spatial.neighbours(df, df.withColumnRenamed("id", "other"), arcsec).collect()]
    v = vectors(ra, dec)
    chord = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(chord <= 2 * np.sin(np.radians(arcsec / 3600) / 2))), strict=True))
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    atlas = df.select(F.col("id").alias("sga_id"), "ra", "dec", F.lit(arcsec / 2).alias("r26"))
    found = spatial.overlapping(df.withColumn("half_diag", F.lit(arcsec / 2)), atlas)
    assert {(r.id, r.sga_id) for r in found.collect()} == want


def test_declinations_beyond_the_poles_keep_their_clearance(spark):
    ra, dec = beyond(400, 7)
    rows = [(i, float(a), float(d), 60.0 + i % 40, 0.3 + i % 7 / 10, float(i * 53 % 180)) for i, (a, d) in enumerate(zip(ra, dec, strict=True))]
    atlas = spark.createDataFrame(rows, "sga_id long, ra double, dec double, r26 double, ba double, pa double")
    pos = atlas.select(F.col("sga_id").alias("id"), "ra", "dec", F.lit(50.0).alias("extra"), F.col("sga_id").alias("exclude"))
    near = spatial.reaching(atlas, F.col("r26") * 1.5 + 50.0)
    assert near.agg(F.max(F.col("_y1") - F.col("_y0"))).head()[0] < 0.2  # boxes lie about their own declination
    _, _, _, r26, ba, pa = (np.array(c) for c in zip(*rows, strict=True))
    want = set()
    for i in range(len(rows)):
        north = (dec[i] - dec) * 3600
        east = ((ra[i] - ra + 180) % 360 - 180) * np.cos(np.radians(dec[i])) * 3600
        p = np.radians(pa)
        ell = np.hypot(east * np.sin(p) + north * np.cos(p), (north * np.sin(p) - east * np.cos(p)) / ba)
        close = (ell <= 1.5 * r26 + 50 / ba) & (np.hypot(east, north) <= 1.5 * r26 + 50)
        close[i] = False
        if close.any():
            want.add(i)
    assert 0 < len(want) < len(rows)
    assert {r.id for r in spatial.blocked(pos, atlas).collect()} == want
