"""The runs from end to end on a small sky of real files, stopped and begun again."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.plans import catalogue, runs
from starloom.sources import files
from starloom.sources import images as I

SF = "/root/testdata/sf0.001"
SIZE, STEP = 64, 15.0  # a brick of a quarter of a degree in coarse pixels

ARGS = ["--limit", "40", "--size-mult", "0.01", "--min-size", "8", "--zcut", "0.06"]


@pytest.fixture(scope="module")
def sky(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sky")
    galaxies, bricks = catalogue.v(spark, SF, "galaxies"), catalogue.v(spark, SF, "bricks")
    rng, paths = np.random.default_rng(9), []
    used = {r.brick for r in runs.propose(galaxies, bricks, runs.arguments(runs.Backgrounds, [*ARGS, "--n-candidates", "2"])).select("brick").distinct().collect()}
    used |= {r.brick for r in runs.targets(galaxies, bricks, runs.arguments(runs.Galaxies, ARGS)).select("brick").distinct().collect()}
    for n, b in enumerate(r for r in bricks.orderBy("brickname").collect() if r.brickname in used):
        head = [("CRVAL1", b.ra), ("CRVAL2", b.dec), ("CRPIX1", (SIZE + 1) / 2), ("CRPIX2", (SIZE + 1) / 2), ("CD1_1", -STEP / 3600), ("CD1_2", 0.0), ("CD2_1", 0.0), ("CD2_2", STEP / 3600)]
        covered = 0.0 if n % 7 == 3 else 1.0
        data = {f"{k}_{c}": v for c in "grz" for k, v in (("sci", rng.normal(size=(SIZE, SIZE)).astype("f4")), ("ivar", np.full((SIZE, SIZE), covered, "f4")), ("psf", np.full((SIZE, SIZE), 1.2, "f4")))}
        data["mask"] = np.where(rng.random((SIZE, SIZE)) < 0.002, 4096, 0).astype("i2")
        one = root / f"{b.brickname}.fits.fz"
        if n % 11 != 5:  # some bricks never come
            one.write_bytes(I.fits_file([I.image_hdu(k, v, head, "RICE_1" if k == "mask" else None) for k, v in data.items()]))
        paths += [(b.brickname, k, str(one)) for k in data]
    detections = catalogue.v(spark, SF, "tractor").join(runs.targets(galaxies, bricks, runs.Galaxies()).select(F.col("sga_id").alias("grp"), "brick"), "grp").drop("grp")
    return galaxies, bricks, detections, spark.createDataFrame(paths, "brick string, plane string, file string")




def test_a_galaxy_run_goes_on_where_it_stopped(spark, sky, tmp_path):
    galaxies, bricks, detections, paths = sky
    out = str(tmp_path / "run")
    s = runs.arguments(runs.Galaxies, ARGS)
    first = runs.galaxy_run(spark, galaxies, bricks, detections, paths, out, s, bricks_at_once=25, stop_after=1)
    rest = runs.galaxy_run(spark, galaxies, bricks, detections, paths, out, s, bricks_at_once=25)
    assert first > 0 and rest > 0 and runs.galaxy_run(spark, galaxies, bricks, detections, paths, out, s) == 0
    rows = files.ledger(spark, f"{out}/manifest").collect()
    assert len(rows) == first + rest == len({r.sga_id for r in rows}) and {r.status for r in rows} == {"written", "rejected"}
    assert all((r.valid_frac < 0.8) == (r.reason == "coverage") and r.psf_g == pytest.approx(1.2) for r in rows)
    on_disk = {n: os.path.join(d, n) for d, _, names in os.walk(f"{out}/samples") for n in names}
    assert set(on_disk) == {r.file for r in rows if r.status == "written"}
    r = next(r for r in rows if r.status == "written")
    with open(on_disk[r.file], "rb") as f:
        found = {p.name: p for p in I.planes(f)}
        layers = I.rows(f, found["LAYERS"])
        assert layers.shape == (r.size_px, r.size_px) and np.mean(layers & 4 != 0) == pytest.approx(r.source_frac) and np.mean(layers & 8 != 0) == pytest.approx(r.galaxy_frac)
        assert found["SCI:0"].header["BRICK"] == r.brick and float(found["SCI:0"].header["PSF_R"]) == pytest.approx(1.2)
    with pytest.raises(ValueError, match="other parameters"):
        runs.galaxy_run(spark, galaxies, bricks, detections, paths, out, runs.Galaxies(zcut=0.03))
    counts = runs.companion_run(spark, files.ledger(spark, f"{out}/manifest"), galaxies, detections, str(tmp_path / "companions"))
    assert counts.count() == 3 and spark.read.csv(str(tmp_path / "companions"), header=True).count() == sum(r.status == "written" for r in rows)


def test_a_background_run_is_stopped_between_batches(spark, sky, tmp_path):
    galaxies, bricks, detections, paths = sky
    s = runs.arguments(runs.Backgrounds, [*ARGS, "--n-candidates", "2"])
    whole = runs.background_run(spark, galaxies, bricks, detections, paths, str(tmp_path / "whole"), s).collect()
    out = str(tmp_path / "run")
    part = runs.background_run(spark, galaxies, bricks, detections, paths, out, s, bricks_at_once=12, stop_after=1).collect()
    after = runs.background_run(spark, galaxies, bricks, detections, paths, out, s, bricks_at_once=12).collect()
    again = runs.background_run(spark, galaxies, bricks, detections, paths, out, s).collect()
    key = lambda rows: sorted((r.parent_sga_id, r.k, r.status, r.reason) for r in rows)
    assert key(whole) == key(after) == key(again) != key(part)
    assert {r.reason for r in part} >= {"error"} and not {r.reason for r in whole} & {"error"}
    assert {r.reason for r in whole} >= {"", "fetch", "coverage"}
    entered = files.ledger(spark, f"{out}/manifest", files.BACKGROUND_LEDGER)
    assert entered.count() == entered.select("file").distinct().count() == sum(r.status == "accepted" or r.reason == "coverage" and r.on_grid >= 0.8 for r in after)
    assert spark.read.csv(f"{out}/candidates", header=True).count() == len(after)
    figures = runs.report(candidates(spark, after))
    assert figures["rejections"].count() >= 3
    with pytest.raises(ValueError, match="other parameters"):
        runs.background_run(spark, galaxies, bricks, detections, paths, out, runs.Backgrounds(seed=1))


def candidates(spark, rows):
    return spark.createDataFrame([(r.parent_sga_id, r.k, r.brick, r.in_parent_brick, r.sep_arcsec, r.status, r.reason) for r in rows], "parent_sga_id long, k int, brick string, in_parent_brick int, sep_arcsec double, status string, reason string")


def test_the_psf_library_from_files_to_json(spark, sky, tmp_path):
    galaxies, bricks, _, _ = sky
    groups = [r.group_name for r in runs.targets(galaxies, bricks, runs.Galaxies()).select("group_name").distinct().orderBy("group_name").collect()]
    y, x = np.mgrid[0:21, 0:21].astype(float)
    rows, known = [], {}
    for n, g in enumerate(groups):
        for i, band in enumerate("grz"):
            beta, alpha = 2.2 + n % 5 / 10 + i / 10, 1.8 + n % 3 / 5
            path = tmp_path / f"{g}-{band}.fits.fz"
            if n % 6 != 1:
                path.write_bytes(I.fits_file([I.image_hdu("PSF", 7 * (1 + ((x - 10.2) ** 2 + (y - 9.7) ** 2) / alpha**2) ** -beta, (), "GZIP_1")]))
                known.setdefault(band, []).append((beta, 2 * alpha * np.sqrt(2 ** (1 / beta) - 1)))
            rows.append((g, band, str(path)))
    got = {r.band: r for r in runs.psf_run(spark, galaxies, bricks, spark.createDataFrame(rows, "group_name string, band string, file string"), str(tmp_path / "psf"), 10_000).collect()}
    for band, have in known.items():
        assert got[band].n_stamps == len(have)
        assert abs(got[band].beta_median - np.median([b for b, _ in have])) < 1e-6 and abs(got[band].fwhm_median_arcsec - np.median([w for _, w in have]) * 0.262) < 1e-6
        assert got[band].tv_moffat_median < got[band].tv_gauss_median
    text = [json.loads(line) for d, _, names in os.walk(tmp_path / "psf") for n in names if n.endswith(".json") for line in open(os.path.join(d, n))]
    assert {t["band"]: len(t["fits"]) for t in text} == {b: len(h) for b, h in known.items()}


def test_runs_by_command_line(spark, sky, tmp_path):
    galaxies, bricks, detections, paths = sky
    at = {n: str(tmp_path / n) for n in ("galaxies", "north", "south", "detections", "tiles", "out")}
    galaxies.write.parquet(at["galaxies"])
    for side in ("north", "south"):
        bricks.where(F.col("hemisphere") == side).drop("hemisphere").write.parquet(at[side])
    detections.write.parquet(at["detections"])
    paths.write.parquet(at["tiles"])
    line = [x for n, p in at.items() for x in (f"--{n}", p)]
    n = runs.main(spark, ["galaxies", *line, *ARGS])
    assert n == files.ledger(spark, f"{at['out']}/manifest").count() > 0
    assert runs.main(spark, ["galaxies", *line, *ARGS]) == 0
    # Every brick comes from one of the two tables.
    assert {r.hemisphere for r in files.ledger(spark, f"{at['out']}/manifest").select("hemisphere").distinct().collect()} <= {"north", "south"}
    with pytest.raises(SystemExit):
        runs.main(spark, ["galaxies", *line, "--no-such", "1"])


def test_sidecars_of_older_frames(spark, tmp_path):
    frames, out = tmp_path / "frames", str(tmp_path / "out")
    frames.mkdir()
    for name in ("SGA_7_RA10.5_Dec-3.25_size60.0.jpeg", "SGA_8_RA200.0_Dec40.0_size60.0.jpeg", "notes.txt"):
        (frames / name).write_text("x")
    stars = spark.createDataFrame([(1, 10.5, -3.25, 9.0), (2, 10.501, -3.251, 16.5), (3, 10.5, -3.24, 18.0), (4, 11.0, -3.25, 5.0)], "source_id long, ra double, dec double, phot_g_mean_mag double")
    stars.write.parquet(str(tmp_path / "stars"))
    line = ["sidecars", "--frames", str(frames), "--stars", str(tmp_path / "stars"), "--out", out]
    assert [tuple(r) for r in runs.main(spark, line).collect()] == [(7, 2)]
    assert spark.read.csv(out, header=True).count() == 2
    runs.main(spark, line)
    assert spark.read.csv(out, header=True).count() == 2
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    assert [tuple(r) for r in runs.main(spark, [*line, "--maglim", "10", "--overwrite"]).collect()] == [(7, 1)]
    assert spark.read.csv(out, header=True).count() == 1 and spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode
