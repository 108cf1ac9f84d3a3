"""Behaviour of single operators on small inputs."""

import hashlib
import http.server
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import companions, funnel, ledger, psf, reports, select, stamps, stars
from starloom.sources import files
from starloom.streaming import resume


def test_seeded_angles_are_those_of_numpy(spark):
    df = spark.createDataFrame([(1179597,)], "sga_id long").select(funnel.seeded_angles(8, 0.5, 20260807)("sga_id").alias("d"))
    pa = [x.pa for x in df.head().d]
    assert np.allclose(pa[:3], [283.4433747, 231.5798023, 302.51691367])


def test_first_failing_test_names_the_reason(spark):
    c = spark.createDataFrame([(1, "", True), (2, "b", False), (3, "b", True), (4, "c", True), (5, "d", True), (6, "e", True)], "id long, brick string, clear boolean")
    failed = spark.createDataFrame([("b",), ("b",)], "brick string")
    boxes = spark.createDataFrame([(4, 0.5, 3), (5, 0.9, 1), (6, 0.8, 0)], "id long, on_grid double, galaxy_pixels long")
    got = {r.id: r.reason for r in funnel.funnel(c, failed, boxes).collect()}
    assert got == {1: "footprint", 2: "sga_overlap", 3: "fetch", 4: "coverage", 5: "sga_maskbit", 6: ""}


def test_outcomes(spark):
    c = spark.createDataFrame([(1, 0, "candidate", ""), (1, 1, "candidate", ""), (1, 2, "candidate", ""), (1, 3, "rejected", "footprint")], "parent_sga_id long, k int, status string, reason string")
    done = spark.createDataFrame([(1, 0, "written", None), (1, 1, "rejected", "coverage")], "parent_sga_id long, k int, l_status string, l_reason string")
    got = {r.k: (r.status, r.reason) for r in funnel.outcome(c, done).collect()}
    assert got == {0: ("accepted", ""), 1: ("rejected", "coverage"), 2: ("rejected", "error"), 3: ("rejected", "footprint")}


@pytest.mark.parametrize(("n", "sample"), [(26, 23), (10, 10), (10, 3), (7, 1), (100, 33), (0, 5)])
def test_subsample_takes_the_ranks_of_linspace(spark, n, sample):
    df = spark.createDataFrame([(i,) for i in range(n)], "i long")
    want = np.unique(np.linspace(0, n - 1, sample).round().astype(int)).tolist() if 0 < sample < n else list(range(n))
    assert sorted(r.i for r in select.subsample(df, ["i"], sample).collect()) == want


def test_companion_edge_cases(spark):
    s = spark.createDataFrame([(1, 1, 10.0, 0.0, 60.0, 10.0), (2, 2, 10.0, 0.0, 60.0, 10.0), (3, 3, 359.999, 0.0, 60.0, 10.0), (4, 4, 1.0, 0.0, 60.0, 10.0)], "sga_id long, grp long, ra double, dec double, half double, r26 double")
    step = 10 / 3600
    t = [(1, 10.0, 0.0, "SER", "L3", 1, 100.0, 0), (1, 10.0, step, "REX ", "", -1, 50.0, 2), (1, 10.0, -step, "EXP", "", -1, 50.0, 1), (1, 10.0, step, "PSF", "", -1, 500.0, 3),
         (2, 10.0, 0.0, "SER", "L3", 2, 0.0, 0), (3, 359.999, 0.0, "SER", "L3", 3, 10.0, 0), (3, 0.001, 0.0, "DEV", "", -1, 5.0, 1)]
    tractor = spark.createDataFrame(t, "grp long, ra double, dec double, type string, ref_cat string, ref_id long, flux_r double, row_no long")
    got = {r.sga_id: (r.companion_ratio, r.companion_sep_r26) for r in companions.companion_ratio(s, tractor).collect()}
    assert got[1] == (0.5, pytest.approx(1.0)) and got[3] == (0.5, pytest.approx(0.72))
    assert np.isnan(got[2]).all() and np.isnan(got[4]).all()


def test_cutout_fills_beyond_the_plane(spark):
    p = spark.createDataFrame([(1, 3, 3, *[[1.0] * 9] * 3, *[[2.0] * 9] * 3, [0] * 9)], "id long, width int, height int, sci_g array<double>, sci_r array<double>, sci_z array<double>, ivar_g array<double>, ivar_r array<double>, ivar_z array<double>, mask array<int>")
    c = spark.createDataFrame([(1, 0.0, 2.0)], "id long, cx double, cy double")
    r = stamps.cutouts(p, c, "id", 2).head()
    assert r.sci_r == [0.0, 1.0, 0.0, 1.0] and r["mask"] == [1, 0, 1, 0] and r.ivar_z == [0.0, 2.0, 0.0, 2.0]


def test_moffat_fit_finds_the_profile(spark):
    y, x = np.mgrid[0:15, 0:15].astype(float)
    z = 0.04 * (1 + ((x - 7.3) ** 2 + (y - 6.8) ** 2) / 2.2**2) ** -3.1
    rows = [(1, int(b), int(a), float(v)) for b, a, v in zip(y.ravel(), x.ravel(), z.ravel(), strict=True)] + [(2, 0, 0, -1.0), (2, 0, 1, 0.0)]
    got = psf.fit_moffat(spark.createDataFrame(rows, "s long, y int, x int, value double"), ["s"]).collect()
    assert len(got) == 1
    assert np.allclose([got[0].x0, got[0].y0, got[0].alpha, got[0].beta], [7.3, 6.8, 2.2, 3.1], rtol=1e-3)


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([("a", v) for v in (0.0, 0.05, 0.5, 1.0, 1.01, float("nan"))], "g string, v double")
    got = {r.bin: r.n for r in reports.histogram(df, "g", F.col("v"), 0.0, 1.0, 10).collect()}
    assert got == {0: 2, 5: 1, 9: 1}


def test_checksums_and_names_parse(spark):
    d = "a" * 64
    lines = spark.createDataFrame([(f"{d}  *x.fits",), (f"{d} y.fits",), ("short z.fits",), (f"{d} a b",), ("",), (None,)], "line string")
    assert {r.name for r in ledger.parse_checksums(lines).collect()} == {"x.fits", "y.fits"}
    names = spark.createDataFrame([("sga_12_RA1.5_Dec-2.25_size30.jpeg", 1), ("sga_x_RA1_Dec2.jpeg", 2), ("odd", 3)], "name string, length long")
    got = {r.name: (r.sga_id, r.ra, r.dec, r.size_arcsec) for r in stars.parse_listing(names).collect()}
    assert got == {"sga_12_RA1.5_Dec-2.25_size30.jpeg": (12, 1.5, -2.25, 30.0), "sga_x_RA1_Dec2.jpeg": (None, None, None, None), "odd": (None, None, None, None)}


def test_a_second_run_adds_nothing(spark, tmp_path):
    targets = spark.createDataFrame([(f"sga_{i}.fits",) for i in range(5)], "file string")
    path = str(tmp_path / "ledger")
    for expected in (5, 0):
        old = spark.read.csv(path, header=True) if expected == 0 else targets.limit(0)
        new = ledger.resume(targets, old)
        assert new.count() == expected
        if expected:
            files.append_ledger(new.withColumn("status", F.lit("written")), path)


def test_spec_gate(spark, tmp_path):
    path = str(tmp_path / "run.json")
    ledger.spec_gate(spark, path, {"zcut": 0.05, "bands": ["g"]})
    ledger.spec_gate(spark, path, {"bands": ["g"], "zcut": 0.05})
    with pytest.raises(ValueError, match="other parameters"):
        ledger.spec_gate(spark, path, {"zcut": 0.1})


def test_stream_processes_each_candidate_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "ledger", "ck"))
    for names in (["a", "b", "b"], ["b", "c"]):
        spark.createDataFrame([(n,) for n in names], "file string").coalesce(1).write.mode("append").parquet(src)
        q = resume.follow(resume.arrivals(spark, src, "file string"), lambda df: df.withColumn("status", F.lit("written")), out, ck)
        q.awaitTermination()
    assert sorted(r.file for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_fits_tables_are_read(spark, tmp_path):
    cols = [("SGA_ID", "K", ">i8"), ("RA", "D", ">f8"), ("TYPE", "4A", "S4"), ("E", "2E", (">f4", 2))]
    rows = np.zeros(3, [(n, t) if not isinstance(t, tuple) else (n, t[0], t[1]) for n, _, t in cols])
    rows["SGA_ID"], rows["RA"], rows["TYPE"], rows["E"] = [1, 2, 3], [0.5, 1.5, 2.5], [b"PSF", b"REX ", b"SER"], [[1, 2], [3, 4], [5, 6]]

    def head(cards):
        text = "".join(f"{k:<8}= {v}".ljust(80) for k, v in cards) + "END".ljust(80)
        return text.ljust(-(-len(text) // 2880) * 2880).encode()

    table = [("XTENSION", "'BINTABLE'"), ("BITPIX", "8"), ("NAXIS", "2"), ("NAXIS1", str(rows.dtype.itemsize)), ("NAXIS2", "3"), ("PCOUNT", "0"), ("GCOUNT", "1"), ("TFIELDS", "4")]
    for k, (n, code, _) in enumerate(cols, 1):
        table += [(f"TTYPE{k}", f"'{n}'"), (f"TFORM{k}", f"'{code}'")]
    body = rows.tobytes()
    path = tmp_path / "t.fits"
    path.write_bytes(head([("SIMPLE", "T"), ("BITPIX", "8"), ("NAXIS", "0")]) + head(table) + body.ljust(-(-len(body) // 2880) * 2880, b"\0"))
    from starloom.sources.fits import FitsTable

    spark.dataSource.register(FitsTable)
    got = spark.read.format("fits-table").load(str(path)).collect()
    assert [(r.SGA_ID, r.RA, r.TYPE, r.E) for r in got] == [(1, 0.5, "PSF", [1.0, 2.0]), (2, 1.5, "REX", [3.0, 4.0]), (3, 2.5, "SER", [5.0, 6.0])]


def test_fetch_goes_on_validates_and_gives_up(spark, tmp_path):
    body = b"SIMPLE  =" + b"x" * 5000
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            at = int((self.headers.get("Range") or "bytes=0-")[6:-1])
            asked.append((self.path, at))
            data = b"<html>" if self.path == "/bad" else body[at:]
            self.send_response(206 if at else 200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    (tmp_path / "half.part").write_bytes(body[:100])
    waits = []
    assert files.fetch_one(f"{at}/half", str(tmp_path / "half"), hashlib.sha256(body).hexdigest(), pause=waits.append) == (len(body) - 100, None)
    assert files.fetch_one(f"{at}/half", str(tmp_path / "half")) == (0, None)
    assert files.fetch_one(f"{at}/bad", str(tmp_path / "bad"), retries=3, pause=waits.append) == (0, "content")
    assert asked[0] == ("/half", 100) and waits == [2, 4] and not (tmp_path / "bad").exists()
    server.shutdown()


def test_seeded_candidates_and_sinks(spark, tmp_path):
    from starloom.plans import catalogue, runs

    sf = "/root/testdata/sf0.001"
    c = runs.propose(catalogue.v(spark, sf, "galaxies"), catalogue.v(spark, sf, "bricks"), runs.arguments(runs.Backgrounds, ["--n-candidates", "3", "--limit", "20"]))
    assert c.count() == 60 and {r.k for r in c.collect()} == {0, 1, 2}
    assert {r.reason for r in c.collect()} <= {"", "footprint", "sga_overlap"}
    files.write_candidates(c, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 60
    fits = spark.createDataFrame([("g", 2.0, 3.0, 0.1, 0.2), ("g", 3.0, 4.0, 0.1, 0.2), ("r", 2.5, 3.0, 0.1, 0.2)], "band string, beta double, fwhm_px double, tv_moffat double, tv_gauss double")
    files.write_calibration(psf.summary(fits), fits, str(tmp_path / "psf"))
    assert {r.band: len(r.fits) for r in spark.read.json(str(tmp_path / "psf")).collect()} == {"g": 2, "r": 1}
    stars_ = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "sga_id long, s string, m double")
    files.write_sidecars(stars_.limit(1), str(tmp_path / "side"))
    files.write_sidecars(stars_, str(tmp_path / "side"))
    assert spark.read.csv(str(tmp_path / "side"), header=True).count() == 2
    assert {r.name[-4:] for r in files.listing(spark, str(tmp_path / "c" / "*.csv")).collect()} == {".csv"}


def test_a_truncated_fits_file_is_not_whole(tmp_path):
    import gzip

    cards = lambda *c: "".join(x.ljust(80) for x in (*c, "END")).ljust(2880).encode()
    good = cards("SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0") + cards(
        "XTENSION= 'BINTABLE'", "BITPIX  =                    8", "NAXIS   =                    2", "NAXIS1  =                  100", "NAXIS2  =                   50", "PCOUNT  =                    0", "GCOUNT  =                    1", "TFIELDS =                    1", "TFORM1  = '100A'"
    ) + b"a" * 5000 + b"\0" * 760
    packed = gzip.compress(good)
    whole = {"good": good, "no-end.fits": good[:2000], "header": good[:4000], "data": good[:8000], "padding": good[:-1], "packed": packed, "packed-cut": packed[:-20], "page": b"<html>", "empty": b""}
    for name, content in whole.items():
        (tmp_path / name).write_bytes(content)
    assert [n for n in whole if files.looks_whole(str(tmp_path / n))] == ["good", "packed"]


def test_samples_read_back_by_brick(spark, tmp_path):
    from starloom.sources import files

    rows = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("b", 2, [3.0]), ("a", 3, [])], "brick string, sga_id long, sci array<double>")
    files.write_samples(rows, str(tmp_path / "s"))
    assert {(r.brick, r.sga_id, tuple(r.sci)) for r in files.read_samples(spark, str(tmp_path / "s")).collect()} == {("a", 1, (1.0, 2.0)), ("b", 2, (3.0,)), ("a", 3, ())}
    assert {r.sga_id for r in files.read_samples(spark, str(tmp_path / "s"), ["a"]).collect()} == {1, 3}


def test_angles_are_cleaned_as_numpy_does(spark):
    import sys

    from starloom.operators import catalog

    rows = spark.createDataFrame([(1, 1.0, 1.0, 0.5, p) for p in (3.0, float("nan"), float("inf"), float("-inf"), None)], "sga_id long, sma_sb26 double, d26 double, ba double, pa double")
    assert [r.pa for r in catalog.with_geometry(rows).collect()] == [3.0, 0.0, sys.float_info.max, -sys.float_info.max, 0.0]


def test_the_archives_names_are_parameters(spark):
    from starloom.operators import ledger

    bricks = spark.createDataFrame([("1234p567", "north")], "brick string, hemisphere string")
    urls = {r.url for r in ledger.brick_files(bricks, "https://a.example", "other").collect()}
    assert len(urls) == 11 and "https://a.example/north/coadd/123/1234p567/other-1234p567-maskbits.fits.fz" in urls
    assert ledger.checksum_files(bricks, "https://a.example", "other", "r1").head().url == "https://a.example/north/coadd/123/1234p567/other_r1_north_coadd_123_1234p567.sha256sum"


def test_mask_boxes_match_a_count_over_whole_planes(spark):
    width, scale, rng = 150, 0.262, np.random.default_rng(3)
    mask = {s: np.where(rng.random((width, width)) < 0.01, 4096 + rng.integers(0, 8), rng.integers(0, 8, (width, width))) for s in "ab"}
    tiles = spark.createDataFrame([("a", 10.0, 0.0, width, width, mask["a"].ravel().tolist()), ("b", 20.0, 0.0, width, width, mask["b"].ravel().tolist())], "brick string, tra double, tdec double, width int, height int, mask array<int>")
    px = [(i, b, ra0, x, y) for i, (b, ra0, x, y) in enumerate([("a", 10.0, 64.3, 63.7), ("a", 10.0, 2.2, 148.0), ("a", 10.0, 500.0, 60.0), ("b", 20.0, 75.1, 75.2), ("b", 20.0, 128.0, 64.0), ("c", 30.0, 70.0, 70.0)])]
    step = scale / 3600.0
    c = spark.createDataFrame([(i, b, ra0 - (x - (width - 1) / 2) * step, (y - (width - 1) / 2) * step) for i, b, ra0, x, y in px], "id long, brick string, ra double, dec double")
    got = {r.id: r for r in stamps.mask_boxes(c, tiles, F.lit(70), scale).collect()}
    assert set(got) == {0, 1, 2, 3, 4}  # none without a tile
    for i, b, _, x, y in px[:5]:
        x0, x1, y0, y1 = (min(max(int(v), 0), width) for v in (x - 35, x + 35, y - 35, y + 35))
        assert got[i].galaxy_pixels == int((mask[b][y0:y1, x0:x1] & 4096 > 0).sum())
        assert got[i].on_grid == pytest.approx((x1 - x0) * (y1 - y0) / 4900)


def test_stamps_become_unit_sums_and_distances_without_a_shuffle(spark):
    rows = [(1, 2, 2, [1.0, 2.0, 3.0, 2.0]), (2, 2, 2, [None, 4.0, 4.0, None]), (3, 2, 2, [None] * 4), (4, 3, 1, [0.0, 5.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, width int, height int, value array<double>").coalesce(1)
    unit = psf.normalise(df, ["id", "width", "height"])
    kernel = psf.on_grid(lambda x, y: x + y * 2 + 1.0)  # 1, 2, 3, 4 of a square, 1, 2, 3 of a row
    far = psf.total_variation(unit, ["id"], kernel)
    assert "Exchange" not in far._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.value for r in unit.collect()}
    assert got == {1: [0.125, 0.25, 0.375, 0.25], 2: [None, 0.5, 0.5, None], 3: [None] * 4, 4: [0.0, 1.0, 0.0]}
    want = {1: 0.5 * (0.025 + 0.05 + 0.075 + 0.15), 2: 0.5 * (0.3 + 0.2), 3: None, 4: 0.5 * (1 / 6 + 4 / 6 + 3 / 6)}
    assert {r.id: r.total_variation for r in far.collect()} == {k: x if x is None else pytest.approx(x) for k, x in want.items()}


def test_pixels_are_not_grouped_for_the_fits_of_a_query(spark):
    from starloom.plans import catalogue

    for name, most in (("total_variation", 0), ("psf_normalise", 0), ("moffat_kernel", 0), ("psf_fit", 1)):
        plan = catalogue.REGISTRY[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") <= most and "Aggregate" not in plan and "Join" not in plan, name
