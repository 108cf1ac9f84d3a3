"""FITS images: codes, tiles, headers, the data sources and tiles that are opened once."""

import io
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starloom.operators import stamps, tiles
from starloom.sources import images as I


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 80), st.sampled_from(["u1", "i2", "i4"]), st.sampled_from([1, 3, 1000, 2**40]), st.integers(0, 2**32))
def test_rice_codes_come_back(n, m, kind, spread, seed):
    rng = np.random.default_rng(seed)
    lim = np.iinfo(kind)
    v = np.clip(rng.integers(-spread, spread, (n, m), endpoint=True) * (rng.random((n, m)) < 0.5), lim.min, lim.max).astype(kind)
    assert (I.rice_decode(I.rice_encode(v), m, v.dtype.itemsize) == v).all()


def test_a_code_written_by_hand():
    # First value 5 in 16 bits; block code 1 (no low bits): differences 0, 1, -1, 2 as 0, 2, 1, 4 zeros and a one; then an all-zero block.
    bits = f"{5:016b}" + "0001" + "1" + "001" + "01" + "00001"
    code = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert I.rice_decode([code], 4, 2).tolist() == [[5, 6, 5, 7]]
    assert I.rice_decode([(bits + "0000").ljust(48, "0") and int((bits + "0000").ljust(40, "0"), 2).to_bytes(5, "big")], 4, 2, block=4).tolist() == [[5, 6, 5, 7]]


def test_the_dither_is_the_standards():
    r = I._randoms()
    assert r[9999] * 2147483647 == 1043618065
    row = r[2]
    assert np.allclose(I.dither(2, 5, 1), r[int(row * 500) : int(row * 500) + 5])
    assert len(I.dither(7, 30_000, 3)) == 30_000


@pytest.mark.parametrize("packed", [None, "RICE_1", "GZIP_1"])
def test_rows_of_planes(packed):
    rng = np.random.default_rng(5)
    m, f = rng.integers(0, 8192, (40, 33)).astype("i2"), rng.normal(size=(40, 33)).astype("f4")
    raw = io.BytesIO(I.fits_file([I.image_hdu("mask", m, [("CRVAL1", 12.5)], packed), I.image_hdu("sci", f, (), packed)], [("NOTE", "it's")]))
    a, b = I.planes(raw)
    assert (a.name, a.width, a.height, a.header["CRVAL1"]) == ("mask", 33, 40, "12.5")
    for lo, hi in ((0, 40), (3, 4), (39, 99), (7, 7), (10, 30)):
        assert (I.rows(raw, a, lo, hi) == m[lo:hi]).all() and (I.rows(raw, b, lo, hi) == f[lo:hi]).all()


def test_only_the_tiles_of_the_rows_are_read():
    m = np.arange(400 * 50).reshape(400, 50).astype("i4")
    raw = I.fits_file([I.image_hdu("mask", m, packed="RICE_1")])

    class Counted(io.BytesIO):
        n = 0

        def read(self, k=-1):
            got = super().read(k)
            Counted.n += len(got)
            return got

    f = Counted(raw)
    p = I.planes(f)[0]
    Counted.n = 0
    assert (I.rows(f, p, 100, 104) == m[100:104]).all()
    assert Counted.n < len(raw) / 20


def test_quantised_floats():
    # A table by hand: two tiles of three pixels, quantised with scale and zero columns, one pixel null, one an exact zero.
    q = np.array([[10, I.NULL, I.ZERO], [7, 8, 9]], np.int32)
    code = I.rice_encode(q)
    for rule in ("NO_DITHER", "SUBTRACTIVE_DITHER_2"):
        table = np.zeros(2, [("c", ">i8", 2), ("s", ">f8"), ("z", ">f8")])
        at = 0
        for k, c in enumerate(code):
            table[k] = ((len(c), at), 0.5, 100.0)
            at += len(c)
        heap = b"".join(code)
        head = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 32), ("NAXIS2", 2), ("PCOUNT", len(heap)), ("GCOUNT", 1), ("TFIELDS", 3), ("TTYPE1", "COMPRESSED_DATA"), ("TFORM1", "1QB"), ("TTYPE2", "ZSCALE"), ("TFORM2", "1D"), ("TTYPE3", "ZZERO"), ("TFORM3", "1D"),
                ("ZIMAGE", True), ("ZCMPTYPE", "RICE_1"), ("ZBITPIX", -32), ("ZNAXIS", 2), ("ZNAXIS1", 3), ("ZNAXIS2", 2), ("ZTILE1", 3), ("ZTILE2", 1), ("ZNAME1", "BLOCKSIZE"), ("ZVAL1", 32), ("ZNAME2", "BYTEPIX"), ("ZVAL2", 4), ("ZQUANTIZ", rule), ("ZDITHER0", 5), ("ZBLANK", I.NULL)]
        f = io.BytesIO(I.fits_file([I._head(head) + I._block(table.tobytes() + heap)]))
        got = I.rows(f, I.planes(f)[0])
        less = np.stack([I.dither(k, 3, 5) - 0.5 for k in range(2)]) if rule != "NO_DITHER" else np.zeros((2, 3))
        want = (q - less) * 0.5 + 100
        want[0, 1] = np.nan
        if rule != "NO_DITHER":
            want[0, 2] = 0.0
        assert np.allclose(got, want.astype(np.float32), equal_nan=True)


def test_filters_reach_the_source(spark, tmp_path):
    m = np.arange(60 * 20).reshape(60, 20).astype("i2")
    for n in "ab":
        (tmp_path / f"{n}.fits.fz").write_bytes(I.fits_file([I.image_hdu("mask", m, packed="RICE_1"), I.image_hdu("sci", m.astype("f4"), packed="GZIP_1")]))
    assert I.images(spark, str(tmp_path)).count() == 240
    got = I.images(spark, str(tmp_path), ("mask",), 10, 13).orderBy("file", "y").collect()
    assert [(os.path.basename(r.file), r.y) for r in got] == [(f"{n}.fits.fz", y) for n in "ab" for y in (10, 11, 12)] and got[0]["values"] == m[10].tolist()
    assert I.images(spark, str(tmp_path / "a.fits.fz"), ("none",)).count() == 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        one = str(tmp_path / "b.fits.fz")
        df = I.images(spark, str(tmp_path)).where((F.col("plane") == "mask") & (F.col("y") >= 20) & (F.col("y") < 22) & (F.col("file") == one))
        assert [(r.file, r.y, r["values"]) for r in df.orderBy("y").collect()] == [(one, y, m[y].tolist()) for y in (20, 21)]
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "= mask" not in plan and ">= 20" not in plan  # the source has taken them
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = I.PushedImageReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([I.EqualTo(("file",), one), I.In(("plane",), ["mask"]), I.GreaterThan(("y",), 57)])) == []
    parts = reader.partitions()
    assert [s[0] for p in parts for s in p.shares] == [one] and [r[2] for p in parts for r in reader.read(p)] == [58, 59]


def test_large_files_are_shared_out(tmp_path, monkeypatch):
    monkeypatch.setattr(I, "SHARE", 1000)
    m = np.arange(70 * 20).reshape(70, 20).astype("i4")
    (tmp_path / "a.fits").write_bytes(I.fits_file([I.image_hdu("mask", m)]))
    reader = I.ImageReader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) > 4
    rows = [r for p in parts for r in reader.read(p)]
    assert [r[2] for r in rows] == list(range(70)) and [r[4] for r in rows] == m.tolist()


PLANE_ROWS = I.FitsPlanes({}).schema()


def test_files_appear_whole_or_not_at_all(spark, tmp_path):
    rows = [(f"x/s{i}.fits", [("SCI", "f4", 2, 3, [float(i)] * 12), ("LAYERS", "u1", 2, 1, [1.0, 2.0, 4.0, 8.0])], {"RA0": "1.5", "BRICK": "b"}) for i in range(6)]
    out = str(tmp_path / "out")
    I.register(spark)

    def put(df):
        df.write.format("fits-planes").mode("append").option("path", out).option("primary", "true").save()

    broken = [*rows[:5], ("x/bad.fits", [("SCI", "no-kind", 2, 1, [0.0])], None)]
    with pytest.raises(Exception, match="no-kind|data type"):
        put(spark.createDataFrame(broken, PLANE_ROWS).repartition(3))
    assert not any(n.endswith(".fits") for _, _, names in os.walk(out) for n in names)
    for _ in range(2):  # and again: the same files
        put(spark.createDataFrame(rows, PLANE_ROWS).repartition(2))
    assert sorted(os.listdir(f"{out}/x")) == [f"s{i}.fits" for i in range(6)] and os.listdir(out) == ["x"]
    got = {(os.path.basename(r.file), r.plane, r.y): r["values"] for r in I.images(spark, out).collect()}
    assert len(got) == 6 * 8 and got["s3.fits", "SCI:2", 1] == [3.0, 3.0] and got["s3.fits", "LAYERS", 1] == [4.0, 8.0]
    with open(f"{out}/x/s0.fits", "rb") as f:
        assert I.planes(f)[0].header["RA0"] == "1.5"


def test_a_tile_is_opened_once_for_all_of_its_samples(spark, tmp_path):
    rng, h, w = np.random.default_rng(2), 50, 40
    data = {f"{k}_{b}": rng.normal(size=(h, w)) for k in ("sci", "ivar", "psf") for b in "grz"} | {"mask": rng.integers(0, 8192, (h, w)).astype("i2")}
    paths = []
    for brick in ("p", "q"):
        for name, v in data.items():
            path = tmp_path / f"{brick}-{name}.fits.fz"
            path.write_bytes(I.fits_file([I.image_hdu(name, v, packed="RICE_1" if name == "mask" else "GZIP_1")]))
            paths.append((brick, name, str(path)))
    paths.append(("gone", "mask", str(tmp_path / "none.fits.fz")))
    files = tiles.tile_files(spark, spark.createDataFrame(paths, "brick string, plane string, file string"))
    places = [(i, "pq"[i % 2], float(x), float(y), 4 + i % 5) for i, (x, y) in enumerate([(0, 0), (39, 49), (20.5, 25.2), (-3, 10), (60, 70), (12, 47.5), (5, 5), (38.2, 1.1)])] + [(99, "gone", 1.0, 1.0, 4)]
    samples = spark.createDataFrame(places, "id long, brick string, cx double, cy double, size_px int")
    got = {r.id: r for r in tiles.cut_samples(samples, files).collect()}
    assert set(got) == set(range(8)) and sum(r.opened for r in got.values()) <= 2 * (len(data) + 3)
    inner = tiles.cut_samples(samples.where("cx between 0 and 39 and cy between 0 and 49"), files).collect()
    assert sum(r.opened for r in inner) == 2 * len(data)
    for i, _, x, y, size in places[:8]:
        assert np.array_equal(np.array(got[i].sci_z), stamps.cut(data["sci_z"], x, y, size, 0.0).ravel())
        assert got[i]["mask"] == stamps.cut(data["mask"], x, y, size, 1).ravel().tolist()
        assert got[i].psf_r == stamps.seeing(data["psf_r"], x, y, size)
    boxes = {r.id: r for r in tiles.prescreened(samples, files).collect()}
    for i, _, x, y, size in places[:8]:
        x0, x1, y0, y1 = (min(max(int(v), 0), n) for v, n in ((x - size / 2, w), (x + size / 2, w), (y - size / 2, h), (y + size / 2, h)))
        assert boxes[i].galaxy_pixels == int((data["mask"][y0:y1, x0:x1] & 4096 > 0).sum()) and boxes[i].on_grid == (x1 - x0) * (y1 - y0) / size**2
    assert tiles.cut_samples(samples.limit(0), files).collect() == []


def test_scan_lines_paint_what_every_pixel_says():
    rng = np.random.default_rng(4)
    n, w, h = 300, 31, 23
    x0, y0 = rng.uniform(-8, w + 8, n), rng.uniform(-8, h + 8, n)
    radius, ratio, angle = rng.uniform(0.2, 9, n), rng.uniform(0.1, 1, n), rng.uniform(-180, 180, n)
    j = [rng.normal(size=n) + s for s in (-1.5, 0, 0, 1.5)]
    reach = np.full(n, 12)
    e, y, lo, hi = stamps.scan_lines(x0, y0, radius, ratio, angle, reach, j, np.full(n, w), np.full(n, h))
    yy, xx = np.mgrid[0:h, 0:w]
    for k in range(n):
        got = np.zeros((h, w), bool)
        for row, a, b in zip(y[e == k], lo[e == k], hi[e == k], strict=True):
            got[row, a : b + 1] = True
        box = (np.abs(xx - x0[k]) <= 12.999) & (np.abs(yy - y0[k]) <= 12.999)
        box = (xx >= np.floor(x0[k]) - 12) & (xx <= np.ceil(x0[k]) + 12) & (yy >= np.floor(y0[k]) - 12) & (yy <= np.ceil(y0[k]) + 12)
        want = stamps._inside(xx - x0[k], yy - y0[k], [v[k] for v in j], radius[k], ratio[k], np.radians(angle[k])) & box
        assert (got == want).all()


def test_the_sink_makes_no_objects_of_a_batchs_pixels(tmp_path, spark):
    import tracemalloc

    import pyarrow as pa

    from starloom.sources import images

    plane = {"name": "A", "kind": "f8", "width": 64, "depth": 1}
    rows = [{"file": f"{i}.fits", "planes": [plane | {"pixels": [float(i)] * 4096}], "cards": [("K", str(i))]} for i in range(200)]
    kinds = pa.schema([("file", pa.string()), ("planes", pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("width", pa.int32()), ("depth", pa.int32()), ("pixels", pa.list_(pa.float64()))]))), ("cards", pa.map_(pa.string(), pa.string()))])
    batch = pa.RecordBatch.from_pylist(rows, kinds).slice(1)
    writer = images.PlanesWriter({"path": str(tmp_path)}, False)
    tracemalloc.start()
    done = writer.write(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < batch.nbytes / 4  # lists of a batch's numbers take several times its bytes
    writer.commit([done])
    with images.opened(str(tmp_path / "7.fits")) as f:
        p = images.planes(f)[-1]
        assert p.name == "A" and (images.rows(f, p) == 7.0).all()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    images.save(spark.createDataFrame([(r["file"], [tuple(r["planes"][0].values())], dict(r["cards"])) for r in rows[:40]], images.FitsPlanes({}).schema()).coalesce(1), str(tmp_path / "saved"))
    assert len(list((tmp_path / "saved").iterdir())) == 40 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    wrong = pa.RecordBatch.from_pylist([{"file": "x", "planes": [plane | {"kind": "i2", "pixels": [None] * 64}], "cards": []}], kinds)
    with pytest.raises(ValueError, match="null pixels"):
        writer.write(iter([wrong]))
