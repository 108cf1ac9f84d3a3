"""Stamps as rows of array planes: ellipses painted by scan lines, layers packed, verdicts, cutouts, seeing, boxes.

A plane is an array of its pixels, row by row.  Ellipses reach their stamp as one list, by one shuffle on the stamp; from
there an Arrow pass paints a batch of stamps at a time: every ellipse gives an interval of x for each row that it meets,
intervals are added up as steps at their ends, and what is above zero is painted.  No row is made for a pixel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.projection import Frame, frame, north_up, pixel, with_jacobian
from ..sources.shared import dealt
from .layers import BANDS, BRIGHT, BRIGHT_BITS, GALAXY, GALAXY_BIT, INVALID, SOURCE

#: Pixels that are painted at a time.
AT_ONCE = 1 << 22
#: What a cutout has beyond its tile.
FILL = {"sci": 0.0, "ivar": 0.0, "mask": 1}
ELLIPSES = "array<struct<bit:int,x0:double,y0:double,radius:double,axis_ratio:double,angle:double,reach:int>>"


def ellipses_of(frames: DataFrame, shapes: DataFrame, key: str) -> DataFrame:
    """(key, ellipses): the shapes (key, bit, ra, dec, radius, axis_ratio, angle) that may reach their frame, in its pixels.

    frames have key, the columns of a projection, width, height and scale (arcseconds of a pixel, for the margin).
    """
    rows = shapes.join(frames.select(key, "width", "height", "scale", *Frame._fields), key)
    x, y = pixel(frame(), F.col("ra"), F.col("dec"))
    rows = rows.select(key, "bit", "radius", "axis_ratio", "angle", "width", "height", x.alias("x0"), y.alias("y0"), (F.col("radius") / F.col("scale")).alias("margin"))
    near = [(F.col(c) > -F.col("margin")) & (F.col(c) < F.col("margin") + F.col(side)) for c, side in (("x0", "width"), ("y0", "height"))]
    reach = (F.ceil("margin") + 1).cast("int").alias("reach")
    one = F.struct(F.col("bit").cast("int").alias("bit"), "x0", "y0", "radius", "axis_ratio", "angle", reach)
    return rows.where(near[0] & near[1]).groupBy(key).agg(F.collect_list(one).alias("ellipses"))


def _inside(dx, dy, j, radius, ratio, angle):
    """Whether pixel offsets are within ellipses, by their elliptical radius on the sky."""
    east, north = j[0] * dx + j[1] * dy, j[2] * dx + j[3] * dy
    s, c = np.sin(angle), np.cos(angle)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.hypot(east * s + north * c, (north * s - east * c) / ratio) <= radius


def scan_lines(x0, y0, radius, ratio, angle, reach, j, width, height):
    """(ellipse, y, first x, last x) of each row that an ellipse meets: j has four slopes for each ellipse, angles are in degrees.

    The ends solve a quadratic in x and are then settled by the elliptical radius itself.
    """
    angle = np.radians(angle)
    low = np.maximum(np.floor(y0).astype(np.int64) - reach, 0)
    n = np.maximum(np.minimum(np.ceil(y0).astype(np.int64) + reach, height - 1) - low + 1, 0)
    e = np.repeat(np.arange(len(x0)), n)
    y = low[e] + np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n)
    s, c = np.sin(angle), np.cos(angle)
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = (j[0] * s + j[2] * c, j[1] * s + j[3] * c), ((j[2] * s - j[0] * c) / ratio, (j[3] * s - j[1] * c) / ratio)
        a, b, d = p[0] ** 2 + q[0] ** 2, p[0] * p[1] + q[0] * q[1], p[1] ** 2 + q[1] ** 2
        dy = y - y0[e]
        root = np.sqrt(np.maximum((b[e] * dy) ** 2 - a[e] * (d[e] * dy * dy - radius[e] ** 2), 0.0))
        lo, hi = x0[e] + (-b[e] * dy - root) / a[e], x0[e] + (-b[e] * dy + root) / a[e]
    known = np.isfinite(lo) & np.isfinite(hi)
    e, y, dy, lo, hi = e[known], y[known], dy[known], lo[known], hi[known]
    bound = [np.floor(x0[e]).astype(np.int64) - reach[e], np.ceil(x0[e]).astype(np.int64) + reach[e]]
    lo, hi = np.clip(np.ceil(lo), -1e9, 1e9).astype(np.int64), np.clip(np.floor(hi), -1e9, 1e9).astype(np.int64)
    own = [v[e] for v in j]

    def good(x):
        return _inside(x - x0[e], dy, own, radius[e], ratio[e], angle[e])

    lo = np.where(good(lo - 1), lo - 1, np.where(good(lo), lo, lo + 1))
    hi = np.where(good(hi + 1), hi + 1, np.where(good(hi), hi, hi - 1))
    lo, hi = np.maximum(lo, np.maximum(bound[0], 0)), np.minimum(hi, np.minimum(bound[1], width[e] - 1))
    some = lo <= hi
    return e[some], y[some], lo[some], hi[some]


def _flat(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _painted(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(layers of all pixels in a row, pixels of each stamp, whether each pixel has the galaxy bit) of stamps."""
    width, height = b.column("width").to_numpy().astype(np.int64), b.column("height").to_numpy().astype(np.int64)
    size = width * height
    mask = _flat(b.column("mask"))
    layers = np.zeros(int(size.sum()), np.uint8)
    covered = np.ones(len(layers), bool)
    for band in BANDS:
        covered &= _flat(b.column(f"ivar_{band}")) > 0
    layers[~covered] |= INVALID
    layers[(mask & BRIGHT_BITS) != 0] |= BRIGHT
    lists = b.column("ellipses").fill_null([])
    flat = lists.flatten()
    stamp = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(lists.offsets)))
    field = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
    j = [b.column(c).to_numpy(zero_copy_only=False)[stamp] for c in ("je_x", "je_y", "jn_x", "jn_y")]
    e, y, lo, hi = scan_lines(field["x0"], field["y0"], field["radius"], field["axis_ratio"], field["angle"], field["reach"].astype(np.int64), j, width[stamp], height[stamp])
    row = (np.cumsum(height) - height)[stamp[e]] + y  # of all stamps' rows, each with one place more than pixels
    wide = np.repeat(width, height)
    first = np.cumsum(wide + 1) - (wide + 1)
    inner = np.ones(int((wide + 1).sum()), bool)
    inner[first + wide] = False
    for bit in (SOURCE, GALAXY):
        own = field["bit"][e] == bit
        if own.any():
            steps = np.bincount(first[row[own]] + lo[own], minlength=len(inner)) - np.bincount(first[row[own]] + hi[own] + 1, minlength=len(inner))
            layers[(np.cumsum(steps) > 0)[inner]] |= bit
    return layers, size, (mask & GALAXY_BIT) != 0


def layered(stamps: DataFrame, ellipses: DataFrame, key: str, keep: tuple = ()) -> DataFrame:
    """(key, layers, counts, n_galaxy_bit, and what keep names) of stamps: 1 invalid, 2 bright, 4 source, 8 galaxy.

    stamps have key, width, height, mask, ivar_g, ivar_r, ivar_z and the slopes je_x, je_y, jn_x, jn_y; counts has the
    number of pixels of each of the 16 values.  Both sides are shuffled by key, once.
    """
    needs = [key, "width", "height", "mask", *[f"ivar_{b}" for b in BANDS], "je_x", "je_y", "jn_x", "jn_y", *[c for c in keep if c != key]]
    return _layered(stamps.select(*dict.fromkeys(needs)).join(ellipses, key, "left"), key, keep)


def _layered(rows: DataFrame, key: str, keep: tuple = ()) -> DataFrame:
    """layered of stamps that have their ellipses already, without a shuffle."""
    out = [key, *[c for c in keep if c != key]]

    def work(batches):
        for batch in batches:
            size = (batch.column("width").to_numpy().astype(np.int64) * batch.column("height").to_numpy()).cumsum()
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + AT_ONCE, "right")))
                b = batch.slice(at, to - at)
                layers, n, bit = _painted(b)
                ends = np.concatenate([[0], np.cumsum(n)])
                stamp = np.repeat(np.arange(len(n)), n)
                counts = np.bincount(stamp * 16 + layers, minlength=16 * len(n))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(layers.astype(np.int8)))
                sixteen = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * 16), pa.array(counts.astype(np.int64)))
                bits = pa.array(np.bincount(stamp[bit], minlength=len(n)).astype(np.int64))
                yield pa.record_batch([*(b.column(c) for c in out), lists, sixteen, bits], names=[*out, "layers", "counts", "n_galaxy_bit"])
                at = to

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in out)
    return rows.mapInArrow(work, f"{kinds}, layers array<tinyint>, counts array<long>, n_galaxy_bit long")


def _with_bit(bit: int) -> Column:
    """Number of pixels of a stamp that have a layer."""
    total = F.element_at("counts", 1) * 0
    for v in range(16):
        if v & bit:
            total = total + F.element_at("counts", v + 1)
    return total


def verdict(found: DataFrame, *keep: str) -> DataFrame:
    """Shares of a stamp's pixels: covered, in each layer, and with the galaxy bit of the mask."""
    n = F.size("layers").cast("double")
    shares = [(_with_bit(b) / n).alias(f"{name}_frac") for name, b in (("bright", BRIGHT), ("source", SOURCE), ("galaxy", GALAXY))]
    return found.select(*keep, (1.0 - _with_bit(INVALID) / n).alias("valid_frac"), *shares, (F.col("n_galaxy_bit") / n).alias("galaxy_bit_frac"))


def pulls(found: DataFrame) -> DataFrame:
    """n, mean and deviation of sci * sqrt(ivar) in r, and the share of negative pixels, over pixels without any layer."""
    clean = F.expr("filter(arrays_zip(layers, sci_r, ivar_r), p -> p.layers = 0)")
    rows = found.select(F.explode(clean).alias("p")).select("p.*")
    pull = F.col("sci_r") * F.sqrt("ivar_r")
    return rows.agg(F.count("*").alias("n"), F.avg(pull).alias("pull_mean"), F.stddev_pop(pull).alias("pull_std"), F.avg((F.col("sci_r") < 0).cast("double")).alias("negative"))


# --- one plane in NumPy


def cut(plane: np.ndarray, cx: float, cy: float, size: int, fill: float, top: int = 0, height: int | None = None) -> np.ndarray:
    """size x size pixels about a position: index ceil(centre - size / 2) comes first, and fill is beyond the tile.

    plane may be some rows of the tile, from top on, as long as it has those that the cutout meets.
    """
    out = np.full((size, size), fill, plane.dtype)
    x, y = int(np.ceil(cx - size / 2)), int(np.ceil(cy - size / 2))
    height = plane.shape[0] + top if height is None else height
    x0, x1, y0, y1 = max(x, 0), min(x + size, plane.shape[1]), max(y, 0), min(y + size, height)
    if x0 < x1 and y0 < y1:
        out[y0 - y : y1 - y, x0 - x : x1 - x] = plane[y0 - top : y1 - top, x0:x1]
    return out


def around(cx: float, cy: float, size: int, width: int, height: int) -> tuple[int, int, int, int, int, int]:
    """(row, column, first and last row + 1, first and last column + 1) of the pixel at a position and of the box of a stamp about it."""
    col, row = min(max(round(cx), 0), width - 1), min(max(round(cy), 0), height - 1)
    half = size // 2
    return row, col, max(row - half, 0), min(row + half + 1, height), max(col - half, 0), min(col + half + 1, width)


def seeing(plane: np.ndarray, cx: float, cy: float, size: int, top: int = 0, height: int | None = None) -> float:
    """The value at a position's pixel, or the median of the covered ones in its stamp's box, or 0."""
    row, col, y0, y1, x0, x1 = around(cx, cy, size, plane.shape[1], plane.shape[0] + top if height is None else height)
    value = float(plane[row - top, col])
    if value > 0:
        return value
    box = plane[y0 - top : y1 - top, x0:x1]
    covered = box[box > 0]
    return float(np.median(covered)) if covered.size else 0.0


def summed(flags: np.ndarray) -> np.ndarray:
    """Summed-area table of a plane of flags, with a row and a column of zeros in front."""
    out = np.zeros((flags.shape[0] + 1, flags.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(flags, axis=0, dtype=np.int64), axis=1, out=out[1:, 1:])
    return out


def box_bounds(c: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of boxes about positions along one axis: cut off to whole pixels toward zero, then to the plane."""
    lo = np.minimum(np.maximum(np.trunc(c - size / 2), 0), width).astype(np.int64)
    return lo, np.maximum(np.minimum(np.maximum(np.trunc(c + size / 2), 0), width).astype(np.int64), lo)


def boxed(table: np.ndarray, cx: np.ndarray, cy: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share of each box on the plane, flags in it) by four look-ups a box."""
    (x0, x1), (y0, y1) = box_bounds(cx, size, table.shape[1] - 1), box_bounds(cy, size, table.shape[0] - 1)
    return (x1 - x0) * (y1 - y0) / (size * size), table[y1, x1] - table[y0, x1] - table[y1, x0] + table[y0, x0]


# --- stamps and tiles in Spark


def cutouts(tiles: DataFrame, centres: DataFrame, key: str, size: int, planes: tuple = tuple(f"{p}_{b}" for p in ("sci", "ivar") for b in BANDS)) -> DataFrame:
    """(key, planes and mask as size x size arrays) about centres (key, cx, cy) of tiles (key, width, height, planes, mask)."""
    rows = tiles.select(key, "width", "height", *planes, "mask").join(centres.select(key, "cx", "cy"), key)

    def work(batches):
        for b in batches:
            w, h, cx, cy = (b.column(c).to_pylist() for c in ("width", "height", "cx", "cy"))
            columns = []
            for name in (*planes, "mask"):
                lists = b.column(name)
                flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets) - lists.offsets[0].as_py()
                got = [cut(flat[at[i] : at[i + 1]].reshape(h[i], w[i]), cx[i], cy[i], size, FILL[name.split("_")[0]]).ravel() for i in range(b.num_rows)]
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * size * size), pa.array(np.concatenate(got) if got else flat[:0])))
            yield pa.record_batch([b.column(key), *columns], names=[key, *planes, "mask"])

    kinds = ", ".join(f"{p} array<double>" for p in planes)
    return rows.mapInArrow(work, f"{key} {rows.schema[key].dataType.simpleString()}, {kinds}, mask array<int>")


def seeings(tiles: DataFrame, positions: DataFrame, key: str) -> DataFrame:
    """(key, psf_g, psf_r, psf_z) at positions (key, cx, cy, size_px) of tiles (key, width, height, psf_g, psf_r, psf_z as planes)."""
    names = [f"psf_{b}" for b in BANDS]
    rows = tiles.select(key, "width", "height", *names).join(positions.select(key, "cx", "cy", "size_px"), key)

    def work(batches):
        for b in batches:
            w, h, cx, cy, size = (b.column(c).to_pylist() for c in ("width", "height", "cx", "cy", "size_px"))
            columns = []
            for name in names:
                flat, at = b.column(name).flatten().to_numpy(zero_copy_only=False), np.asarray(b.column(name).offsets) - b.column(name).offsets[0].as_py()
                columns.append(pa.array([seeing(flat[at[i] : at[i + 1]].reshape(h[i], w[i]), cx[i], cy[i], size[i]) for i in range(b.num_rows)], pa.float64()))
            yield pa.record_batch([b.column(key), *columns], names=[key, *names])

    return rows.mapInArrow(work, f"{key} {rows.schema[key].dataType.simpleString()}, psf_g double, psf_r double, psf_z double")


def mask_boxes(candidates: DataFrame, tiles: DataFrame, size: Column, scale: float) -> DataFrame:
    """(id, on_grid, galaxy_pixels): the share of a candidate's box on its tile's grid, and pixels with a galaxy bit in it.

    candidates (id, brick, ra, dec) of a brick meet its tile (brick, tra, tdec, width, height, mask) as one list, for which
    the mask is summed up once; each candidate then takes four look-ups.  A brick without a tile gives no row.
    """
    rows = candidates.withColumn("size", size.cast("double")).select("id", "brick", "ra", "dec", "size")
    x, y = pixel(north_up(F.col("tra"), F.col("tdec"), F.lit(scale), (F.col("width") + 1) / 2), F.col("ra"), F.col("dec"))
    placed = rows.join(dealt(tiles.select("brick", "tra", "tdec", "width")), "brick").select("id", "brick", "size", x.alias("px"), y.alias("py"))
    lists = placed.groupBy("brick").agg(F.collect_list(F.struct("id", "px", "py", "size")).alias("c"))

    def look_up(batches):
        for b in batches:
            masks, each = b.column("mask"), b.column("c")
            flat, at = masks.flatten().to_numpy(), np.asarray(masks.offsets) - masks.offsets[0].as_py()
            one, ends = each.flatten(), np.asarray(each.offsets) - each.offsets[0].as_py()
            px, py, side = (one.field(n).to_numpy() for n in ("px", "py", "size"))
            on_grid, n = np.zeros(len(one)), np.zeros(len(one), np.int64)
            for i, (w, h) in enumerate(zip(b.column("width").to_pylist(), b.column("height").to_pylist(), strict=True)):
                own = slice(ends[i], ends[i + 1])
                table = summed((flat[at[i] : at[i + 1]] & GALAXY_BIT != 0).reshape(h, w))
                on_grid[own], n[own] = boxed(table, px[own], py[own], side[own])
            yield pa.record_batch([one.field("id"), pa.array(on_grid), pa.array(n)], names=["id", "on_grid", "galaxy_pixels"])

    kind = candidates.schema["id"].dataType.simpleString()
    met = lists.join(dealt(tiles.select("brick", "width", "height", "mask")), "brick").select("width", "height", "mask", "c")
    return met.mapInArrow(look_up, f"id {kind}, on_grid double, galaxy_pixels long")


def framed(stamps: DataFrame) -> DataFrame:
    """Stamps with their frames' slopes at the centre."""
    return with_jacobian(stamps, F.col("width"), F.col("height"))
