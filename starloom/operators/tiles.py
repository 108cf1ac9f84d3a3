"""Samples cut from tiles that are opened once: groups of samples meet the files of their tile, not its pixels.

Only the rows of samples and of file names are shuffled, by tile.  A task opens each file of a tile once, reads the rows that
its samples meet and cuts all of them; tiles themselves stay where they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions.projection import frame, jacobian, pixel
from ..sources import images
from .layers import BANDS, GALAXY_BIT
from .stamps import ELLIPSES, FILL, around, boxed, cut, seeing, summed

#: Planes of a tile and how they are read.
KINDS = ("sci", "ivar", "psf")
#: Rows of a tile that are read at once where all are needed.
BAND = 1024
PLANES = [f"{k}_{b}" for k in ("sci", "ivar") for b in BANDS]


def tile_files(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """(brick, plane, file, width, height, and the columns of a projection) of paths (brick, plane, file), read from the headers alone.

    A plane is the image of its name, or a file's first image.  A file that can't be opened gives nulls, which says that the
    tile hasn't come.
    """
    names = ["width", "height", "ra0", "dec0", "crpix1", "crpix2", "cd11", "cd12", "cd21", "cd22"]

    def work(batches):
        for b in batches:
            out = []
            for plane, path in zip(b.column("plane").to_pylist(), b.column("file").to_pylist(), strict=True):
                try:
                    with images.opened(path) as f:
                        found = images.planes(f)
                    p = next((p for p in found if p.name == plane), found[0])
                except (OSError, IndexError, EOFError):
                    out.append([None] * len(names))
                    continue
                h = {k: float(x) for k in ("CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2", "CD1_1", "CD1_2", "CD2_1", "CD2_2") if (x := p.header.get(k)) is not None}
                cd = [h[k] * 3600.0 if k in h else None for k in ("CD1_1", "CD1_2", "CD2_1", "CD2_2")]
                out.append([float(p.width), float(p.height), h.get("CRVAL1"), h.get("CRVAL2"), h.get("CRPIX1"), h.get("CRPIX2"), *cd])
            columns = [pa.array(c, pa.float64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.float64())] * len(names)
            yield pa.record_batch([b.column("brick"), b.column("plane"), b.column("file"), columns[0].cast(pa.int32()), columns[1].cast(pa.int32()), *columns[2:]], names=["brick", "plane", "file", *names])

    return paths.select("brick", "plane", "file").mapInArrow(work, "brick string, plane string, file string, width int, height int, " + ", ".join(f"{n} double" for n in names[2:]))


def placed(samples: DataFrame, files: DataFrame, plane: str = "sci_g") -> DataFrame:
    """Samples (brick, ra, dec, size_px, ...) with their pixel on their tile (cx, cy) and the sky's slopes at their own centre."""
    one = files.where(F.col("plane") == plane).drop("plane", "file", "width", "height")
    x, y = pixel(frame(), F.col("ra"), F.col("dec"))
    rows = samples.join(one, "brick").withColumn("cx", x).withColumn("cy", y)
    # The centre of the cutout's pixels, as it falls on the tile's.
    mid = [F.ceil(F.col(c) - F.col("size_px") / 2) + (F.col("size_px") - 1) / 2.0 for c in ("cx", "cy")]
    slopes = dict(zip(("je_x", "je_y", "jn_x", "jn_y"), jacobian(frame(), *mid), strict=True))
    return rows.withColumns(slopes).drop(*[c for c in one.columns if c != "brick"])


class _Tile:
    """A tile's open files and what was read of them."""

    def __init__(self, plane: list[str], path: list[str]):
        self.paths, self.opened = dict(zip(plane, path, strict=True)), 0
        self.of_file: dict[str, list[str]] = {}
        for name, p in self.paths.items():
            self.of_file.setdefault(p, []).append(name)

    def each(self, lo: int, hi: int):
        """(plane, its rows lo to hi, its height) of every plane; each file is opened once."""
        for path, names in self.of_file.items():
            self.opened += 1
            with images.opened(path) as f:
                found = images.planes(f)
                for name in names:
                    p = next((p for p in found if p.name == name), found[0])
                    yield name, images.rows(f, p, max(lo, 0), min(hi, p.height)), p.height


def cut_samples(samples: DataFrame, files: DataFrame, keep: tuple = ()) -> DataFrame:
    """Samples (id, brick, cx, cy, size_px, and what keep names) with their planes as arrays, psf_g, psf_r, psf_z, width and height.

    files (brick, plane, file) has the planes sci_*, ivar_*, psf_* and mask, or some of them; others give nulls.  Beyond a tile sci and ivar are 0 and mask is 1.
    opened is, on a tile's first sample, how many files were opened for it, and 0 on the others.  A tile without files
    gives no rows, so that its samples are tried again.
    """
    out = [f.name for f in samples.schema if f.name in ("id", *keep)]
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}
    carried = [to_arrow_type(StructType.fromDDL(f"x {kinds[c]}")[0].dataType) for c in out]  # all of them nullable, as the result's are
    bands = [b for b in BANDS if f"psf_{b}" not in out]  # a sample that brings its seeing keeps it

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows if right.num_rows else 0
        left = left.slice(0, n)
        cx, cy, size = (left.column(c).to_pylist() for c in ("cx", "cy", "size_px"))
        tile = _Tile(right.column("plane").to_pylist(), right.column("file").to_pylist())
        stamps: dict[str, list] = {p: [None] * n for p in (*PLANES, "mask")}
        psf: dict[str, list] = {f"psf_{b}": [None] * n for b in bands}
        # Rows of the tile that cutouts or the boxes around their centres meet.
        lo = min([int(np.floor(y - s / 2)) - 1 for y, s in zip(cy, size, strict=True)], default=0)
        hi = max([int(np.ceil(y + s / 2)) + 2 for y, s in zip(cy, size, strict=True)], default=0)
        for name, rows, height in tile.each(max(lo, 0), hi) if n else ():
            top = max(lo, 0)
            if name in out:
                continue
            for i in range(n):
                if name.startswith("psf_"):
                    row, _, y0, y1, _, _ = around(cx[i], cy[i], size[i], rows.shape[1], height)
                    if min(row, y0) < top or max(row + 1, y1) > top + len(rows):  # a sample off the tile: its nearest rows
                        rows, top = _more(tile, name, min(y0, top), max(y1, top + len(rows)), height)
                    psf[name][i] = seeing(rows, cx[i], cy[i], size[i], top, height)
                else:
                    stamps[name][i] = cut(rows, cx[i], cy[i], size[i], FILL[name.split("_")[0]], top, height).ravel()
        side = pa.array(np.array(size, np.int32))
        opened = pa.array(np.array([tile.opened] + [0] * (n - 1) if n else [], np.int32))
        arrays = [pa.array(stamps[p], pa.list_(pa.float64() if p != "mask" else pa.int32())) for p in (*PLANES, "mask")]
        brought = [left.column(c).cast(kind) for c, kind in zip(out, carried, strict=True)]
        return pa.table([*brought, side, side, *arrays, *(pa.array(v, pa.float64()) for v in psf.values()), opened], names=[*out, "width", "height", *PLANES, "mask", *psf, "opened"])

    schema = [*(f"`{c}` {kinds[c]}" for c in out), "width int", "height int", *(f"{p} array<double>" for p in PLANES), "mask array<int>", *(f"psf_{b} double" for b in bands), "opened int"]
    needs = [*dict.fromkeys([*out, "brick", "cx", "cy", "size_px"])]
    return samples.select(*needs).groupBy("brick").cogroup(files.where("width is not null").select("brick", "plane", "file").groupBy("brick")).applyInArrow(work, ", ".join(schema))


def _more(tile: _Tile, name: str, lo: int, hi: int, height: int) -> tuple[np.ndarray, int]:
    tile.opened += 1
    with images.opened(tile.paths[name]) as f:
        found = images.planes(f)
        return images.rows(f, next((p for p in found if p.name == name), found[0]), lo, min(hi, height)), lo


def prescreened(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(id, on_grid, galaxy_pixels) of candidates (id, brick, cx, cy, size_px): the mask plane alone is opened, once for a tile."""
    kind = candidates.schema["id"].dataType.simpleString()

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows if right.num_rows else 0
        left = left.slice(0, n)
        on_grid, hits = np.zeros(0), np.zeros(0, np.int64)
        if n:
            with images.opened(right.column("file")[0].as_py()) as f:
                found = images.planes(f)
                p = next((p for p in found if p.name == "mask"), found[0])
                flags = np.concatenate([images.rows(f, p, a, a + BAND).astype(np.int64) & GALAXY_BIT != 0 for a in range(0, p.height, BAND)])
            on_grid, hits = boxed(summed(flags), *(left.column(c).to_numpy().astype(float) for c in ("cx", "cy", "size_px")))
        return pa.table([left.column("id"), pa.array(on_grid), pa.array(hits)], names=["id", "on_grid", "galaxy_pixels"])

    masks = files.where("plane = 'mask' and width is not null").select("brick", "file")
    return candidates.select("id", "brick", "cx", "cy", "size_px").groupBy("brick").cogroup(masks.groupBy("brick")).applyInArrow(work, f"id {kind}, on_grid double, galaxy_pixels long")


def whole_planes(files: DataFrame) -> DataFrame:
    """Planes of files (brick, plane, file), each small enough for a row: brick, plane, width, height, value."""

    def work(batches):
        for b in batches:
            for i, path in enumerate(b.column("file").to_pylist()):
                with images.opened(path) as f:
                    found = images.planes(f)
                    name = b.column("plane")[i].as_py()
                    v = images.rows(f, next((p for p in found if p.name == name), found[0])).astype(np.float64)
                side = [pa.array([n], pa.int32()) for n in v.shape[::-1]]
                yield pa.record_batch([b.column("brick").slice(i, 1), b.column("plane").slice(i, 1), *side, pa.array([v.ravel()])], names=["brick", "plane", "width", "height", "value"])

    return files.select("brick", "plane", "file").mapInArrow(work, "brick string, plane string, width int, height int, value array<double>")


def sample_rows(found: DataFrame, file: Column, cards: dict[str, Column]) -> DataFrame:
    """Rows for the sink "fits-planes" of samples with their layers: SCI, IVAR (three bands one after another), MASK and LAYERS, and cards."""

    def plane(name: str, kind: str, pixels: Column, depth: int = 1) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.col("width").cast("int").alias("width"), F.lit(depth).alias("depth"), pixels.cast("array<double>").alias("pixels"))

    parts = [plane("SCI", "f4", F.concat(*[f"sci_{b}" for b in BANDS]), 3), plane("IVAR", "f4", F.concat(*[f"ivar_{b}" for b in BANDS]), 3), plane("MASK", "i2", F.col("mask")), plane("LAYERS", "u1", F.col("layers"))]
    head = F.create_map(*[x for k, c in cards.items() for x in (F.lit(k), c.cast("string"))])
    return found.select(file.alias("file"), F.array(*parts).alias("planes"), head.alias("cards"))


__all__ = ["ELLIPSES", "cut_samples", "placed", "prescreened", "sample_rows", "tile_files"]
