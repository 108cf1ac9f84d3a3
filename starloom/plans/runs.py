"""The drivers from end to end, with the parameters that a user sets; each can be run again and goes on where it stopped."""

from __future__ import annotations

import argparse
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import companions, funnel, layers, ledger, psf, reports, select, spatial, stamps, stars, tiles
from ..operators.catalog import half_diagonal, isophotal_radius, with_geometry
from ..sources import files, images
from ..sources.shared import dealt, kept, removed
from ..sources.views import PIXSCALE

#: Planes of a whole tile: image, weight and seeing in three bands, and the mask.
TILE_PLANES = 10


@dataclass(frozen=True)
class Galaxies:
    """Parameters of the galaxy run; all of them but sample, limit and overwrite are a run's science and may not change when it goes on."""

    zcut: float = 0.05
    min_nexp: int = 1
    size_mult: float = 1.5
    min_size: int = 64
    sga_margin: float = 1.5
    coverage_min: float = 0.8
    sample: int | None = None
    limit: int | None = None
    overwrite: bool = False

    def science(self) -> dict:
        return {k: x for k, x in asdict(self).items() if k not in ("sample", "limit", "overwrite")}


@dataclass(frozen=True)
class Backgrounds(Galaxies):
    sb_limit: float = 28.0
    n_candidates: int = 8
    radius_slack: float = 0.5
    seed: int = 20260807


@dataclass(frozen=True)
class Library:
    """Parameters of the run of point-spread functions."""

    n_groups: int = 300
    zcut: float = 0.05


@dataclass(frozen=True)
class Companions:
    """The run of companions has no parameters but its paths."""


@dataclass(frozen=True)
class Sidecars:
    """Parameters of the run of stars beside older frames."""

    scale: float = PIXSCALE
    maglim: float = 17.0
    overwrite: bool = False


def targets(galaxies: DataFrame, bricks: DataFrame, s: Galaxies) -> DataFrame:
    found = select.galaxy_targets(galaxies, bricks, s.zcut, s.min_nexp, s.size_mult, s.min_size, s.sga_margin)
    return select.subsample(found, ["ra", "sga_id"], s.sample, s.limit)


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _sample_frames(samples: DataFrame, paths: DataFrame) -> DataFrame:
    """Samples on their tiles, with the projection and the slopes of their own pixels (the columns of a frame, width, height, scale)."""
    files_ = paths.where("plane = 'sci_g'").drop("plane", "file", "width", "height")
    rows = tiles.placed(samples, paths).join(files_, "brick")
    first = {c: F.ceil(F.col(c) - F.col("size_px") / 2) for c in ("cx", "cy")}
    moved = {"crpix1": F.col("crpix1") - first["cx"], "crpix2": F.col("crpix2") - first["cy"]}
    return rows.withColumns(moved).withColumns({"width": F.col("size_px"), "height": F.col("size_px"), "scale": F.lit(PIXSCALE)})


def cut_and_judge(samples: DataFrame, paths: DataFrame, detections: DataFrame, atlas: DataFrame, keep: tuple) -> DataFrame:
    """Samples (id, brick, ra, dec, size_px, and what keep names) with planes, layers, counts and seeing, from one pass over their tiles' files.

    paths is tile_files' table, detections (brick, ra, dec, type, shape_r, shape_e1, shape_e2, ref_cat) and the atlas are painted.
    """
    framed = kept(_sample_frames(samples, paths), "frames")
    needs = ("ra", "dec", *keep, "je_x", "je_y", "jn_x", "jn_y")
    psf = [f"psf_{b}" for b in layers.BANDS]
    # Point sources are painted as wide as the seeing, which is read first, from its own planes.
    seen = kept(tiles.cut_samples(framed, paths.where("plane like 'psf%'")).select("id", *psf), "seeing")
    framed = framed.join(seen, "id")
    own = detections.where("trim(ref_cat) <> 'L3'").join(framed.select("id", "brick", "psf_r"), "brick")
    sources = layers.source_shapes(own, F.col("psf_r")).select("id", F.lit(layers.SOURCE).alias("bit"), "ra", "dec", "radius", "axis_ratio", "angle")
    near = spatial.overlapping(framed.select("id", "ra", "dec", half_diagonal(F.col("size_px")).alias("half_diag")), atlas)
    shapes = near.select("id", "sga_id").join(dealt(atlas), "sga_id").select("id", F.lit(layers.GALAXY).alias("bit"), "ra", "dec", F.col("r26").alias("radius"), F.col("ba").alias("axis_ratio"), F.col("pa").alias("angle"))
    ellipses = stamps.ellipses_of(framed, sources.unionByName(shapes), "id")
    ready = framed.select("id", "brick", "cx", "cy", "size_px", *[c for c in needs if c not in ("id", "brick", "size_px")], *psf).join(ellipses, "id", "left")
    cut = tiles.cut_samples(ready, paths.where("plane not like 'psf%'"), ("brick", "size_px", *needs, *psf, "ellipses"))
    return stamps._layered(cut, "id", ("width", *tiles.PLANES, "mask", "brick", "size_px", "ra", "dec", *keep, *psf))


def _cut_run(spark: SparkSession, samples: DataFrame, paths: DataFrame, detections: DataFrame, atlas: DataFrame, out: str, schema: str, keep: tuple, coverage_min: float, bricks_at_once: int, stop_after: int | None) -> int:
    """Cuts, judges, writes and enters samples that the ledger at out lacks, a batch of bricks at a time; returns how many.

    A batch's files get their names in one commit, then its rows enter the ledger in one; a run that ends in between writes
    the same files again.  Samples of tiles that haven't come, and of those alone, stay out and are tried again.
    """
    manifest = f"{out}/manifest"
    if _there(spark, manifest):
        samples = ledger.resume(samples, files.ledger(spark, manifest, schema))
    samples = kept(samples, "samples")
    n = -(-samples.select("brick").distinct().count() // bricks_at_once)
    done = 0
    images.register(spark)
    for k in range(n if stop_after is None else min(n, stop_after)):
        batch = samples.where(F.pmod(F.xxhash64("brick"), F.lit(n)) == k)
        found = kept(cut_and_judge(batch, paths, detections, atlas, keep), "cut")
        judged = stamps.verdict(found, "id", "brick", "size_px", "ra", "dec", *keep, "psf_g", "psf_r", "psf_z")
        poor = F.col("valid_frac") < coverage_min
        shares = {c: F.when(~poor, F.col(c)) for c in ("bright_frac", "source_frac", "galaxy_frac", "galaxy_bit_frac")}
        entries = judged.withColumns({**shares, "status": F.when(poor, "rejected").otherwise("written"), "reason": F.when(poor, "coverage")})
        good = found.join(entries.where("status = 'written'").select("id", "valid_frac"), "id")
        cards = {"BRICK": F.col("brick"), "BANDS": F.lit(",".join(layers.BANDS)), "RA0": F.col("ra"), "DEC0": F.col("dec"), "PIXSCALE": F.lit(PIXSCALE), "VALIDFRC": F.col("valid_frac"), **{f"PSF_{b.upper()}": F.col(f"psf_{b}") for b in layers.BANDS}}
        images.save(tiles.sample_rows(good, F.concat(F.lit("samples/"), F.substring("brick", 1, 3), F.lit("/"), "file"), cards), out, primary="true")
        rows = kept(entries.select(*[c.split()[0] for c in schema.split(", ")]), "entries")
        done += rows.count()
        files.append_ledger(rows, manifest)
    return done


def galaxy_run(spark: SparkSession, galaxies: DataFrame, bricks: DataFrame, detections: DataFrame, paths: DataFrame, out: str, s: Galaxies = Galaxies(), bricks_at_once: int = 64, stop_after: int | None = None) -> int:  # noqa: B008
    """Samples of the targets as files and ledger rows under out, from tiles' files (paths: brick, plane, file); returns how many were entered."""
    ledger.spec_gate(spark, f"{out}/run.json", s.science())
    rows = targets(galaxies, bricks, s).withColumn("file", F.format_string("sga_%d.fits", "sga_id")).withColumn("id", F.col("sga_id"))
    if s.overwrite and _there(spark, f"{out}/manifest"):
        removed(spark, f"{out}/manifest")
    keep = ("file", "sga_id", "galaxy", "hemisphere")
    return _cut_run(spark, rows, kept(tiles.tile_files(spark, paths), "tiles"), detections, with_geometry(galaxies), out, files.GALAXY_LEDGER, keep, s.coverage_min, bricks_at_once, stop_after)


def propose(galaxies: DataFrame, bricks: DataFrame, s: Backgrounds = Backgrounds()) -> DataFrame:  # noqa: B008
    """Seeded candidates of every target with the tests of footprint and clearance done: brick, hemisphere, parent_brick, clear."""
    atlas = with_geometry(galaxies)
    found = targets(galaxies, bricks, s).select("sga_id", "ra", "dec", "d26", "size_px", F.col("brick").alias("parent_brick")).join(dealt(atlas.select("sga_id", "ba", "pa", "sma_sb25", "sma_sb26")), "sga_id")
    drawn = found.select("*", F.posexplode(funnel.seeded_angles(s.n_candidates, s.radius_slack, s.seed)("sga_id")).alias("k", "draw"))
    placed = funnel.propose(drawn, F.col("draw.pa"), F.col("draw.slack"), isophotal_radius(s.sb_limit)).drop("draw")
    placed = kept(placed.withColumn("parent_sga_id", F.col("sga_id")).withColumn("id", F.col("sga_id") * s.n_candidates + F.col("k")), "proposed")
    tested = funnel.structural_tests(placed, atlas, bricks, s.min_nexp, s.sga_margin)
    reason = F.when(F.col("brick") == "", "footprint").when(~F.col("clear"), "sga_overlap").otherwise("")
    return tested.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "", "candidate").otherwise("rejected"))


def background_run(spark: SparkSession, galaxies: DataFrame, bricks: DataFrame, detections: DataFrame, paths: DataFrame, out: str, s: Backgrounds = Backgrounds(), bricks_at_once: int = 64, stop_after: int | None = None) -> DataFrame:  # noqa: B008
    """Background samples from proposal to outcome under out; returns the candidates with their status and reason.

    Each candidate is proposed, tested for footprint and clearance, prescreened on its tile's mask alone, then cut and judged;
    the first test that it fails is its reason, and what the ledger says of it counts when the run goes on.  A run that is
    stopped (as after stop_after batches) and begun again enters nothing twice; candidates that no batch has reached yet
    are in error until one does.  The table of candidates is written anew each time.
    """
    ledger.spec_gate(spark, f"{out}/run.json", s.science())
    if s.overwrite and _there(spark, f"{out}/manifest"):
        removed(spark, f"{out}/manifest")
    tested = kept(propose(galaxies, bricks, s).drop("status", "reason"), "candidates")
    tile = kept(tiles.tile_files(spark, paths), "tiles")
    clear = tested.where("brick <> '' and clear")
    boxes = kept(tiles.prescreened(tiles.placed(clear.select("id", "brick", "ra", "dec", "size_px"), tile, "mask"), tile), "boxes")
    failed = clear.select("brick").distinct().join(tile.groupBy("brick").agg(F.count("width").alias("n")).where(f"n >= {TILE_PLANES}"), "brick", "left_anti")
    rows = kept(funnel.funnel(tested, failed, boxes, s.coverage_min), "tests")
    live = rows.where("status = 'candidate'").withColumn("file", F.format_string("bg_%d_%d.fits", "parent_sga_id", "k"))
    keep = ("file", "parent_sga_id", "k", "hemisphere", "sep_arcsec", "pa_deg")
    _cut_run(spark, live, tile, detections, with_geometry(galaxies), out, files.BACKGROUND_LEDGER, keep, s.coverage_min, bricks_at_once, stop_after)
    if _there(spark, f"{out}/manifest"):
        entered = files.ledger(spark, f"{out}/manifest", files.BACKGROUND_LEDGER)
    else:
        entered = spark.createDataFrame([], files.BACKGROUND_LEDGER)
    done = kept(funnel.outcome(rows, entered.select("parent_sga_id", "k", F.col("status").alias("l_status"), F.col("reason").alias("l_reason"))), "outcome")
    files.write_candidates(done, f"{out}/candidates")
    return done


def psf_run(spark: SparkSession, galaxies: DataFrame, bricks: DataFrame, paths: DataFrame, out: str, n_groups: int = 300, zcut: float = 0.05) -> DataFrame:
    """The calibration of point-spread functions: stamps of evenly spaced groups of galaxies (paths: group_name, band, file), fits, the
    bands' summaries, and both as JSON at out; returns the summaries.  Stamps that haven't come, or don't fit, are left out."""
    groups = targets(galaxies, bricks, Galaxies(zcut=zcut)).select("group_name", "group_ra").distinct()
    chosen = select.subsample(groups, ["group_ra", "group_name"], n_groups).select("group_name")
    some = kept(tiles.tile_files(spark, paths.join(chosen, "group_name", "left_semi").select(F.col("group_name").alias("brick"), F.col("band").alias("plane"), "file")).where("width is not null"), "stamps")
    stamp = tiles.whole_planes(some).withColumnsRenamed({"brick": "group_name", "plane": "band"})
    unit = stamp.withColumn("value", F.expr("transform(value, x -> x / aggregate(value, 0D, (s, v) -> s + v))"))
    found = kept(psf.library(unit, ["group_name", "band"]), "library")
    files.write_calibration(psf.summary(found), found, out)
    return psf.summary(found)


def companion_run(spark: SparkSession, manifest: DataFrame, galaxies: DataFrame, detections: DataFrame, out: str) -> DataFrame:
    """Companions of the written samples of a ledger as CSV at out, sorted by file; returns how many lie above the thresholds."""
    written = manifest.where("status = 'written'").select("file", "sga_id", F.col("brick").alias("grp"), "ra", "dec", (F.col("size_px") * PIXSCALE / 2).alias("half"))
    s = written.join(with_geometry(galaxies).select("sga_id", "r26"), "sga_id")
    found = kept(companions.companion_ratio(s, detections.withColumnRenamed("brick", "grp")).join(written.select("sga_id", "file"), "sga_id"), "companions")
    files.write_companions(found, out)
    return companions.exceedance(found)


def sidecar_run(spark: SparkSession, listing: DataFrame, catalogue: DataFrame, out: str, s: Sidecars = Sidecars()) -> DataFrame:  # noqa: B008
    """Stars in the frames of a listing (name, length) as folders of CSV at out, one for each frame that has some; returns stars by frame.

    Names that don't tell a place and a size have no sidecar.  Frames that have theirs keep it, unless overwritten.
    """
    frames = stars.parse_listing(listing).where("sga_id is not null and ra is not null and dec is not null and size_arcsec is not null")
    found = kept(stars.star_sidecars(frames.withColumn("id", F.col("sga_id")), catalogue, s.maglim, s.scale).withColumnRenamed("id", "sga_id"), "sidecars")
    files.write_sidecars(found, out, "sga_id", s.overwrite)
    return found.groupBy("sga_id").agg(F.count("*").alias("n_stars"))


def report(candidates: DataFrame) -> dict[str, DataFrame]:
    """The figures of a background run."""
    return {"rejections": reports.rejections(candidates), "survival": reports.survival(candidates), "separations": reports.separation_stats(candidates), "bricks": reports.brick_survival(candidates)}


def arguments(kind: type, argv: list[str] | None = None):
    """Parameters of a run from a command line: --zcut 0.03 and so on."""
    parser = argparse.ArgumentParser()
    for f in fields(kind):
        flag = "--" + f.name.replace("_", "-")
        if f.type == "bool":
            parser.add_argument(flag, action="store_true")
        else:
            parser.add_argument(flag, type=int if f.type in ("int", "int | None") else float, default=f.default)
    return kind(**vars(parser.parse_args(argv)))


#: The runs by name: parameters, and the tables that each reads.
RUNS = {
    "galaxies": (Galaxies, ("galaxies", "north", "south", "detections", "tiles")),
    "backgrounds": (Backgrounds, ("galaxies", "north", "south", "detections", "tiles")),
    "psf": (Library, ("galaxies", "north", "south", "tiles")),
    "companions": (Companions, ("galaxies", "detections", "manifest")),
    "sidecars": (Sidecars, ("frames", "stars")),
}


def main(spark: SparkSession, argv: list[str]) -> DataFrame | int:
    """A run by its name and a command line: `galaxies --galaxies atlas.fits --north n.fits.gz --south s.fits.gz --detections d
    --tiles t --out folder --zcut 0.03`.  tiles is a table of files (brick or group_name, plane or band, file), in Parquet."""
    kind, tables = RUNS[argv[0]]
    parser = argparse.ArgumentParser(prog=argv[0])
    for name in (*tables, "out"):
        parser.add_argument(f"--{name}", required=True)
    paths, rest = parser.parse_known_args(argv[1:])
    s, at = arguments(kind, rest), vars(paths)
    read = {n: files.catalogue(spark, at[n], k) for n, k in (("galaxies", "galaxies"), ("detections", "tractor"), ("stars", "stars")) if n in at}
    if "north" in at:
        read["bricks"] = files.bricks(spark, at["north"], at["south"])
    if "tiles" in at:
        read["tiles"] = spark.read.parquet(at["tiles"])
    if argv[0] == "galaxies":
        return galaxy_run(spark, read["galaxies"], read["bricks"], read["detections"], read["tiles"], at["out"], s)
    if argv[0] == "backgrounds":
        return background_run(spark, read["galaxies"], read["bricks"], read["detections"], read["tiles"], at["out"], s)
    if argv[0] == "psf":
        return psf_run(spark, read["galaxies"], read["bricks"], read["tiles"], at["out"], s.n_groups, s.zcut)
    if argv[0] == "companions":
        return companion_run(spark, files.ledger(spark, at["manifest"]), read["galaxies"], read["detections"], at["out"])
    return sidecar_run(spark, files.listing(spark, at["frames"]), read["stars"], at["out"], s)
