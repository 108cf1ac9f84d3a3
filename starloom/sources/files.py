"""Reading and writing catalogues, ledgers, samples and sidecars; fetching files."""

from __future__ import annotations

import hashlib
import os
import time
import urllib.error
import urllib.request

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that catalogues must have, by kind.
REQUIRED = {
    "galaxies": ("sga_id", "galaxy", "ra", "dec", "z_leda", "d26", "sma_sb25", "sma_sb26", "ba", "pa", "group_name", "group_ra"),
    "bricks": ("hemisphere", "brickname", "ra", "dec", "ra1", "ra2", "dec1", "dec2", "nexp_g", "nexp_r", "nexp_z"),
    "side": ("brickname", "ra", "dec", "ra1", "ra2", "dec1", "dec2", "nexp_g", "nexp_r", "nexp_z"),
    "tractor": ("ra", "dec", "type", "shape_r", "shape_e1", "shape_e2", "ref_cat", "ref_id", "flux_r"),
    "stars": ("ra", "dec", "phot_g_mean_mag"),
}
GALAXY_LEDGER = "file string, sga_id long, galaxy string, ra double, dec double, brick string, hemisphere string, size_px int, psf_g double, psf_r double, psf_z double, valid_frac double, bright_frac double, source_frac double, galaxy_frac double, galaxy_bit_frac double, status string, reason string"
BACKGROUND_LEDGER = "file string, parent_sga_id long, k int, ra double, dec double, brick string, hemisphere string, size_px int, sep_arcsec double, pa_deg double, psf_g double, psf_r double, psf_z double, valid_frac double, bright_frac double, source_frac double, galaxy_frac double, galaxy_bit_frac double, status string, reason string"
RETRIES, LONGEST_WAIT = 5, 60


def catalogue(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A catalogue in Parquet, CSV or FITS, its column names in lower case; a required column that lacks is an error."""
    if path.endswith(".csv"):
        df = spark.read.csv(path, header=True, inferSchema=True)
    elif path.endswith((".fits", ".fits.gz")):
        from .fits import FitsTable

        spark.dataSource.register(FitsTable)
        df = spark.read.format("fits-table").load(path)
    else:
        df = spark.read.parquet(path)
    df = df.toDF(*[c.lower() for c in df.columns])
    if missing := [c for c in REQUIRED[kind] if c not in df.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return df


def two_hemispheres(north: DataFrame, south: DataFrame) -> DataFrame:
    """The two brick tables as one."""
    return south.withColumn("hemisphere", F.lit("south")).unionByName(north.withColumn("hemisphere", F.lit("north")))


def bricks(spark: SparkSession, north: str, south: str) -> DataFrame:
    """The bricks of both hemispheres, from a catalogue of each."""
    return two_hemispheres(catalogue(spark, north, "side"), catalogue(spark, south, "side"))


def ledger(spark: SparkSession, path: str, schema: str = GALAXY_LEDGER) -> DataFrame:
    """A ledger in CSV with a header; empty cells are null."""
    return spark.read.schema(schema).csv(path, header=True)


def append_ledger(rows: DataFrame, path: str) -> None:
    """Adds files to a ledger; each batch is whole or absent."""
    rows.write.mode("append").csv(path, header=True)


def write_samples(samples: DataFrame, path: str) -> None:
    """Samples by brick, in whole files."""
    samples.write.mode("append").partitionBy("brick").parquet(path)


def read_samples(spark: SparkSession, path: str, bricks: list[str] | None = None) -> DataFrame:
    """Samples as write_samples has left them; of some bricks alone, whose folders are then the only ones read."""
    rows = spark.read.parquet(path)
    return rows if bricks is None else rows.where(F.col("brick").isin(*bricks))


def write_sidecars(stars: DataFrame, path: str, key: str = "sga_id", overwrite: bool = False) -> None:
    """A folder of CSV for each frame with a star; those already there are kept unless overwritten."""
    spark = stars.sparkSession
    if overwrite:
        stars.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).csv(path, header=True)
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        there = spark.read.csv(path, header=True).select(F.col(key).cast(stars.schema[key].dataType)).distinct()
        stars = stars.join(there, key, "left_anti")
    stars.write.mode("append").partitionBy(key).csv(path, header=True)


def fixed(df: DataFrame, **digits: int) -> DataFrame:
    """Doubles as text with so many digits after the point, for a text sink alone."""
    return df.withColumns({c: F.format_string(f"%.{n}f", c) for c, n in digits.items()})


def write_candidates(candidates: DataFrame, path: str) -> None:
    """The public columns of candidates, written anew."""
    public = ["parent_sga_id", "k", "ra", "dec", "pa_deg", "sep_arcsec", "size_px", "brick", "hemisphere", "in_parent_brick", "status", "reason"]
    fixed(candidates.select(public), ra=6, dec=6, pa_deg=2, sep_arcsec=1).write.mode("overwrite").csv(path, header=True)


def write_companions(companions: DataFrame, path: str) -> None:
    """file, companion_ratio and companion_sep_r26, sorted by file."""
    rows = companions.select("file", "companion_ratio", "companion_sep_r26").orderBy("file")
    fixed(rows, companion_ratio=4, companion_sep_r26=4).write.mode("overwrite").csv(path, header=True)


def write_calibration(summary: DataFrame, fits: DataFrame, path: str) -> None:
    """One JSON object: a summary and the fits of each band; bands are few, fits of a band are its stamps."""
    by_band = fits.groupBy("band").agg(F.sort_array(F.collect_list(F.struct(*[c for c in fits.columns if c != "band"]))).alias("fits"))
    rows = summary.join(by_band, "band").select("band", F.struct(*[c for c in summary.columns if c != "band"]).alias("summary"), "fits")
    rows.coalesce(1).write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str) -> None:
    """A table as CSV with a header if its name says so, else as Parquet."""
    df.write.mode("overwrite").csv(path, header=True) if path.endswith(".csv") else df.write.mode("overwrite").parquet(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(name, length) of the files of a folder, without reading them."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def looks_whole(path: str, digest: str | None = None) -> bool:
    """Whether a downloaded file is what was asked for: its digest if one is known, else whole FITS, compressed by gzip or not."""
    if digest:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest() == digest
    from .fits import whole

    return whole(path)


def fetch_one(url: str, dest: str, digest: str | None = None, retries: int = RETRIES, pause=time.sleep, validate: bool = True) -> tuple[int, str | None]:
    """(bytes fetched, error): a file that is there is kept; a partial one is gone on with; a bad one is fetched anew (unless
    whatever comes is taken, as older image services have it)."""
    if os.path.exists(dest):
        return 0, None
    part, error = dest + ".part", None
    os.makedirs(os.path.dirname(dest) or ".", exist_ok=True)
    for attempt in range(retries):
        if attempt:
            pause(min(2**attempt, LONGEST_WAIT))
        try:
            have = os.path.getsize(part) if os.path.exists(part) else 0
            request = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {})
            with urllib.request.urlopen(request, timeout=60) as answer, open(part, "ab" if have and answer.status == 206 else "wb") as f:
                while block := answer.read(1 << 20):
                    f.write(block)
            if not validate or looks_whole(part, digest):
                os.replace(part, dest)
                return os.path.getsize(dest) - have, None
            os.remove(part)
            error = "content"
        except (urllib.error.URLError, OSError) as e:
            error = type(e).__name__
    return 0, error


def fetch(tasks: DataFrame) -> DataFrame:
    """(url, dest, bytes, error) of tasks (url, dest, digest): each row is fetched by the task that has it, into a folder that all executors see."""

    def work(frames):
        for t in frames:
            got = [fetch_one(*row) for row in t[["url", "dest", "digest"]].itertuples(index=False)]
            yield pd.DataFrame({"url": t["url"], "dest": t["dest"], "bytes": [b for b, _ in got], "error": [e for _, e in got]})

    return tasks.select("url", "dest", "digest").mapInPandas(work, "url string, dest string, bytes long, error string")
