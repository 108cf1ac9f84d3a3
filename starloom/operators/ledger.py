"""What has been fetched and written: addresses, checksums, resumption."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import dealt

#: File kinds of a brick.
PLANES, BANDS = ("image", "invvar", "psfsize"), ("g", "r", "z")


def brick_files(bricks: DataFrame, root: str = "https://portal.example/coadd", prefix: str = "survey") -> DataFrame:
    """The eleven files of each brick (brick, hemisphere): nine band planes, the mask plane and the catalogue.

    root and prefix (of the planes' names) are those of the archive that is fetched from.
    """
    kinds = [f"{p}-{b}" for p in PLANES for b in BANDS] + ["maskbits", "tractor"]
    rows = bricks.select("brick", "hemisphere", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"))
    tractor = F.col("kind") == "tractor"
    name = F.when(tractor, F.concat(F.lit("tractor-"), "brick", F.lit(".fits"))).otherwise(F.concat(F.lit(f"{prefix}-"), "brick", F.lit("-"), "kind", F.lit(".fits.fz")))
    folder = F.concat_ws("/", F.lit(root), "hemisphere", F.when(tractor, "tractor").otherwise("coadd"), F.substring("brick", 1, 3), F.when(~tractor, F.col("brick")))
    return rows.select("brick", "kind", name.alias("name"), F.concat_ws("/", folder, name).alias("url"))


def checksum_files(bricks: DataFrame, root: str = "https://portal.example/coadd", prefix: str = "survey", release: str = "dr") -> DataFrame:
    """(brick, hemisphere, url) of the checksum list beside each brick's planes."""
    part = F.substring("brick", 1, 3)
    name = F.concat(F.concat_ws("_", F.lit(prefix), F.lit(release), "hemisphere", F.lit("coadd"), part, "brick"), F.lit(".sha256sum"))
    return bricks.select("brick", "hemisphere", F.concat_ws("/", F.lit(root), "hemisphere", F.lit("coadd"), part, "brick", name).alias("url"))


def catalogue_files(hemispheres: DataFrame, root: str = "https://portal.example", prefix: str = "survey", release: str = "dr", atlas: str = "atlas") -> DataFrame:
    """(name, url) of the catalogues: the atlas of galaxies, and the bricks of each hemisphere (hemisphere)."""
    side = hemispheres.select("hemisphere").distinct()
    name = F.concat(F.lit(f"{prefix}-bricks-{release}-"), "hemisphere", F.lit(".fits.gz"))
    bricks = side.select(name.alias("name"), F.concat_ws("/", F.lit(root), "hemisphere", name).alias("url"))
    one = hemispheres.sparkSession.range(1).select(F.lit(f"{atlas}.fits").alias("name"), F.lit(f"{root}/{atlas}.fits").alias("url"))
    return one.union(bricks)


def fetch_summary(fetched: DataFrame) -> DataFrame:
    """One row of downloads (bytes, failed): how many there were, the bytes of those that came, and how many failed."""
    return fetched.agg(F.count("*").alias("n_tasks"), F.sum(F.when(~F.col("failed"), F.col("bytes"))).alias("bytes"), F.count_if("failed").alias("n_failed"))


def checksum_lines(answers: DataFrame) -> DataFrame:
    """(line) of downloaded checksum lists (status, body): none where the status isn't 200 or the body is a page of HTML."""
    whole = answers.where((F.col("status") == 200) & ~F.ltrim("body").startswith("<"))
    return whole.select(F.explode(F.split("body", r"\r?\n")).alias("line"))


def psf_files(groups: DataFrame, root: str = "https://portal.example/psf") -> DataFrame:
    """Three stamps for each group (group_name, group_ra), in a folder of its whole degree of RA, three digits wide."""
    rows = groups.select("group_name", "group_ra", F.explode(F.array(*[F.lit(b) for b in BANDS])).alias("band"))
    folder = F.lpad(F.col("group_ra").cast("int").cast("string"), 3, "0")
    return rows.select("group_name", "band", F.concat_ws("/", F.lit(root), folder, "group_name", F.concat("group_name", F.lit("-largegalaxy-psf-"), "band", F.lit(".fits.fz"))).alias("url"))


def parse_checksums(lines: DataFrame) -> DataFrame:
    """(name, digest) of lines of two words with a digest of 64 characters; a star before a name is dropped."""
    part = F.split(F.trim("line"), r"\s+")
    rows = lines.select(part.alias("p")).where((F.size("p") == 2) & (F.length(F.get("p", F.lit(0))) == 64))
    return rows.select(F.regexp_replace(F.get("p", F.lit(1)), r"^\*+", "").alias("name"), F.get("p", F.lit(0)).alias("digest"))


def validated(files: DataFrame) -> DataFrame:
    """(name, state): whether the content's digest is the one listed; unlisted files can't be told."""
    match = F.sha2("content", 256) == F.col("digest")
    return files.select("name", F.when(F.col("digest").isNull(), "unlisted").when(match, "ok").otherwise("bad").alias("state"))


def resume(targets: DataFrame, ledger: DataFrame) -> DataFrame:
    """Targets (file) that the ledger has no row for."""
    return targets.join(dealt(ledger.select("file")), "file", "left_anti")


def restored(targets: DataFrame, ledger: DataFrame) -> DataFrame:
    """Targets with the ledger's status: written is accepted, any other rejected for its reason; none is a candidate."""
    rows = targets.join(dealt(ledger.select("file", F.col("status").alias("_s"), F.col("reason").alias("_r"))), "file", "left")
    status = F.when(F.col("_s").isNull(), "candidate").when(F.col("_s") == "written", "accepted").otherwise("rejected")
    return rows.withColumn("status", status).withColumn("reason", F.when(status == "rejected", F.coalesce("_r", F.lit(""))).otherwise("")).drop("_s", "_r")


def pending(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Bricks of which some expected file (brick, name) isn't present (name)."""
    return expected.join(dealt(present.select("name")), "name", "left_anti").select("brick").distinct()


def volume_report(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: samples and bytes written, bricks of the selection, bytes the whole selection would take."""
    done = samples.where("status = 'written'").agg(F.count("*").alias("n_samples"), F.sum("bytes").alias("sample_bytes"))
    full = targets.agg(F.count("*").alias("n_targets"), F.countDistinct("brick").alias("n_bricks")).withColumn("one", F.lit(1))
    both = done.withColumn("one", F.lit(1)).join(full, "one").drop("one")
    return both.withColumn("extrapolated_bytes", F.col("sample_bytes") / F.nullif("n_samples", F.lit(0)) * F.col("n_targets"))


def spec_gate(spark: SparkSession, path: str, spec: dict) -> None:
    """Writes a run's parameters beside its output, or raises if a run with others has written there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(conf).exists(where):
        old = json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))
        if old != json.loads(json.dumps(spec)):
            raise ValueError(f"{path} is of a run with other parameters: {old}")
    else:
        out = where.getFileSystem(conf).create(where)
        out.write(bytearray(json.dumps(spec, sort_keys=True).encode()))
        out.close()
