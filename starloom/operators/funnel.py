"""Background candidates: proposal, tests in order, outcome."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import elliptical_radius, offset_position
from ..sources.shared import dealt
from .catalog import half_diagonal
from .spatial import blocked, resolve_bricks

#: Reasons in the order of their tests.
REASONS = ("footprint", "sga_overlap", "fetch", "coverage", "sga_maskbit", "error")


def seeded_angles(n: int, slack: float, seed: int):
    """array<struct<pa, slack>> of a generator seeded with (seed, sga_id): n angles, then n slacks."""

    @F.pandas_udf("array<struct<pa:double,slack:double>>")
    def draw(sga_id: pd.Series) -> pd.Series:
        def one(k: int) -> list[dict]:
            rng = np.random.default_rng([seed, int(k)])
            pa, more = rng.uniform(0.0, 360.0, n), rng.uniform(0.0, slack, n)
            return [{"pa": float(a), "slack": float(b)} for a, b in zip(pa, more, strict=True)]

        return sga_id.map(one)

    return draw


def propose(targets: DataFrame, pa: Column, slack: Column, r_iso: Column) -> DataFrame:
    """Positions around targets (ra, dec, ba, pa, size_px; a row for each k): outside the isophote along pa by the stamp's half-diagonal and slack."""
    rows = targets.withColumn("pa_deg", pa).withColumn("half_diag", half_diagonal(F.col("size_px")))
    t = F.radians("pa_deg")
    factor = elliptical_radius(F.sin(t), F.cos(t), F.col("pa"), F.col("ba"))
    rows = rows.withColumn("sep_arcsec", (r_iso / factor + F.col("half_diag")) * (slack + 1.0))
    ra, dec = offset_position(F.col("ra"), F.col("dec"), F.col("sep_arcsec"), F.col("pa_deg"))
    return rows.withColumn("_ra", ra).withColumn("_dec", dec).drop("ra", "dec").withColumnsRenamed({"_ra": "ra", "_dec": "dec"})


def structural_tests(candidates: DataFrame, atlas: DataFrame, bricks: DataFrame, min_nexp: int = 1, margin: float = 1.5) -> DataFrame:
    """Adds brick, hemisphere ('' outside the footprint), in_parent_brick and clear to candidates (id, ra, dec, half_diag, parent_sga_id, parent_brick)."""
    found = resolve_bricks(candidates, bricks, min_nexp)
    bad = blocked(candidates.withColumn("extra", F.col("half_diag")).withColumn("exclude", F.col("parent_sga_id")), atlas, margin).withColumn("bad", F.lit(True))
    rows = candidates.join(dealt(found), "id", "left").join(dealt(bad), "id", "left")
    rows = rows.withColumn("brick", F.coalesce("brick", F.lit(""))).withColumn("hemisphere", F.coalesce("hemisphere", F.lit("")))
    return rows.withColumn("in_parent_brick", (F.col("brick") == F.col("parent_brick")).cast("int")).withColumn("clear", F.col("bad").isNull()).drop("bad")


def funnel(candidates: DataFrame, failed: DataFrame, boxes: DataFrame, coverage_min: float = 0.8) -> DataFrame:
    """Status and reason of candidates: the first test that fails counts."""
    rows = candidates.join(failed.select("brick", F.lit(True).alias("failed")).distinct(), "brick", "left").join(dealt(boxes), "id", "left")
    tests = {"footprint": F.col("brick") == "", "sga_overlap": ~F.col("clear"), "fetch": F.col("failed").isNotNull(), "coverage": F.col("on_grid") < coverage_min, "sga_maskbit": F.col("galaxy_pixels") > 0}
    reason = F.coalesce(*[F.when(test, name) for name, test in tests.items()])
    return rows.withColumn("reason", F.coalesce(reason, F.lit(""))).withColumn("status", F.when(reason.isNull(), "candidate").otherwise("rejected"))


def outcome(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Candidates that passed all tests, by the ledger (parent_sga_id, k, l_status, l_reason): written ones are accepted,
    others rejected for its reason, and those it lacks rejected for an error."""
    rows = candidates.join(dealt(ledger), ["parent_sga_id", "k"], "left")
    live = F.col("status") == "candidate"
    status = F.when(live & (F.col("l_status") == "written"), "accepted").when(live, "rejected").otherwise(F.col("status"))
    reason = F.when(~live, F.col("reason")).when(F.col("l_status") == "written", "").when(F.col("l_status").isNull(), "error").otherwise(F.coalesce("l_reason", F.lit("")))
    return rows.withColumn("reason", reason).withColumn("status", status).drop("l_status", "l_reason")


def rejected_in_mirror(candidates: DataFrame, tiles: DataFrame, n: int = 48, without: tuple = ("footprint", "fetch")) -> DataFrame:
    """The first n rejected candidates, by parent and k, whose tile (brick) is mirrored; those rejected for want of one are left out."""
    rows = candidates.where((F.col("status") == "rejected") & ~F.col("reason").isin(*without))
    return rows.join(tiles.select("brick").distinct(), "brick", "left_semi").orderBy("parent_sga_id", "k").limit(n)
