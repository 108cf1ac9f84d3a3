"""The brightest companion of a target among the detections of its tile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import tangent_offsets
from .catalog import positive


def companion_ratio(samples: DataFrame, tractor: DataFrame, sep_min_frac: float = 0.25) -> DataFrame:
    """(sga_id, companion_ratio, companion_sep_r26) for samples (sga_id, grp, ra, dec, half, r26).

    The target's model is the first atlas row of its tile with its id; without one, or without flux, both are NaN.  With
    no companion both are 0.  Of equal ratios the first row counts.
    """
    atlas = F.trim("ref_cat") == "L3"
    first = F.row_number().over(W.partitionBy("grp", "ref_id").orderBy("row_no"))
    model = tractor.where(atlas).withColumn("_n", first).where("_n = 1").select(F.col("grp"), F.col("ref_id").alias("sga_id"), F.col("flux_r").alias("target_flux"))
    rows = samples.join(model, ["grp", "sga_id"], "left").withColumn("ok", F.coalesce(positive(F.col("target_flux")), F.lit(False)))
    others = tractor.where(~atlas & ~F.trim("type").isin("PSF", "DUP")).select("grp", F.col("ra").alias("sra"), F.col("dec").alias("sdec"), "flux_r", "row_no")
    east, north = tangent_offsets(F.col("sra"), F.col("sdec"), F.col("ra"), F.col("dec"), F.col("dec"))
    pairs = rows.where("ok").join(others, "grp").withColumn("e", east).withColumn("n", north).withColumn("sep", F.hypot("e", "n"))
    pairs = pairs.where((F.abs("e") < F.col("half")) & (F.abs("n") < F.col("half")) & (F.col("sep") > F.col("r26") * sep_min_frac))
    found = pairs.groupBy("sga_id").agg(F.max(F.struct((F.col("flux_r") / F.col("target_flux")).alias("ratio"), (-F.col("row_no")).alias("order"), (F.col("sep") / F.col("r26")).alias("sep"))).alias("best"))
    nan = F.lit(float("nan"))
    out = rows.select("sga_id", "ok").join(found, "sga_id", "left")
    return out.select("sga_id", *[F.when(~F.col("ok"), nan).otherwise(F.coalesce(F.col(f"best.{c}"), F.lit(0.0))).alias(n) for c, n in (("ratio", "companion_ratio"), ("sep", "companion_sep_r26"))])


def exceedance(companions: DataFrame, thresholds: tuple[float, ...] = (0.1, 0.2, 0.5)) -> DataFrame:
    """(threshold, n, share) of finite ratios above each threshold, in one pass."""
    finite = companions.where(~F.isnan("companion_ratio") & (F.abs("companion_ratio") < float("inf")))
    counts = finite.agg(F.count("*").alias("total"), *[F.count(F.when(F.col("companion_ratio") > t, 1)).alias(f"n{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("n")) for i, t in enumerate(thresholds)])
    return counts.select("total", F.explode(rows).alias("x")).select("x.threshold", "x.n", (F.col("x.n") / F.col("total")).alias("share"))
