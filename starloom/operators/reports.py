"""Survival, quality and distribution figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dealt, kept
from .quantiles import quantiles


def rejections(candidates: DataFrame) -> DataFrame:
    return candidates.where("status = 'rejected'").groupBy("reason").agg(F.count("*").alias("n"))


def survival(candidates: DataFrame) -> DataFrame:
    accepted = F.col("status") == "accepted"
    return candidates.agg(F.count("*").alias("n"), F.avg(accepted.cast("double")).alias("survival"), F.avg(F.when(accepted, F.col("in_parent_brick").cast("double"))).alias("in_parent_brick"))


def separation_stats(candidates: DataFrame) -> DataFrame:
    rows = candidates.where("status = 'accepted'")
    return quantiles(rows, [], {"sep_median": ("sep_arcsec", 0.5), "sep_p90": ("sep_arcsec", 0.9)})


def brick_survival(candidates: DataFrame) -> DataFrame:
    """Median and quartiles of the survival by brick; candidates outside the footprint are a group too."""
    each = candidates.groupBy("brick").agg(F.avg((F.col("status") == "accepted").cast("double")).alias("s"))
    each = kept(each, "bricks")
    return each.agg(F.count("*").alias("n_bricks")).join(F.broadcast(quantiles(each, [], {"median": ("s", 0.5), "q25": ("s", 0.25), "q75": ("s", 0.75)})))


def accepted_per_galaxy(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    n = candidates.where("status = 'accepted'").groupBy(F.col("parent_sga_id").alias("sga_id")).agg(F.count("*").alias("n"))
    rows = targets.select("sga_id").join(dealt(n), "sga_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.agg(F.avg("n").alias("mean_accepted"), F.avg((F.col("n") == 0).cast("double")).alias("none"))


def funnel_counts(candidates: DataFrame, reasons: tuple[str, ...]) -> DataFrame:
    """Candidates alive after each test, in order."""
    gone = lambda k: F.coalesce(F.col("reason").isin(*reasons[:k]), F.lit(False))
    return candidates.agg(F.count("*").alias("proposed"), *[F.count(F.when(~gone(k + 1), 1)).alias(f"after_{r}") for k, r in enumerate(reasons)])


def histogram(df: DataFrame, group: str, value: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """(group, bin, n, density) over bins of equal width, the last closed on the right; values outside aren't counted."""
    width = (hi - lo) / bins
    rows = df.where((value >= lo) & (value <= hi) & ~F.isnan(value)).withColumn("bin", F.least(F.floor((value - lo) / width), F.lit(bins - 1)))
    n = rows.groupBy(group, "bin").agg(F.count("*").alias("n"))
    total = n.groupBy(group).agg(F.sum("n").alias("total"))
    return n.join(total, group).select(group, "bin", "n", (F.col("n") / (F.col("total") * width)).alias("density"))


def seeing_spread(entries: DataFrame) -> DataFrame:
    """(band, median, p05, p95) of the seeing of a ledger's written samples."""
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"psf_{b}").alias("fwhm")) for b in "grz"])
    rows = entries.where("status = 'written'").select(F.explode(bands).alias("p")).select("p.*")
    return quantiles(rows, ["band"], {"median": ("fwhm", 0.5), "p05": ("fwhm", 0.05), "p95": ("fwhm", 0.95)})


def _middle(values: Column) -> Column:
    """The median of an array of numbers, null of an empty one."""
    n = F.size(values)
    at = lambda i: F.get(values, i.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def robust_sigma(df: DataFrame, value: str) -> DataFrame:
    """df with sigma of the array value: 1.4826 times the median distance from the median, 1e-3 where that is 0.

    A row is a stamp, so nothing is shuffled and no more is sorted at once than a stamp's pixels; nulls in it don't count.
    """
    rows = df.withColumn("_v", F.sort_array(F.filter(value, lambda x: x.isNotNull()))).withColumn("_m", _middle(F.col("_v")))
    rows = rows.withColumn("_v", F.sort_array(F.transform("_v", lambda x: F.abs(x - F.col("_m")))))
    sigma = _middle(F.col("_v")) * 1.4826
    return rows.withColumn("sigma", F.when(sigma == 0, 1e-3).otherwise(sigma)).drop("_v", "_m")


def extremes(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: the keys with the highest and the lowest value, and the values; of equal ones the smallest key."""
    hi, lo = F.max(F.struct(F.col(value), -F.col(key))), F.min(F.struct(F.col(value), F.col(key)))
    rows = df.agg(hi.alias("hi"), lo.alias("lo"))
    return rows.select((-F.col("hi.col2")).alias("most"), F.col(f"hi.{value}").alias("most_value"), F.col(f"lo.{key}").alias("least"), F.col(f"lo.{value}").alias("least_value"))
