"""Point-spread functions: unit-sum stamps, profiles, distances and fits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from ..sources.views import PIXSCALE
from .quantiles import quantiles


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, whether each is one, the row of each) of a batch's arrays, without copies."""
    flat = column.flatten()
    at = np.asarray(column.offsets) if not column.null_count else np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy()))
    return flat.to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), np.diff(at))


def _sums(values: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(own, weights=values, minlength=n)


def normalise(stamps: DataFrame, keep: list[str]) -> DataFrame:
    """Stamps (value as an array, and what keep names) with each one's sum brought to 1; null pixels stay null.

    A stamp is worked on where it is: nothing is shuffled, and a task holds a batch at a time.
    """

    def work(batches):
        for b in batches:
            lists = b.column("value")
            v, known, own = _lists(lists)
            with np.errstate(divide="ignore", invalid="ignore"):
                unit = v / _sums(np.where(known, v, 0.0), own, b.num_rows)[own]
            ends = np.append(0, np.cumsum(np.bincount(own, minlength=b.num_rows)))
            out = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(unit, mask=~known))
            yield pa.record_batch([*(b.column(c) for c in keep), out], names=[*keep, "value"])

    kinds = ", ".join(f"`{c}` {stamps.schema[c].dataType.simpleString()}" for c in keep)
    return stamps.select(*keep, "value").mapInArrow(work, f"{kinds}, value array<double>")


def on_grid(f) -> Column:
    """The values of f(x, y) on a stamp's pixels (width, height), row by row."""
    wide = F.col("width")
    return F.transform(F.sequence(F.lit(0), wide * F.col("height") - 1), lambda i: f(i % wide, F.floor(i / wide)))


def moffat(r2: Column, alpha: Column, beta: Column) -> Column:
    return F.pow(r2 / (alpha * alpha) + 1.0, -beta)


def moffat_fwhm(alpha: Column, beta: Column) -> Column:
    return alpha * 2.0 * F.sqrt(F.pow(F.lit(2.0), F.lit(1.0) / beta) - 1.0)


def moffat_alpha(fwhm: Column, beta: Column) -> Column:
    return fwhm / (F.sqrt(F.pow(F.lit(2.0), F.lit(1.0) / beta) - 1.0) * 2.0)


def gaussian(r2: Column, fwhm: Column) -> Column:
    sigma = fwhm / 2.3548
    return F.exp(r2 * -0.5 / (sigma * sigma))


def total_variation(stamps: DataFrame, keep: list[str], kernel: Column) -> DataFrame:
    """Half the L1 distance of unit-sum stamps (value as an array, and what keep names) from a kernel (an array as well), itself brought to unit sum.

    Null pixels aren't counted; a stamp of nothing else has no distance.  A stamp is worked on where it is, as in normalise.
    """

    def work(batches):
        for b in batches:
            v, known, own = _lists(b.column("value"))
            k, _, of = _lists(b.column("_kernel"))
            n = b.num_rows
            far = 0.5 * _sums(np.abs(np.where(known, v - k / _sums(k, of, n)[own], 0.0)), own, n)
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(far, mask=_sums(known, own, n) == 0)], names=[*keep, "total_variation"])

    kinds = ", ".join(f"`{c}` {stamps.schema[c].dataType.simpleString()}" for c in keep)
    return stamps.select(*keep, "value", kernel.alias("_kernel")).mapInArrow(work, f"{kinds}, total_variation double")


def summary(fits: DataFrame) -> DataFrame:
    """By band: number of stamps, median and quartiles of beta, median FWHM, medians and 90th percentiles of the distances."""
    shares = {"beta_median": ("beta", 0.5), "beta_q25": ("beta", 0.25), "beta_q75": ("beta", 0.75), "fwhm_median_arcsec": ("_fwhm", 0.5)}
    shares |= {f"tv_{k}_{n}": (f"tv_{k}", p) for k in ("moffat", "gauss") for p, n in ((0.5, "median"), (0.9, "p90"))}
    rows = kept(fits.select("band", "beta", (F.col("fwhm_px") * PIXSCALE).alias("_fwhm"), "tv_moffat", "tv_gauss"), "fits")
    return rows.groupBy("band").agg(F.count("*").alias("n_stamps")).join(F.broadcast(quantiles(rows, ["band"], shares)), "band")


def with_stamps(groups: DataFrame, present: DataFrame, bands: tuple = ("g", "r", "z")) -> DataFrame:
    """(group_name, band) of groups whose stamp in the band is present (group_name, band)."""
    every = groups.select("group_name", F.explode(F.array(*[F.lit(b) for b in bands])).alias("band"))
    return every.join(present, ["group_name", "band"], "left_semi")


#: Stamps that are fitted together, and steps of a fit at most.
TOGETHER, STEPS = 256, 200


def _model(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Circular Moffats (stamps x pixels) and their derivatives by amplitude, centre, alpha and beta."""
    amplitude, x0, y0, alpha, beta = (p[:, i, None] for i in range(5))
    dx, dy = x[None, :] - x0, y[None, :] - y0
    r2 = dx * dx + dy * dy
    u = 1 + r2 / alpha**2
    f = u**-beta
    slope = amplitude * beta * f / u
    return amplitude * f, np.stack([f, slope * 2 * dx / alpha**2, slope * 2 * dy / alpha**2, slope * 2 * r2 / alpha**3, -amplitude * f * np.log(u)], axis=2)


def fits(z: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parameters, cost, whether it settled) of bounded Levenberg-Marquardt fits of stamps (a row of pixels each), all together.

    The normal equations of all stamps that haven't settled are solved at once; each has its own damping.  A fit has
    settled if its cost hardly falls any more or is next to nothing, or if no step leads down where its slope is nought within the bounds.
    """
    n = len(z)
    top = np.argmax(z, axis=1) if z.shape[1] else np.zeros(n, int)
    peak = z.max(axis=1, initial=-np.inf)
    p = np.stack([peak, x[top], y[top], np.full(n, 3.0), np.full(n, 2.5)], axis=1)
    lo = np.stack([np.zeros(n), x[top] - 3, y[top] - 3, np.full(n, 0.3), np.full(n, 1.1)], axis=1)
    hi = np.stack([10 * peak, x[top] + 3, y[top] + 3, np.full(n, 30.0), np.full(n, 10.0)], axis=1)
    damp, settled = np.full(n, 1e-3), np.zeros(n, bool)
    cost = np.full(n, np.inf)
    live = np.flatnonzero(np.isfinite(peak) & (peak > 0))
    f, grad = _model(p[live], x, y)
    cost[live] = ((f - z[live]) ** 2).sum(axis=1)
    for _ in range(STEPS):
        if not len(live):
            break
        a = np.einsum("spi,spj->sij", grad, grad)
        g = np.einsum("spi,sp->si", grad, f - z[live])
        diagonal = np.einsum("sii->si", a)
        a = a + (damp[live, None] * (diagonal + 1e-12))[:, :, None] * np.eye(5)
        q = np.clip(p[live] + np.linalg.solve(a, -g[:, :, None])[:, :, 0], lo[live], hi[live])
        f2, grad2 = _model(q, x, y)
        cost2 = ((f2 - z[live]) ** 2).sum(axis=1)
        better = cost2 < cost[live]
        norm = (z[live] ** 2).sum(axis=1)
        small = better & ((cost[live] - cost2 < 1e-10 * cost[live]) | (cost2 <= 1e-20 * norm))
        won = live[better]
        p[won], cost[won] = q[better], cost2[better]
        f[better], grad[better] = f2[better], grad2[better]
        damp[live] = np.where(better, damp[live] / 3, damp[live] * 4)
        at = p[live]
        free = ~((at <= lo[live]) & (g > 0) | (at >= hi[live]) & (g < 0))
        flat = (np.abs(g * at) * free).max(axis=1) <= 1e-9 * norm
        stuck = damp[live] > 1e10
        settled[live[small | (stuck & flat)]] = True
        stay = ~(small | stuck)
        live, f, grad = live[stay], f[stay], grad[stay]
    return p, cost, settled


def _by_shape(b: pa.RecordBatch):
    """(row numbers, values, x, y) of stamps of one shape, some at a time."""
    width, height = b.column("width").to_numpy(), b.column("height").to_numpy()
    lists = b.column("value")
    flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets) - lists.offsets[0].as_py()
    for w, h in sorted(set(zip(width.tolist(), height.tolist(), strict=True))):
        every = np.flatnonzero((width == w) & (height == h))
        y, x = (v.ravel().astype(float) for v in np.mgrid[0:h, 0:w])
        for k in range(0, len(every), TOGETHER):
            rows = every[k : k + TOGETHER]
            yield rows, flat[at[rows][:, None] + np.arange(w * h)], x, y


_FIT = ("amplitude", "x0", "y0", "alpha", "beta", "cost")


def fit_stamps(stamps: DataFrame, keep: list[str]) -> DataFrame:
    """A circular Moffat for each stamp (width, height, value as an array): what keep names, amplitude, x0, y0, alpha, beta, cost, fwhm_px.

    Stamps without a positive peak, and fits that don't settle, give no row.  A partition's stamps are one task's work.
    """

    def work(batches):
        for b in batches:
            for rows, z, x, y in _by_shape(b):
                p, cost, settled = fits(z, x, y)
                taken = pa.array(rows[settled])
                yield pa.record_batch([*(b.column(c).take(taken) for c in keep), *(pa.array(v) for v in p[settled].T), pa.array(cost[settled])], names=[*keep, *_FIT])

    kinds = ", ".join(f"`{c}` {stamps.schema[c].dataType.simpleString()}" for c in keep)
    found = stamps.select(*dict.fromkeys([*keep, "width", "height", "value"])).mapInArrow(work, kinds + "".join(f", {c} double" for c in _FIT))
    return found.withColumn("fwhm_px", moffat_fwhm(F.col("alpha"), F.col("beta")))


def residuals(fitted: DataFrame, keep: list[str]) -> DataFrame:
    """tv_moffat and tv_gauss: half the L1 distance of unit-sum stamps (width, height, value) from unit-sum kernels of their fit's
    centre (x0, y0) and fwhm_px: a Moffat of beta_band, and a Gaussian."""

    def work(batches):
        for b in batches:
            at = {c: b.column(c).to_numpy() for c in ("x0", "y0", "fwhm_px", "beta_band")}
            for rows, z, x, y in _by_shape(b):
                x0, y0, width, beta = (at[c][rows][:, None] for c in ("x0", "y0", "fwhm_px", "beta_band"))
                r2 = (x[None, :] - x0) ** 2 + (y[None, :] - y0) ** 2
                alpha = width / (2 * np.sqrt(2 ** (1 / beta) - 1))
                kernels = (1 + r2 / alpha**2) ** -beta, np.exp(-0.5 * r2 / (width / 2.3548) ** 2)
                far = [0.5 * np.abs(z / z.sum(axis=1, keepdims=True) - k / k.sum(axis=1, keepdims=True)).sum(axis=1) for k in kernels]
                yield pa.record_batch([*(b.column(c).take(pa.array(rows)) for c in keep), *map(pa.array, far)], names=[*keep, "tv_moffat", "tv_gauss"])

    kinds = ", ".join(f"`{c}` {fitted.schema[c].dataType.simpleString()}" for c in keep)
    return fitted.select(*dict.fromkeys([*keep, "width", "height", "value", "x0", "y0", "fwhm_px", "beta_band"])).mapInArrow(work, f"{kinds}, tv_moffat double, tv_gauss double")


def library(stamps: DataFrame, keep: list[str]) -> DataFrame:
    """Stamps (band, width, height, value) with their fits and, by the median beta of their band, the distances from both kernels.

    keep names columns that tell the stamps apart, band among them.
    """
    fitted = kept(fit_stamps(stamps, [*dict.fromkeys([*keep, "width", "height", "value"])]), "fitted")
    bands = quantiles(fitted, ["band"], {"beta_band": ("beta", 0.5)})
    return residuals(fitted.join(F.broadcast(bands), "band"), [*keep, "x0", "y0", "alpha", "beta", "fwhm_px"])


def as_arrays(pixels: DataFrame, key: list[str]) -> DataFrame:
    """Stamps as arrays (key, width, height, value) of full grids of pixels (key, y, x, value)."""
    one = pixels.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("y", "x", "value"))).alias("p"))
    return one.select(*key, (F.array_max("p.x") + 1).alias("width"), (F.array_max("p.y") + 1).alias("height"), F.col("p.value").alias("value"))


def fit_moffat(pixels: DataFrame, key: list[str]) -> DataFrame:
    """fit_stamps of stamps given as pixels (key, y, x, value)."""
    full = as_arrays(pixels, key).where(F.size("value") == F.col("width") * F.col("height"))
    return fit_stamps(full, key)
