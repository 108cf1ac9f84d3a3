"""Exact quantiles against the built-in aggregate, with passes forced on small data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import quantiles as Q
from starloom.operators import reports

WANTED = {"median": ("v", 0.5), "low": ("v", 0.05), "high": ("v", 0.9), "least": ("v", 0.0), "most": ("v", 1.0), "w_q25": ("w", 0.25)}


def plain(df, by):
    return df.groupBy(*by).agg(*[F.percentile(c, F.lit(q)).alias(n) for n, (c, q) in WANTED.items()])


def same(got, want):
    assert got.columns == want.columns
    a, b = (sorted(map(tuple, x.collect()), key=str) for x in (got, want))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for m, n in zip(x, y, strict=True):
            assert m == n if n is None or isinstance(n, str) else m == pytest.approx(n, rel=1e-12, abs=0, nan_ok=True)


@pytest.fixture
def table(spark):
    rng = np.random.default_rng(4)
    hot = [("hot", float(x), float(y)) for x, y in zip(rng.lognormal(0, 30, 3000), rng.integers(0, 3, 3000), strict=True)]
    ties = [("ties", float(x), 1.0) for x in [0.0] * 1000 + [1.0] * 1000 + [-5.0, 7.0]]
    odd = [(None, x, None) for x in (3.0, None, 1.0, 4.0)] + [("none", None, None), ("one", 2.5, -0.0), ("wide", -1e308, 1.0), ("wide", 1e308, float("inf")), ("nan", float("nan"), 1.0), ("nan", 2.0, 2.0), ("nan", 2.0, 2.0)]
    return spark.createDataFrame(hot + ties + odd, "g string, v double, w double")


@pytest.mark.parametrize("gathered, pivots", [(10_000, 1000), (50, 1000), (3, 20)])
def test_quantiles_are_those_of_the_plain_aggregate(table, monkeypatch, gathered, pivots):
    monkeypatch.setattr(Q, "GATHERED", gathered)
    monkeypatch.setattr(Q, "PIVOTS", pivots)
    same(Q.quantiles(table, ["g"], WANTED), plain(table, ["g"]))


def test_without_groups_and_without_rows(table, monkeypatch):
    monkeypatch.setattr(Q, "GATHERED", 20)
    same(Q.quantiles(table.where("g <> 'nan'"), [], WANTED), plain(table.where("g <> 'nan'"), []))
    assert [tuple(r) for r in Q.quantiles(table.limit(0), [], WANTED).collect()] == [(None,) * len(WANTED)]
    assert Q.quantiles(table.limit(0), ["g"], WANTED).collect() == []


def test_a_coarse_sketch_costs_passes_and_not_exactness(table, monkeypatch):
    monkeypatch.setattr(Q, "GATHERED", 300)
    monkeypatch.setattr(Q, "PRECISION", 50)
    same(Q.quantiles(table, ["g"], WANTED), plain(table, ["g"]))


def test_scatter_of_arrays(spark):
    df = spark.createDataFrame([(1, [3.0, 1.0, None, 10.0]), (2, [5.0, 5.0]), (3, []), (4, None)], "k int, a array<double>")
    got = {r.k: r.sigma for r in reports.robust_sigma(df, "a").collect()}
    assert got == {1: pytest.approx(2 * 1.4826), 2: 1e-3, 3: None, 4: None}
