"""Order statistics against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.cube import Axis, Cube, Meta
from tracelake.operators import aggregate, order, pointwise


@pytest.mark.parametrize("few", [0, 5, 1000])
@pytest.mark.parametrize("kind", ["normal", "ties", "two", "powers", "one"])
def test_ranks(spark, kind, few):
    rng = np.random.default_rng(4)
    values = {"normal": rng.normal(size=2000), "ties": rng.integers(0, 7, 2000).astype(float), "two": np.repeat([0.0, 1.0], 900), "powers": 2.0 ** rng.integers(-900, 900, 1500) * rng.choice([-1, 1], 1500), "one": np.full(300, 3.5)}[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    ranks = [0, 1, len(values) // 2 - 1, len(values) // 2, len(values) - 1]
    got = order.select_ranks(df, ranks, few=max(few, 1))
    assert got == {r: np.sort(values)[r] for r in ranks}


def test_quantiles(spark):
    v = np.array([3.0, -1.0, 2.0, 2.0, math.inf, 0.5])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    q = [0, 0.3, 0.5, 0.7]
    assert np.allclose(order.quantiles(df, q), np.quantile(v, q))
    odd = df.union(spark.createDataFrame([(math.nan,)], "v double"))
    assert np.allclose(order.quantiles(odd, q), np.quantile(v, q))
    assert all(math.isnan(x) for x in order.quantiles(odd, q, omit_nan=False) + order.quantiles(df.limit(0), q))
    with pytest.raises(ValueError):
        order.quantiles(df, [1.5])


def _cube(spark, x):
    n2, n1 = x.shape
    return Cube(spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "i2 long, samples array<double>"), Meta((Axis(n1), Axis(n2))), "trace")


def _array(c, shape):
    out = np.full(shape, np.nan)
    for r in c.long().df.collect():
        out[tuple(r[f"i{k}"] for k in range(len(shape), 0, -1))] = r["v"]
    return out


@pytest.mark.parametrize("omit", [False, True])
def test_nan_policy(spark, omit):
    x = np.random.default_rng(1).normal(size=(5, 7))
    x[1, 3] = x[2] = np.nan
    use = np.nanquantile if omit else np.quantile
    q = [0.2, 0.5]
    with np.testing.suppress_warnings() as quiet:
        quiet.filter(RuntimeWarning)
        for c in (_cube(spark, x), _cube(spark, x).long()):
            for axis in (1, 2):
                want = np.moveaxis(use(x, q, axis=2 - axis), 0, 2 - axis)
                assert np.allclose(_array(aggregate.quantile(c, q, axis, omit), want.shape), want, equal_nan=True)
            assert np.allclose(_array(aggregate.quantile(c, q, None, omit), (2,)), use(x, q), equal_nan=True)


def test_percentile_clips(spark):
    x = np.random.default_rng(2).normal(size=(6, 9))
    x[0, 0], x[1, 1] = np.inf, np.nan
    fine = x[np.isfinite(x)]
    c = _cube(spark, x)
    clipped = lambda lo, hi: np.clip(x, lo, hi)
    assert np.allclose(_array(pointwise.clip_bounds(c, pclip=70.0), x.shape), clipped(*np.percentile(fine, [15, 85])), equal_nan=True)
    w = np.percentile(np.abs(fine), 70)
    assert np.allclose(_array(pointwise.clip_bounds(c, pclip=70.0, symmetric=True), x.shape), clipped(-w, w), equal_nan=True)
    assert np.allclose(_array(pointwise.clip_bounds(c, low=-0.5, symmetric=True), x.shape), clipped(-0.5, 0.5), equal_nan=True)
    w = np.percentile(np.abs(fine - 0.2), 60)
    scaled = np.where(np.isfinite(x), np.rint((np.clip(np.where(np.isfinite(x), x, 0), 0.2 - w, 0.2 + w) - 0.2 + w) * (255 / (2 * w))), 0)
    assert np.allclose(_array(pointwise.byte_scale(c, bias=0.2, pclip=60.0), x.shape), scaled)
    assert not _array(pointwise.byte_scale(_cube(spark, np.full((2, 3), 4.0))), (2, 3)).any()
    for bad in ({"pclip": 0.0}, {"pclip": 101.0}, {"pclip": 5.0, "low": 1.0}, {}, {"low": -1.0, "high": 2.0, "symmetric": True}):
        with pytest.raises(ValueError):
            pointwise.clip_bounds(c, **bad)
    with pytest.raises(ValueError):
        pointwise.clip_bounds(c.map(lambda v: F.lit(math.nan)), pclip=50.0)


@pytest.mark.parametrize("omit", [False, True])
def test_spreads_and_ranges_of_traces(spark, omit):
    x = np.random.default_rng(6).normal(size=(6, 9)) + 1e6
    x[1, 2] = x[3] = np.nan
    x[4, 1:] = np.nan
    c = _cube(spark, x)
    live = ~np.isnan(x) if omit else np.ones_like(x, bool)
    with np.testing.suppress_warnings() as quiet:
        quiet.filter(RuntimeWarning)
        for own in (c, c.long()):
            for ddof in (0, 1):
                n = live.sum(axis=1)
                want = np.where(n > ddof, (np.nanvar if omit else np.var)(x, axis=1, ddof=ddof), np.nan)
                if own.layout == "trace":
                    assert np.allclose(_array(aggregate.reduce(own, "var", 1, omit, ddof), (6,)), want, equal_nan=True)
                    assert np.allclose(_array(aggregate.reduce(own, "std", 1, omit, ddof), (6,)), np.sqrt(want), equal_nan=True)
            use = np.nanmax(x, axis=1) - np.nanmin(x, axis=1) if omit else x.max(axis=1) - x.min(axis=1)
            got = _array(aggregate.reduce(own, "range", 1, omit), (6,))
            assert np.allclose(got, use, equal_nan=True)
