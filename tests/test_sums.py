"""Sums of whole traces by key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_extra import cube, matrix
from tracelake.cube import Axis
from tracelake.operators import aggregate, gathers, resample, sums


@pytest.mark.parametrize("held", [1, 12, 1 << 20])
def test_array_sums(spark, monkeypatch, held):
    monkeypatch.setattr(sums, "HELD", held)
    rng = np.random.default_rng(1)
    rows = [(int(k) if k < 5 else None, f"g{k % 2}", rng.normal(size=4).tolist()) for k in rng.integers(0, 7, 200)]
    df = spark.createDataFrame(rows, "a long, b string, samples array<double>").repartition(5)

    def kernel(batch):
        yield from sums.by_group(batch, ["a", "b"])(sums.matrix(batch))

    got = {(r["a"], r["b"]): r["sums"] for r in sums.array_sums(df, {"a": "bigint", "b": "string"}, kernel).collect()}
    want = {}
    for a, b, s in rows:
        want[a, b] = want.get((a, b), 0) + np.array(s)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert sums.array_sums(df.limit(0), {"a": "bigint", "b": "string"}, kernel).count() == 0


@pytest.mark.parametrize("mode", ["mean", "sum", "rms", "count_nonzero"])
def test_stacks(spark, mode):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4, 5, 6)) * (rng.random((4, 5, 6)) < 0.7)
    x[:, :, 2] = 0
    for nonzero in (True, False):
        for axis, at in ((2, 1), (3, 0)):
            n = np.maximum((x != 0).sum(axis=at), 1) if nonzero else x.shape[at]
            want = {"mean": x.sum(axis=at) / n, "sum": x.sum(axis=at), "rms": np.sqrt((x * x).sum(axis=at) / n), "count_nonzero": (x != 0).sum(axis=at)}[mode]
            got = aggregate.stack(cube(spark, x), axis, mode, nonzero)
            assert got.meta.shape == want.shape[::-1] and np.allclose(matrix(got), want)


def test_sparse_migration_reaches_as_far_as_time(spark):
    x = np.random.default_rng(4).normal(size=(60, 12))
    c = cube(spark, x, Axis(12, 0.0, 0.1), Axis(60, 0.0, 1.0))
    some = c.derive(c.df.where("i2 in (3, 40, 41)"))
    near = {r["i2"] for r in gathers.kirchhoff(some, 10.0).select("i2").distinct().collect()}
    within = lambda n: {i for i in range(60) if min(abs(i - 3), abs(i - 40), abs(i - 41)) <= n}
    assert within(5) <= near <= within(7)
    full, part = (gathers.kirchhoff(c, 10.0, a, True).orderBy("i2", "i1").collect() for a in (None, 6.0))
    assert np.allclose([r["v"] for r in full], [r["v"] for r in part])


def test_radon_mean(spark):
    x = np.random.default_rng(5).normal(size=(7, 9))
    c = cube(spark, x, Axis(9, 0.0, 0.5), Axis(7))
    total = resample.radon(c, F.col("i2") * 1.0, [0.0, 0.25], F.col("i2") % 2)
    mean = resample.radon(c, F.col("i2") * 1.0, [0.0, 0.25], F.col("i2") % 2, normalize=True)
    got = {(r["gather"], r["i1"], r["i2"]): r["v"] for r in mean.collect()}
    for r in total.collect():
        assert np.isclose(got[r["gather"], r["i1"], r["i2"]], r["v"] / (4 if r["gather"] == 0 else 3))
