"""Programs as methods."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_extra import cube, matrix
from tracelake import commands
from tracelake.chain import Chain
from tracelake.cube import Axis
from tracelake.operators import modelling, neighbour, pointwise, spectral


def test_methods_are_the_programs(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(5, 32))
    c = Chain(cube(spark, x, Axis(32, 0.0, 0.01), Axis(5)))
    got = c.agc(rect=0.09).clip2(min=-1.0, max=1.5)
    assert np.allclose(matrix(got.cube), matrix(pointwise.clip_bounds(neighbour.agc(c.cube, 0.09), -1.0, 1.5)))
    assert np.allclose(matrix((c + c * c - c).cube), x * x) and np.allclose(matrix((c / c).cube), 1)
    back = c.fft().ifft().real()
    assert np.allclose(matrix(back.cube), x)
    assert np.allclose(matrix(c.map(F.abs).cmplx(c).imag().cube), x)
    one, two = c.write(f"file://{tmp_path}/a", "native_double"), Chain.read(spark, f"file://{tmp_path}/a")
    assert one.shape == two.shape == (32, 5) and np.array_equal(matrix(one.cube), x)
    assert c.quantile(q=[0.25, 0.5], axis=1).shape == (2, 5) and c.attr().first()["n"] == 160
    assert {"bandpass", "fft", "xcorr", "histogram"} <= set(dir(c)) and c.meta.axes[0].d == 0.01
    assert set(commands.ONE) <= set(dir(c))
    with pytest.raises(AttributeError):
        c.nothing_like_it
    with pytest.raises(ValueError):
        c.agc()


def test_spline_is_natural(spark):
    rng = np.random.default_rng(2)
    for n in (2, 3, 9):
        x = rng.normal(size=(3, n))
        got = matrix(spectral.spline(cube(spark, x), Axis(4 * n - 3, 0.0, 0.25)))
        a = np.eye(n)
        for i in range(1, n - 1):
            a[i, i - 1 : i + 2] = 1, 4, 1
        right = np.zeros((3, n))
        right[:, 1:-1] = 6 * np.diff(x, 2, axis=1)
        m = np.linalg.solve(a, right.T).T
        at = np.arange(4 * n - 3) / 4
        k = np.minimum(at.astype(int), n - 2)
        t, u = at - k, 1 - (at - k)
        assert np.allclose(got, u * x[:, k] + t * x[:, k + 1] + ((u**3 - u) * m[:, k] + (t**3 - t) * m[:, k + 1]) / 6)


def test_velocities_of_a_list(spark):
    rows = [(0.0, 0.0, float(r), 0.0, float(np.hypot(30, 20) + np.hypot(r - 30, 20)) / 2000.0, 1.0) for r in range(0, 100, 10)]
    picks = spark.createDataFrame(rows, "sx double, sz double, rx double, rz double, observed double, weight double")
    grid = Axis(6, 0.0, 10.0), Axis(4, 0.0, 10.0)
    r = modelling.locate_velocity(picks, *grid, velocities=[1500.0, 2000.0, 2000.0, 2500.0]).first()
    assert (r["ix"], r["iz"], round(r["velocity"])) == (3, 2, 2000) and r["objective"] < 1e-12
    for bad in ({}, {"low": 1.0, "high": 2.0, "velocities": [1.0]}, {"velocities": []}, {"velocities": [-1.0]}, {"low": 3.0, "high": 2.0}):
        with pytest.raises(ValueError):
            modelling.locate_velocity(picks, *grid, **bad)
