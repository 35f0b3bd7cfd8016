import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.cube import Axis, Cube, Meta, grid
from tracelake.functions.expr import compile_expression
from tracelake.operators import aggregate, pointwise, reshape, spectral


def cube(spark, values: np.ndarray, d: float = 1.0) -> Cube:
    rows = [(int(i), int(j), float(values[j, i])) for j in range(values.shape[0]) for i in range(values.shape[1])]
    return Cube(spark.createDataFrame(rows, "i1 long, i2 long, v double"), Meta((Axis(values.shape[1], 0.0, d), Axis(values.shape[0]))))


def matrix(c: Cube) -> np.ndarray:
    got = c.long().df.select("i1", "i2", "v").toPandas()
    out = np.zeros((c.meta.shape[1], c.meta.shape[0]))
    out[got.i2, got.i1] = got.v
    return out


def test_layouts_agree(spark):
    x = np.arange(20.0).reshape(4, 5)
    assert (matrix(cube(spark, x).traces()) == x).all()
    assert cube(spark, x).meta.leftsize(1) == 4


def test_grid_covers_every_cell(spark):
    assert grid(spark, (Axis(3), Axis(2), Axis(4))).distinct().count() == 24


def test_nan_propagates_unless_omitted(spark):
    c = cube(spark, np.array([[1.0, np.nan, 3.0]]))
    for stat in ("mean", "min", "max", "median"):
        assert np.isnan(aggregate.reduce(c, stat, 1).df.first()["v"])
    assert aggregate.reduce(c, "mean", 1, omit_nan=True).df.first()["v"] == 2


def test_division_policies(spark):
    a, b = cube(spark, np.array([[1.0, -1.0, 0.0]])), cube(spark, np.zeros((1, 3)))
    assert np.isnan(matrix(pointwise.combine(a, b, "div", "nan"))).all()
    inf = matrix(pointwise.combine(a, b, "div", "inf"))[0]
    assert inf[0] == np.inf and inf[1] == -np.inf and np.isnan(inf[2])
    with pytest.raises(Exception, match="division by zero"):
        matrix(pointwise.combine(a, b, "div"))


def test_expression_rejects_code():
    for text in ("__import__('os')", "x.y", "f(x)", "[1]", "'a'"):
        with pytest.raises((ValueError, SyntaxError)):
            compile_expression(text, {"x": F.lit(1.0)})


def test_window_updates_the_axis(spark):
    c = reshape.window(cube(spark, np.arange(10.0)[None], 0.5), 1, 2, 3, 2)
    assert matrix(c).tolist() == [[2, 4, 6]] and c.meta.axes[0] == Axis(3, 1.0, 1.0)


def test_dense_fills(spark):
    c = cube(spark, np.ones((2, 3)))
    assert matrix(reshape.dense(c.derive(c.df.where("i1 <> 1")), 7.0)).tolist() == [[1, 7, 1]] * 2


def test_filters_against_numpy(spark):
    x = np.random.default_rng(1).normal(size=(3, 64))
    c = cube(spark, x, 0.004)
    assert np.allclose(matrix(spectral.envelope(c)), np.abs(spectral.analytic(x)))
    assert np.allclose(matrix(spectral.bandpass(c, None, None)), x)
    taps = spectral.firwin(21, 40.0, 250.0)
    assert np.isclose(taps.sum(), 1)
    assert np.allclose(matrix(spectral.fir_filter(c, taps)), [np.convolve(t, taps)[10:74] for t in x])
    assert np.allclose(matrix(spectral.spline(c, c.meta.axes[0])), x)
