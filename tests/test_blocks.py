"""Neighbourhoods along axes 2 and 3 in overlapping blocks, against whole lines."""

import numpy as np
import pytest

from tracelake.cube import Axis, Cube, Meta
from tracelake.operators import blocks, neighbour

KERNELS = {
    "deriv": lambda c, k: neighbour.deriv(c, k),
    "forward": lambda c, k: neighbour.deriv(c, k, "forward"),
    "sum": lambda c, k: neighbour.integrate(c, k),
    "trapezoid": lambda c, k: neighbour.integrate(c, k, "trapezoid", True),
    "rms": lambda c, k: neighbour.local_rms(c, 4, k),
    "agc": lambda c, k: neighbour.agc(c, 5.0 * c.meta.axis(k).d, k),
    "box": lambda c, k: neighbour.smooth(c, 3, k, repeat=2),
    "triangle": lambda c, k: neighbour.smooth(c, 2, k, "triangle"),
    "decimate": lambda c, k: neighbour.decimate(c, 3, k),
    "laplacian": lambda c, k: neighbour.laplacian(c, [k]),
}


def _cube(spark, x, order=(0, 1, 2)):
    """x[i3, i2, i1] with axes exchanged so that line axis ``order[0]`` comes first."""
    n3, n2, n1 = x.shape
    rows = [(i2, i3, x[i3, i2].tolist()) for i3 in range(n3) for i2 in range(n2)]
    return Cube(spark.createDataFrame(rows, "i2 long, i3 long, samples array<double>"), Meta((Axis(n1, 0.0, 0.5), Axis(n2, 0.0, 0.5), Axis(n3, 0.0, 0.5))), "trace")


def _array(c):
    out = np.full(c.meta.shape[::-1], np.nan)
    for r in c.long().df.collect():
        out[r["i3"], r["i2"], r["i1"]] = r["v"]
    return out


@pytest.mark.parametrize("name", KERNELS)
@pytest.mark.parametrize(("axis", "layout"), [(2, "trace"), (3, "trace"), (2, "long")])
def test_blocks_are_as_whole_lines(spark, monkeypatch, name, axis, layout):
    monkeypatch.setattr(blocks, "SAMPLES", 5 * 6)  # six traces of five samples are a block
    x = np.random.default_rng(3).normal(size=(5, 23, 4) if axis == 2 else (23, 3, 5))
    turn = (0, 2, 1) if axis == 2 else (2, 1, 0)  # the line comes to axis 1
    want = _array(KERNELS[name](_cube(spark, x.transpose(turn)), 1)).transpose(turn)
    c = _cube(spark, x)
    got = KERNELS[name](c if layout == "trace" else c.long(), axis)
    assert got.layout == layout and np.allclose(_array(got), want)


def test_a_task_gets_no_whole_line(spark):
    c = _cube(spark, np.ones((1, 200, 3)))
    sizes = blocks._blocked(c, 2, 32, 4).groupBy("_block").count().collect()
    assert len(sizes) == 7 and max(r["count"] for r in sizes) == 40


def test_reach_beyond_a_block(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SAMPLES", 4)
    x = np.random.default_rng(5).normal(size=(1, 50, 2))
    got = _array(neighbour.local_rms(_cube(spark, x), 21, 2))
    want = np.array([[[np.sqrt(np.mean(x[0, max(0, i - 10) : i + 11, k] ** 2)) for k in range(2)] for i in range(50)]])
    assert np.allclose(got, want)
