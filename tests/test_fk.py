"""Transforms along axes 2 and 3 in several exchanges, against NumPy."""

import numpy as np
import pytest

from tracelake.cube import Axis, Cube, Meta
from tracelake.operators import complexes, transforms


def _complex(spark, z):
    """z[i3, i2, i1]."""
    rows = [(i2, i3, z[i3, i2].real.tolist(), z[i3, i2].imag.tolist()) for i3 in range(z.shape[0]) for i2 in range(z.shape[1])]
    return complexes.ComplexCube(spark.createDataFrame(rows, "i2 long, i3 long, re array<double>, im array<double>"), Meta(tuple(Axis(n, 0.0, 0.5) for n in z.shape[::-1])))


def _array(df, shape):
    out = np.full(shape, np.nan, complex)
    for r in df.collect():
        out[r["i3"], r["i2"]] = np.array(r["re"]) + 1j * np.array(r["im"])
    return out


@pytest.mark.parametrize(("n", "most"), [(1, 64), (12, 64), (70, 2048), (96, 12), (97, 2048), (97, 20), (35, 6), (66, 12), (128, 16)])
def test_along(spark, n, most):
    rng = np.random.default_rng(n)
    z = rng.normal(size=(2, n, 3)) + 1j * rng.normal(size=(2, n, 3))
    df = _complex(spark, z).df
    assert np.allclose(_array(transforms.along(df, ["i2", "i3"], 2, n, -1, most), z.shape), np.fft.fft(z, axis=1))
    assert np.allclose(_array(transforms.along(df, ["i2", "i3"], 2, n, 1, most), z.shape), np.fft.ifft(z, axis=1) * n)


def test_groups_are_small():
    assert transforms.factors(10**6) == (1000, 1000) and transforms.factors(48) == (1, 48) and transforms.factors(4099) is None
    assert all(r * s == n and max(r, s) <= transforms.MOST for n in range(65, 3000) if (f := transforms.factors(n)) for r, s in [f])
    assert transforms.factors(97, 20) is None and transforms.factors(1 << 30) == (1 << 15, 1 << 15)


@pytest.mark.parametrize("axis", [2, 3])
@pytest.mark.parametrize("norm", [None, "ortho", "forward"])
def test_axes_and_norms(spark, axis, norm):
    rng = np.random.default_rng(axis)
    z = rng.normal(size=(6, 9, 4)) + 1j * rng.normal(size=(6, 9, 4))
    c, at = _complex(spark, z), 3 - axis
    got = complexes.fft(c, axis, norm)
    assert np.allclose(_array(got.df, z.shape), np.fft.fftshift(np.fft.fft(z, axis=at, norm=norm), axes=at))
    back = complexes.ifft(got, axis, norm)
    assert np.allclose(_array(back.df, z.shape), z) and back.meta == c.meta


@pytest.mark.parametrize("n2", [8, 9])
def test_one_sided(spark, n2):
    x = np.random.default_rng(n2).normal(size=(2, n2, 3))
    c = complexes.real(_complex(spark, x + 0j))
    half = complexes.rfft(c, 2)
    want = np.fft.rfft(x, axis=1)
    assert np.allclose(_array(half.df, want.shape), want) and half.meta.axes[1].n == want.shape[1]
    back = complexes.irfft(half, 2)
    assert back.meta.shape == c.meta.shape
    got = {(r["i3"], r["i2"]): r["samples"] for r in back.df.collect()}
    assert all(np.allclose(got[i3, i2], x[i3, i2]) for i3 in range(2) for i2 in range(n2))
    fewer = complexes.irfft(half, 2, n=6)
    want = np.fft.irfft(np.fft.rfft(x, axis=1), 6, axis=1)
    assert all(np.allclose(r["samples"], want[r["i3"], r["i2"]]) for r in fewer.df.collect())


def test_absent_traces_are_zeros(spark):
    z = np.zeros((1, 10, 2), complex)
    z[0, [1, 4, 7]] = 1 + 2j
    c = _complex(spark, z)
    sparse = c.df.where("i2 in (1, 4, 7)")
    assert np.allclose(_array(transforms.along(sparse, ["i2", "i3"], 2, 10), z.shape), np.fft.fft(z, axis=1))
