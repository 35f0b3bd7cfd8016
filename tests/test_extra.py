"""Filters, two-axis transforms, solvers, modelling and SEG-Y against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.cube import Axis, Cube, Meta
from tracelake.operators import filters, modelling, scatter, solvers
from tracelake.sources import segy


def cube(spark, x, *axes):
    """Rank 2 or 3; x is (.., traces, samples)."""
    shape = x.shape[:-1][::-1]
    rows = [(*map(int, k[::-1]), x[k].tolist()) for k in np.ndindex(x.shape[:-1])]
    names = ", ".join(f"i{j + 2} long" for j in range(len(shape)))
    return Cube(spark.createDataFrame(rows, names + ", samples array<double>"), Meta(axes or tuple(Axis(n) for n in x.shape[::-1])), "trace")


def matrix(c):
    """A rank-2 cube as (axis 2, axis 1)."""
    rows = c.long().df.toPandas().pivot(index="i2", columns="i1", values="v")
    return rows.to_numpy()


@pytest.mark.parametrize("shape", [(6, 8), (5, 7)])
def test_two_axes(spark, shape):
    x = np.random.default_rng(1).normal(size=shape)
    n2, n1 = shape
    c = cube(spark, x, Axis(n1, 0, 0.004), Axis(n2, 0, 10.0))
    want = np.fft.fftshift(np.fft.fft2(x))
    assert np.allclose(matrix(filters.fk_spectrum(c)), np.abs(want))
    f, k = np.fft.fftshift(np.fft.fftfreq(n1, 0.004)), np.fft.fftshift(np.fft.fftfreq(n2, 10.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        speed = np.abs(f)[None] / np.abs(k)[:, None]
    speed[(k == 0)[:, None] & (f == 0)[None]] = 0
    keep = ((speed >= 1000) & (speed <= 3000)).astype(float)
    assert np.allclose(matrix(filters.fk_filter(c, 1000, 3000)), np.fft.ifft2(np.fft.ifftshift(want * keep)).real)
    assert np.allclose(matrix(filters.fk_filter(c, 1000, 3000, reject=True)), x - matrix(filters.fk_filter(c, 1000, 3000)))
    assert np.allclose(matrix(filters.fk_filter(c, 0.0)), x)
    plane = np.abs(np.fft.fft(np.fft.rfft(x, axis=1) * np.where(np.arange(n2) % 2, -1, 1)[:, None], axis=0)) / np.sqrt(n1 * n2)
    assert np.allclose(matrix(filters.spectra2(c)), plane)


def test_filters(spark):
    x = np.random.default_rng(2).normal(size=(3, 32))
    c = cube(spark, x, Axis(32, 0, 0.01), Axis(3))
    f = np.fft.rfftfreq(32, 0.01)
    s = np.fft.rfft(x)
    assert np.allclose(matrix(filters.bandstop(c, 10, 20)), np.fft.irfft(s * ~((f >= 10) & (f <= 20)), 32))
    gain = np.where((f >= 5) & (f < 10), np.sin(np.pi / 2 * (f - 5) / 5) ** 2, np.where((f >= 10) & (f < 30), 1, np.where((f >= 30) & (f < 40), np.sin(np.pi / 2 * (40 - f) / 10) ** 2, 0)))
    assert np.allclose(matrix(filters.trapezoid(c, (5, 10, 30, 40))), np.fft.irfft(s * gain, 32))
    twice = filters.half_integral(filters.half_integral(c), differentiate=True)
    want = s.copy()
    want[:, 0] = 0
    got = np.fft.rfft(matrix(twice))
    assert np.allclose(got[:, :-1], want[:, :-1])
    full = matrix(filters.trace_correlation(c, c, normalize=True))
    assert np.allclose(full[:, 31], 1) and np.allclose(full[0] * (x[0] ** 2).sum(), np.correlate(x[0], x[0], "full"))
    with pytest.raises(ValueError):
        filters.trapezoid(c, (5, 4, 30, 40))


def test_match_is_adjoint(spark):
    rng = np.random.default_rng(3)
    noise, data, taps = rng.normal(size=(4, 12)), rng.normal(size=(4, 12)), rng.normal(size=5)
    forward = matrix(scatter.match(cube(spark, noise), taps))
    back = scatter.match_adjoint(cube(spark, data), cube(spark, noise), 5).df.orderBy("i1").toPandas()["v"].to_numpy()
    assert np.isclose((forward * data).sum(), (back * taps).sum())


def vector(spark, x):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double")


def dense(df, n):
    out = np.zeros(n)
    for r in df.collect():
        out[r["i"]] = r["v"]
    return out


def test_solvers(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(6, 3)), rng.normal(size=6)
    entries = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(6) for j in range(3)], "row long, col long, value double")
    op = solvers.Matrix(entries, 6, 3)
    want = np.linalg.lstsq(a, b, rcond=None)[0]
    right = vector(spark, b)
    for solve in (solvers.cgnr, solvers.cgls, solvers.lsqr):
        assert np.allclose(dense(solve(op, right, steps=3).x, 3), want, atol=1e-6), solve
    damped = np.linalg.solve(a.T @ a + 0.25 * np.eye(3), a.T @ b)
    for solve in (solvers.cgls, solvers.lsqr, solvers.cgnr):
        assert np.allclose(dense(solve(op, right, steps=3, damp=0.5).x, 3), damped, atol=1e-6), solve
    weights = solvers.diagonal(vector(spark, [1.0, 2.0, 3.0]), 3)
    assert np.allclose(dense(solvers.cgls(op, right, steps=3, preconditioner=weights).x, 3), want, atol=1e-6)
    with pytest.raises(ValueError):
        solvers.conjugate_gradient(solvers.scaled(solvers.identity(3), -1.0), vector(spark, [1.0, 0, 0]))
    empty = solvers.cgls(op, vector(spark, [0.0] * 6))
    assert empty.converged and empty.iterations == 0


def test_dot_tests(spark):
    entries = spark.createDataFrame([(0, 1, 2.0), (3, 0, -1.0)], "row long, col long, value double")
    op = solvers.Matrix(entries, 4, 4)
    for a in (op, solvers.composed(op, op), solvers.added(op, solvers.identity(4)), solvers.stacked(op, solvers.scaled(op, 3.0)), solvers.differences(4), solvers.differences(4, 2)):
        left, right, alike = solvers.dot_test(spark, a)
        assert alike, (left, right)
    assert dense(solvers.differences(4, 2).forward(vector(spark, [0, 1, 4, 9])), 2).tolist() == [2, 2]


def test_acoustic(spark):
    model = modelling.constant_velocity(spark, Axis(31, 0, 10.0), Axis(31, 0, 10.0), 2000.0)  # symmetric about index 15
    shots = spark.createDataFrame([(0, 15, 15, [15, 20, 10], [15, 15, 15])], "shot long, sx int, sz int, rx array<int>, rz array<int>")
    got = {r["i2"]: np.array(r["samples"]) for r in modelling.acoustic_survey(shots, model, Axis(60, 0, 0.002)).collect()}
    assert np.isfinite(got[0]).all() and np.allclose(got[1], got[2])
    assert np.abs(got[1][:8]).max() < 1e-3 * np.abs(got[0]).max()
    with pytest.raises(ValueError, match="unstable"):
        modelling.acoustic_survey(shots, model, Axis(60, 0, 0.02))


@pytest.mark.parametrize("kind,order", [(1, ">"), (2, ">"), (3, "<"), (5, "<"), (5, ">"), (8, ">")])
def test_segy_round_trip(spark, tmp_path, kind, order):
    x = np.round(np.random.default_rng(5).normal(size=(7, 5)) * 40)
    rows = [(k, 100 + k, -50 * k, x[k].tolist()) for k in range(7)]
    df = spark.createDataFrame(rows, "trace long, cdp int, offset int, samples array<double>")
    path = str(tmp_path / "a.sgy")
    segy.write(df, path, 5, 4000, kind, order, "C 1 test")
    got, found = segy.read(spark, path, "auto")
    assert (found.samples, found.interval, found.kind, found.traces, found.order) == (5, 4000, kind, 7, order)
    rows = got.orderBy("trace").collect()
    assert np.array_equal([r["samples"] for r in rows], x) and [r["cdp"] for r in rows] == list(range(100, 107))
    assert [r["offset"] for r in segy.header_table(spark, path, "offset").orderBy("trace").collect()] == [-50 * k for k in range(7)]
    assert len(segy.NAMES) == 91 and found.record.itemsize == segy.HEAD + 5 * np.dtype(segy.SAMPLES[kind]).itemsize


def test_ibm_floats():
    x = np.array([0.0, 1.0, -118.625, 1e-20, 3.5e30, 1 / 3])
    assert np.allclose(segy.from_ibm(segy.to_ibm(x)), x, rtol=1e-6, atol=0)
    assert segy.to_ibm(np.array([-118.625]))[0] == 0xC276A000


def test_avo_without_offsets_raises(spark):
    c = cube(spark, np.ones((3, 4)), Axis(4), Axis(3))
    with pytest.raises(Exception, match="determine"):
        scatter.avo(c, F.lit(1.0)).df.collect()
