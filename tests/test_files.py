"""Dataset files, programs, comparisons, metrics, geometry and fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_extra import cube, matrix
from tracelake import commands
from tracelake.cube import Axis
from tracelake.operators import aggregate, complexes, metrics, neighbour, pointwise
from tracelake.sources import rsf


def complex_cube(spark, z, *axes):
    return complexes.cmplx(cube(spark, z.real, *axes), cube(spark, z.imag, *axes))


def values(c):
    rows = c.long().toPandas().sort_values(["i2", "i1"])
    return (rows["re"] + 1j * rows["im"]).to_numpy().reshape(c.meta.shape[::-1])


@pytest.mark.parametrize("shape", [(6, 8), (5, 7)])
@pytest.mark.parametrize("norm", [None, "ortho"])
def test_transforms(spark, shape, norm):
    rng = np.random.default_rng(3)
    z = rng.normal(size=shape) + 1j * rng.normal(size=shape)
    c = complex_cube(spark, z, Axis(shape[1], 0.5, 0.004, "Time", "s"), Axis(shape[0], 0, 10.0))
    for axis, np_axis in ((1, 1), (2, 0)):
        got = complexes.fft(c, axis, norm)
        assert np.allclose(values(got), np.fft.fftshift(np.fft.fft(z, axis=np_axis, norm=norm), axes=np_axis))
        f = np.fft.fftshift(np.fft.fftfreq(shape[np_axis], c.meta.axis(axis).d))
        assert np.isclose(got.meta.axis(axis).o, f[0]) and np.isclose(got.meta.axis(axis).d, f[1] - f[0])
        back = complexes.ifft(got, axis, norm)
        assert np.allclose(values(back), z) and back.meta.axes == c.meta.axes
    x = cube(spark, z.real, *c.meta.axes)
    for axis, np_axis in ((1, 1), (2, 0)):
        half = complexes.rfft(x, axis, norm)
        assert np.allclose(values(half), np.fft.rfft(z.real, axis=np_axis, norm=norm))
        assert np.allclose(matrix(complexes.irfft(half, axis, norm=norm)), z.real)
        assert complexes.irfft(half, axis, n=4).meta.axis(axis).n == 4
    assert np.allclose(matrix(complexes.modulus(c)), abs(z)) and np.allclose(matrix(complexes.phase(c)), np.angle(z))


def test_complex_conjugate_gradient(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(4, 3)) + 1j * rng.normal(size=(4, 3))
    entries = lambda a: spark.createDataFrame([(i, j, float(a[i, j].real), float(a[i, j].imag)) for i, j in np.ndindex(a.shape)], "row long, col long, re double, im double")
    vector = lambda v: spark.createDataFrame([(i, float(x.real), float(x.imag)) for i, x in enumerate(v)], "i long, re double, im double")
    got = lambda s: np.array([r["re"] + 1j * r["im"] for r in s.x.orderBy("i").collect()])
    h, b = m.conj().T @ m + np.eye(3), rng.normal(size=4) + 1j * rng.normal(size=4)
    assert np.allclose(got(complexes.complex_conjugate_gradient(entries(h), vector(b[:3]), 3, steps=6, tol=1e-10)), np.linalg.solve(h, b[:3]))
    assert np.allclose(got(complexes.complex_conjugate_gradient(entries(m), vector(b), 3, steps=6, tol=1e-10, mode="normal")), np.linalg.lstsq(m, b, rcond=None)[0])


def test_traces_and_samples_agree(spark):
    """Operators along axis 1 give the same on whole traces and on single samples."""
    x = np.random.default_rng(5).normal(size=(4, 9))
    c = cube(spark, x, Axis(9, 0, 0.5), Axis(4))
    for f in (
        lambda c: neighbour.deriv(c), lambda c: neighbour.deriv(c, method="forward"), lambda c: neighbour.integrate(c, 1, "trapezoid", True), lambda c: neighbour.local_rms(c, 4), lambda c: neighbour.agc(c, 2.0),
        lambda c: neighbour.smooth(c, 3, 1, "triangle"), lambda c: neighbour.smooth(c, 2, repeat=2), lambda c: neighbour.decimate(c, 3), lambda c: neighbour.laplacian(c, [1]), lambda c: neighbour.demean(c), lambda c: neighbour.detrend(c),
        lambda c: neighbour.reflectivity(c, 0.1), lambda c: aggregate.quantile(c, [0.0, 0.3, 1.0], 1), lambda c: pointwise.combine(c, c.map(F.abs), "sub"),
    ):
        assert np.allclose(matrix(f(c)), matrix(f(c.long())))
        assert "Exchange" not in f(c).df._jdf.queryExecution().executedPlan().toString() or "zip_with" in f(c).df._jdf.queryExecution().toString()
    for stat in ("sum", "mean", "rms", "min", "max", "median", "count", "std"):
        for bad in (x, np.where(x > 1, np.nan, x)):
            for omit in (False, True):
                a, b = (aggregate.reduce(k, stat, 1, omit).df.orderBy("i1").toPandas()["v"].to_numpy() for k in (cube(spark, bad), cube(spark, bad).long()))
                assert np.allclose(a, b, equal_nan=True), (stat, omit)


def test_three_axis_gradient(spark):
    x = np.random.default_rng(2).normal(size=(5, 4, 6))
    want = np.zeros((4, *x.shape))
    smooth = np.array([[1, 4, 1], [4, 4, 4], [1, 4, 1]])
    for k3, k2, k1 in np.ndindex(3, 2, 4):
        block = x[k3 : k3 + 3, k2 : k2 + 3, k1 : k1 + 3]
        for part, axis in ((1, 2), (2, 1), (3, 0)):
            faces = np.moveaxis(block, axis, 0)
            want[part, k3 + 1, k2 + 1, k1 + 1] = ((faces[2] - faces[0]) * smooth).sum() / 6
    want[0] = (want[1:] ** 2).sum(axis=0)
    for part in range(4):
        rows = neighbour.sobel3(cube(spark, x), part).long().df.toPandas().sort_values(["i3", "i2", "i1"])
        assert np.allclose(rows["v"].to_numpy().reshape(x.shape), want[part])


def test_datasets(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5, 7)).astype(np.float32)
    axes = (Axis(7, 1.0, 0.5, "Time", "s"), Axis(5, 0.0, 2.0))
    path = f"{tmp_path}/x.rsf"
    rsf.write(cube(spark, x, *axes).derive(cube(spark, x, *axes).df.where("i2 <> 3")), path)
    x[3] = 0
    assert np.allclose(np.fromfile(path + "@", "<f4").reshape(5, 7), x)
    assert np.allclose(matrix(rsf.read(spark, path)), x)
    rsf.convert(spark, path, f"{tmp_path}/big.rsf", "xdr_double")
    assert np.allclose(np.fromfile(f"{tmp_path}/big.rsf@", ">f8").reshape(5, 7), x)
    rsf.convert(spark, path, f"{tmp_path}/int.rsf", "native_int", truncate=True)
    assert (matrix(rsf.read(spark, f"{tmp_path}/int.rsf")) == np.trunc(x)).all()
    rsf.convert(spark, path, f"{tmp_path}/text.rsf", "ascii_float")
    assert np.allclose(matrix(rsf.read(spark, f"{tmp_path}/text.rsf")), x, rtol=1e-7)
    z = complex_cube(spark, x + 2j * x, *axes)
    rsf.write(z, f"{tmp_path}/z.rsf")
    assert np.allclose(np.fromfile(f"{tmp_path}/z.rsf@", "<c8").reshape(5, 7), x + 2j * x)
    back = rsf.read(spark, f"{tmp_path}/z.rsf")
    assert np.allclose(values(back), x + 2j * x) and back.meta.axes == axes
    assert rsf.disfil(back, 1) == f"0\t{x[0, 0]:.6g}{2 * x[0, 0]:+.6g}j\n# truncated: shown=1 total=35 max=1"
    rsf.copy(path, f"{tmp_path}/y.rsf")
    with pytest.raises(ValueError):
        rsf.copy(path, f"{tmp_path}/y.rsf")
    assert np.allclose(matrix(rsf.read(spark, f"{tmp_path}/y.rsf")), x)
    assert rsf.remove(f"{tmp_path}/y.rsf") == [f"{tmp_path}/y.rsf@", f"{tmp_path}/y.rsf"]
    with pytest.raises(ValueError):
        rsf.remove(f"{tmp_path}/y.rsf", dry_run=False)
    rsf.remove(f"{tmp_path}/y.rsf", dry_run=False, confirm=True)
    assert rsf.remove(f"{tmp_path}/y.rsf", missing_ok=True) == []
    table = spark.createDataFrame([(0, 300.0, 30.0), (1, 100.0, 10.0)], "trace long, offset double, cdp double")
    rsf.write_table(table, ["offset", "cdp"], f"{tmp_path}/t.rsf", "trace")
    assert sorted(rsf.read_table(spark, f"{tmp_path}/t.rsf").collect()) == sorted(table.collect())


def test_programs(spark, tmp_path):
    here = lambda name: f"{tmp_path}/{name}.rsf"
    run = lambda program, *words: commands.run(spark, program, list(words))
    run("spike", here("a"), "n1=12", "d1=0.5", "n2=3", "k1=4", "k2=2", "mag=2")
    run("scale", here("a"), here("b"), "dscale=3")
    run("add", here("a"), here("b"), here("c"))
    got = matrix(rsf.read(spark, here("c")))
    assert got[1, 3] == 8 and got.sum() == 8
    assert "true" in run("diff", here("c"), here("c")).lower() and "false" in run("diff", here("a"), here("c")).lower()
    run("window", here("c"), here("d"), "f1=2", "n1=4", "f2=1", "n2=1")
    assert rsf.read_header(here("d"))["n1"] == "4" and np.isclose(float(rsf.read_header(here("d"))["o1"]), 1.0)
    run("fft", here("a"), here("f"))
    run("ifft", here("f"), here("g"))
    run("real", here("g"), here("h"))
    assert np.allclose(matrix(rsf.read(spark, here("h"))), matrix(rsf.read(spark, here("a"))), atol=1e-6)
    run("put", here("a"), "label1=Depth")
    assert run("get", here("a"), "label1") == "label1=Depth" and "Depth" in run("info", here("a"))
    assert run("disfil", here("a"), "max=4").splitlines()[3] == "3\t0"
    (tmp_path / "par").write_text("dscale=2 # twice\n")
    run("scale", here("a"), here("i"), f"par={tmp_path}/par")
    assert matrix(rsf.read(spark, here("i"))).sum() == 4
    for program, words in (("agc", ["rect=2"]), ("vscan", ["vmin=1", "vmax=3", "dv=1"]), ("nmo", ["v=2"]), ("radon", ["np=3", "dp=0.1"]), ("mean", ["axis=1"]), ("welch", ["nperseg=8"])):
        run(program, here("a"), here("out"), *words)
        assert rsf.read(spark, here("out")).traces().df.count() >= 1
    table = spark.createDataFrame([(k, float(x), float(y), 1.0 + k) for k, (x, y) in enumerate([(2, 1), (0, 1), (1, 0)])], "trace long, x double, y double, value double")
    rsf.write_table(table, ["x", "y", "value"], here("t"), "trace")
    run("headersort", here("t"), here("u"), "key=x")
    assert [r["x"] for r in rsf.read_table(spark, here("u")).orderBy("trace").collect()] == [0, 1, 2]
    run("headermath", here("t"), here("w"), "output=x+2*y", "key=z")
    assert [r["z"] for r in rsf.read_table(spark, here("w")).orderBy("trace").collect()] == [4, 2, 1]
    run("intbin", here("t"), here("grid"), "keys=x,y,value", "n1=3", "n2=2")
    assert matrix(rsf.read(spark, here("grid"))).tolist() == [[0, 3, 0], [2, 0, 1]]
    assert "value" in run("headerattr", here("t"))
    run("headercut", here("a"), here("t"), here("cutout"), "key=y")
    assert (matrix(rsf.read(spark, here("cutout")))[:2] == 0).all()
    run("windowfunc", here("hann"), "n1=5")
    assert np.allclose(rsf.read(spark, here("hann")).df.first()["samples"], np.hanning(5))
    run("spike", here("m"), "n1=2", "n2=2", "k1=1", "k2=1", "mag=3")
    run("spike", here("n"), "n1=2", "n2=2", "k1=2", "k2=2", "mag=4")
    run("add", here("m"), here("n"), here("m2"))
    run("spike", here("rhs"), "n1=2", "k1=2", "mag=8")
    assert "converged=True" in run("conjgrad", here("m2"), here("rhs"), here("sol"), "mode=spd", "niter=4")
    assert np.allclose(rsf.read(spark, here("sol")).df.first()["samples"], [0, 2])
    run("spike", here("s"), "n1=12", "d1=0.004", "n2=3", "k1=4", "k2=2", "mag=2")
    run("segywrite", here("s"), here("sgy"))
    run("segyread", here("sgy"), here("back"))
    assert np.allclose(matrix(rsf.read(spark, here("back"))), matrix(rsf.read(spark, here("s"))))
    with pytest.raises(ValueError):
        run("segywrite", here("a"), here("far"))
    for words in (["scale", here("a"), here("x")], ["scale", here("a"), here("x"), "dscale=much"], ["nothing"]):
        with pytest.raises(ValueError):
            commands.run(spark, words[0], words[1:])


def test_comparisons_and_metrics(spark):
    x = np.random.default_rng(6).normal(size=(3, 64))
    c = cube(spark, x, Axis(64, 0, 0.004), Axis(3))
    y = x.copy()
    y[1, 5] += 0.5
    row = metrics.compare(c, cube(spark, y)).first()
    assert not row["same"] and row["different"] == 1 and np.isclose(row["max_abs"], 0.5)
    nan = np.where(x > 1, np.nan, x)
    assert metrics.compare(cube(spark, nan), cube(spark, nan)).first()["same"]
    assert not metrics.compare(c, cube(spark, x[:2])).first()["same"]
    assert metrics.compare_headers(c.meta, c.meta) == [] and len(metrics.compare_headers(c.meta, c.meta.with_axis(2, d=3.0))) == 1
    got = metrics.panel_metrics(c, (10, 30), (40, 60)).first()
    f, p = np.fft.rfftfreq(64, 0.004), np.abs(np.fft.rfft(x)) ** 2
    rms = lambda a: np.sqrt((a**2).mean())
    energy = (p * np.where((f > 0) & (f < 125), 2, 1) / 64)[:, (f >= 15) & (f <= 35)].sum(axis=1).mean()
    want = {"rms": rms(x), "signal_rms": rms(x[:, 10:30]), "noise_rms": rms(x[:, 40:60]), "snr_db": 20 * np.log10(rms(x[:, 10:30]) / rms(x[:, 40:60])), "dominant_frequency": f[p.argmax(axis=1)].mean(), "target_band_energy": energy}
    assert all(np.isclose(got[k], v) for k, v in want.items())


def test_geometry_and_fixtures(spark):
    table = metrics.source_receiver_table(spark, Axis(21, -500.0, 50.0))
    assert metrics.broken_geometry(table).count() == 0
    assert metrics.broken_geometry(table.withColumn("offset", F.when(F.col("trace") == 3, 0.0).otherwise(F.col("offset")))).count() == 1
    gather = metrics.hyperbolic_gather(spark, level=0.0)
    assert metrics.regular_offsets(gather, 21).d == 50.0
    with pytest.raises(ValueError):
        metrics.regular_offsets(metrics.channel_panel(spark))
    assert metrics.explicit_offsets(spark.createDataFrame([(0, 5.0), (1, 9.0)], "i2 long, offset double"), 2).count() == 2
    t = 0.004 * np.arange(512)
    trace = metrics.mixed_trace(spark, level=0.0).df.orderBy("i1").toPandas()["v"].to_numpy()
    assert np.allclose(trace, np.sin(2 * np.pi * 20 * t) + 0.25 * np.sin(2 * np.pi * 70 * t + 0.35) + 0.08 * (t - t.mean()))
    assert np.isclose(metrics.ricker_event(spark).df.where("i1 = 150").first()["v"], 1.0)
    noisy = metrics.plane_wave(spark).df.agg(F.count("*"), F.stddev("v")).first()
    assert noisy[0] == 512 * 24 and 0 < noisy[1] < 1
