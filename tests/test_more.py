"""Files, generators, pairs of panels and gathers against NumPy formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.cube import Axis, Cube, Meta
from tracelake.operators import cross, gathers, generators
from tracelake.operators.spectral import firwin, window_weights
from tracelake.plans.queries import QUERIES
from tracelake.sources import rsf

RNG = np.random.default_rng(3)


def cube(spark, values, axes=None):
    """From an array whose last dimension is axis 1."""
    axes = axes or tuple(Axis(n) for n in values.shape[::-1])
    keys = [f"i{k}" for k in range(2, values.ndim + 1)]
    rows = [(*[int(i) for i in at[::-1]], values[at].tolist()) for at in np.ndindex(values.shape[:-1])]
    return Cube(spark.createDataFrame(rows, ", ".join([f"{k} long" for k in keys] + ["samples array<double>"])), Meta(axes), "trace")


def array(c):
    shape = c.meta.shape[::-1]
    out = np.full(shape, np.nan)
    for r in c.long().df.toPandas().itertuples():
        out[tuple(getattr(r, f"i{k}") for k in range(c.rank, 0, -1))] = r.v
    return out


def cells(df, n1, n2):
    out = np.zeros((n2, n1))
    for r in df.toPandas().itertuples():
        out[r.i2, r.i1] = r.v
    return out


@pytest.mark.parametrize("kind", ["native_float", "native_double", "xdr_float", "xdr_int"])
def test_file_round_trip(spark, tmp_path, kind):
    values = RNG.integers(-50, 50, (3, 5, 7)).astype(float)
    axes = (Axis(7, 0.5, 0.004, "Time", "s"), Axis(5, -1, 2), Axis(3))
    path = str(tmp_path / "a.rsf")
    rsf.write(cube(spark, values, axes), path, kind, 4)
    back = rsf.read(spark, path)
    assert back.meta.axes == axes and np.array_equal(array(back), values)
    rsf.put(path, note="two words", d1=0.002)
    assert rsf.get(path, "note", "d1", "none") == ["two words", "0.002", None]
    with open(path + "@", "r+b") as f:
        f.truncate(8)
    with pytest.raises(ValueError):
        rsf.read(spark, path)


def test_absent_traces_are_written_as_zeros(spark, tmp_path):
    values = RNG.normal(size=(6, 4))
    c = cube(spark, values)
    path = str(tmp_path / "a.rsf")
    rsf.write(c.derive(c.df.where("i2 in (1, 4)")), path, "native_double", 3)
    values[[0, 2, 3, 5]] = 0
    assert np.array_equal(array(rsf.read(spark, path)), values)


def test_text_payload(spark, tmp_path):
    (tmp_path / "a.rsf").write_text('n1=3 n2=2 n1=2\nn2=3 data_format="ascii_float" in="a.txt"\n')
    (tmp_path / "a.txt").write_text("1 2\n3 4 5 6")
    assert np.array_equal(array(rsf.read(spark, str(tmp_path / "a.rsf"))), [[1, 2], [3, 4], [5, 6]])


def test_generators(spark):
    axes = (Axis(4), Axis(3))
    made = array(generators.spike(spark, axes, [(2, 3), (2, 3), (4, 1)], [1.0, 2.0, 5.0]))
    want = np.zeros((3, 4))
    want[2, 1], want[0, 3] = 3, 5
    assert np.array_equal(made, want)
    with pytest.raises(ValueError):
        generators.spike(spark, axes, [(0, 1)])
    flat = generators.spike(spark, (Axis(400), Axis(50)), [(1, 1)], [0.0])
    once, again = (array(generators.noise(flat.derive(flat.df.repartition(n)), 2.0, 1.0, 7)) for n in (1, 5))
    assert np.array_equal(once, again) and abs(once.mean() - 1) < 0.05 and abs(once.std() - 2) < 0.05
    even = array(generators.add_noise(flat, 0.5, kind="uniform"))
    assert even.min() >= -0.5 and even.max() <= 0.5
    t = np.arange(64) * 0.004
    s = (np.pi * 25 * (t - 0.1)) ** 2
    assert np.allclose(array(generators.ricker(spark, 25.0, Axis(64, 0, 0.004), 0.1)), (1 - 2 * s) * np.exp(-s))


def test_pairs(spark):
    a, b = RNG.normal(size=(2, 3, 32))
    time = (Axis(32, 0, 0.01), Axis(3))
    ca, cb = cube(spark, a, time), cube(spark, b, time)
    w = window_weights(8)
    fa, fb = (np.array([[np.fft.rfft(x[i : i + 8] * w) for i in range(0, 25, 4)] for x in y]) for y in (a, b))
    pa, pb, pab = (abs(fa) ** 2).mean(1), (abs(fb) ** 2).mean(1), (fa.conj() * fb).mean(1)
    twice = np.array([1, 2, 2, 2, 1])
    assert np.allclose(array(cross.coherence(ca, cb, 8)), abs(pab) ** 2 / pa / pb)
    assert np.allclose(array(cross.csd(ca, cb, 8, part="imag")), (pab * twice * 0.01 / (w**2).sum()).imag)
    assert np.allclose(array(cross.transfer(ca, cb, 8)), abs(pab / pa))
    assert np.allclose(array(cross.transfer(ca, cb, 8, method="H2", part="phase")), np.angle(pb / pab.conj()))
    assert np.allclose(array(cross.spectrogram(ca, 8)), abs(fa) ** 2 / w.sum() ** 2 * twice)
    zero = cube(spark, a * 0, time)
    assert not array(cross.coherence(ca, zero, 8)).any() and not array(cross.transfer(zero, cb, 8)).any()


def test_bands(spark):
    a = RNG.normal(size=(2, 40))
    c = cube(spark, a, (Axis(40, 0, 0.01), Axis(2)))
    f, s = np.fft.rfftfreq(40, 0.01), np.fft.rfft(a)
    parts = [np.fft.irfft(s * ((f >= lo) & (f <= hi)), 40) for lo, hi in ((0, 10), (10, 50))]
    assert np.allclose(array(cross.band_energy(c, [(0, 10), (10, 50)])), np.stack([np.sqrt((p**2).mean(1)) for p in parts], 1))
    assert np.allclose(array(cross.normalize_spectrum(c, "unit_max", 5, 30)), a / abs(s[:, (f >= 5) & (f <= 30)]).max(1)[:, None])
    h = firwin(7, 20.0, 100.0)
    padded = np.pad(a, ((0, 0), (18, 18)), "reflect")
    forth = np.array([np.convolve(x, h, "same") for x in padded])
    back = np.array([np.convolve(x[::-1], h, "same")[::-1] for x in forth])[:, 18:-18]
    assert np.allclose(array(cross.zero_phase(c, h)), back)
    bank = array(cross.filter_bank(c, [(5, 15), (20, 30)], 11))
    want = [[np.convolve(x, firwin(11, band, 100.0, False), "same") for x in a] for band in ((5, 15), (20, 30))]
    assert np.allclose(bank, want)


@pytest.mark.parametrize("positive", [True, False])
@pytest.mark.parametrize("r", [1, 2])
def test_resorting(spark, positive, r):
    cmp = RNG.normal(size=(5, 3, 2))
    shots = array(gathers.cmp2shot(cube(spark, cmp, (Axis(2), Axis(3, 0, float(r)), Axis(5, 0, 1.0))), positive))
    want = np.zeros((4 // r + 3, 3 * r, 2))
    for s, h, k in np.ndindex(len(want), 3, r):
        y = k + r * (s + h - 2) if positive else r * (s - h) - k
        if 0 <= y < 5:
            want[s, h * r + k] = cmp[y, h]
    assert np.array_equal(shots, want)
    shot = RNG.normal(size=(3, 4, 2))
    got = array(gathers.shot2cmp(cube(spark, shot, (Axis(2), Axis(4, 0, 1.0), Axis(3, 0, float(r)))), positive))
    want = np.zeros((3 * r + 3, -(-4 // r), 2))
    for y, j in np.ndindex(want.shape[:2]):
        h = y % r + j * r
        s = (y - h) // r if positive else (y + h) // r - 3 // r
        if h < 4 and 0 <= s < 3:
            want[y, j] = shot[s, h]
    assert np.array_equal(got, want)


def test_migration_and_modelling(spark):
    a = RNG.normal(size=(5, 16))
    c = cube(spark, a, (Axis(16, 0, 0.1), Axis(5, 0, 10.0)))
    for aperture, mean in ((None, False), (20.0, True)):
        image = np.zeros((5, 16))
        for x, k in np.ndindex(5, 16):
            live = 0
            for s in range(5):
                if aperture is None or abs(s - x) * 10 <= aperture:
                    p = np.hypot(k * 0.1, 2 * (s - x) * 10 / 50) / 0.1
                    j = int(np.floor(p))
                    live += j < 16
                    image[x, k] += (1 - p + j) * (a[s, j] if j < 16 else 0) + (p - j) * (a[s, j + 1] if j + 1 < 16 else 0)
            image[x, k] /= max(live, 1) if mean else 1
        assert np.allclose(cells(gathers.kirchhoff(c, 50.0, aperture, mean), 16, 5), image)
    offsets, want = [0.0, 3.0, -8.0], np.zeros((3, 16))
    for p, k, j in np.ndindex(5, 16, 3):
        at = k + p * 10.0 * 0.001 * offsets[j] / 0.1
        i = int(np.floor(at))
        for q, part in ((i, 1 - at + i), (i + 1, at - i)):
            if 0 <= q < 16:
                want[j, q] += a[p, k] * part
    slow = cube(spark, a, (Axis(16, 0, 0.1), Axis(5, 0, 0.01)))
    assert np.allclose(cells(gathers.radon_model(slow, offsets), 16, 3), want)
    back = array(gathers.inverse_nmo(c, F.lit(5.0), 20.0))
    t = np.arange(16) * 0.1
    square = t**2 - (10 / 20) ** 2
    want = [np.where(square >= 0, np.interp(np.sqrt(np.maximum(square, 0)), t, x), 0) for x in a]
    assert np.allclose(back, want)


def test_location(spark):
    x, z = Axis(11, 0, 10.0), Axis(6, 0, 20.0)
    rows = [(0.0, 0.0, float(r), 0.0, float(np.hypot(40, 60) + np.hypot(r - 40, 60)) / 1500, 1.0) for r in range(0, 100, 10)]
    picks = spark.createDataFrame(rows, "sx double, sz double, rx double, rz double, observed double, weight double")
    best = gathers.locate(picks, 1500.0, x, z).first()
    assert (best.ix, best.iz, best.x, best.z) == (4, 3, 40.0, 60.0) and best.objective < 1e-12
    assert gathers.locate(picks.where("rx < 0"), 1500.0, x, z).count() == 0


def test_bin_1d_covers_all_users(spark, tmp_path):
    rows = [(-3, 1.0), (0, 2.0), (4, 4.0), (200, 5.0), (1499, 6.0), (None, 7.0)]
    spark.createDataFrame(rows, "user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.i1: r.v for r in QUERIES["bin_1d"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(-1, 300))
    assert {k: v for k, v in got.items() if v} == {-1: 1.0, 0: 3.0, 40: 5.0, 299: 6.0}
