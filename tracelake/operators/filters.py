"""Further frequency-domain filters and correlations, and transforms over two axes.

Two-axis transforms are separable: a kernel along axis 1, then exchanges of
bounded groups of traces along axis 2 (see ``transforms``), so no task holds a
panel, nor a line of axis 2.  Absent traces count as zeros.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.cube import Axis, Cube
from tracelake.operators import complexes, transforms
from tracelake.operators.scatter import beside
from tracelake.operators.spectral import analytic, convolve


def _gain(c: Cube, gain: Callable[[np.ndarray], np.ndarray]) -> Cube:
    n = c.meta.axes[0].n
    g = gain(np.fft.rfftfreq(n, c.meta.axes[0].d))
    return c.map_traces(lambda x: np.fft.irfft(np.fft.rfft(x) * g, n))


def _flank(position: np.ndarray) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(np.pi * np.clip(position, 0, 1))


def bandstop(c: Cube, low: float, high: float, fade: float = 0.0) -> Cube:
    """One minus the band-pass gain of the same edges."""
    if not 0 <= low < high:
        raise ValueError("edges")
    passed = lambda f: _flank((f - low) / fade + 1) * _flank((high - f) / fade + 1) if fade else ((f >= low) & (f <= high)).astype(float)
    return _gain(c, lambda f: 1 - passed(f))


def notch(c: Cube, f0: float, width: float | None = None, q: float | None = None, fade: float = 0.0) -> Cube:
    """Band-stop of ``width`` (or f0 / q) round f0."""
    if (width is None) == (q is None):
        raise ValueError("width or q")
    w = f0 / q if width is None else width
    return bandstop(c, max(0.0, f0 - w / 2), f0 + w / 2, fade)


def trapezoid(c: Cube, corners: tuple[float, float, float, float]) -> Cube:
    """Gain 0, sin^2 up, 1, sin^2 down, 0 between four corners; upper ends are open."""
    a, b, e, g = corners
    if not 0 <= a <= b <= e <= g:
        raise ValueError("corners ascend")

    def gain(f: np.ndarray) -> np.ndarray:
        up = _flank((f - a) / (b - a)) if b > a else np.zeros_like(f)
        down = _flank((g - f) / (g - e)) if g > e else np.zeros_like(f)
        return np.select([(f >= a) & (f < b), (f >= b) & (f < e), (f >= e) & (f < g)], [up, 1.0, down], 0.0)

    return _gain(c, gain)


def half_integral(c: Cube, differentiate: bool = False, adjoint: bool = False, rho: float | None = None) -> Cube:
    """Half-order integral or derivative: gain omega^-1/2 or omega^1/2 with a phase of 45 degrees, mean removed."""
    n = c.meta.axes[0].n
    if n < 2:
        raise ValueError("two samples or more")
    rho = 1 - 1 / n if rho is None else rho
    if not rho > 0:
        raise ValueError("rho is positive")
    omega = np.maximum(2 * np.pi * np.fft.rfftfreq(n), max(1 - min(rho, 0.999999999), np.finfo(float).eps))
    turn = (1 if adjoint else -1) * (-1 if differentiate else 1)
    g = omega ** (0.5 if differentiate else -0.5) * np.exp(0.25j * np.pi * turn)
    g[0] = 0
    return c.map_traces(lambda x: np.fft.irfft(np.fft.rfft(x) * g, n))


def circular_convolve(c: Cube, taps: np.ndarray) -> Cube:
    n = c.meta.axes[0].n
    if len(taps) > n:
        raise ValueError("no more taps than samples")
    g = np.fft.rfft(np.asarray(taps, float), n)
    return c.map_traces(lambda x: np.fft.irfft(np.fft.rfft(x) * g, n))


def correlate(c: Cube, taps: np.ndarray, mode: str = "same") -> Cube:
    """Correlation of every trace with one short trace."""
    return convolve(c, np.asarray(taps, float)[::-1], mode)


def _correlation(x: np.ndarray, y: np.ndarray, mode: str) -> np.ndarray:
    n, size = x.shape[1], x.shape[1] + y.shape[1] - 1
    m = 1 << (size - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(x, m) * np.fft.rfft(y[:, ::-1], m), m)[:, :size]
    first = (size - n) // 2 if mode == "same" else 0
    return full[:, first : first + n] if mode == "same" else full


def trace_correlation(c: Cube, other: Cube, mode: str = "full", envelopes: bool = False, normalize: bool = False) -> Cube:
    """Correlation of the traces of two cubes, or of their envelopes; normalised by the root of both energies."""
    if mode not in ("full", "same"):
        raise ValueError("mode is full or same")
    a, b = c.meta.axes[0], other.meta.axes[0]
    size = a.n if mode == "same" else a.n + b.n - 1
    first = (b.n - 1) // 2 if mode == "same" else 0

    def kernel(both: np.ndarray) -> np.ndarray:
        x, y = both[:, : a.n], both[:, a.n :]
        if envelopes:
            x, y = np.abs(analytic(x)), np.abs(analytic(y))
        got = _correlation(x, y, mode)
        if normalize:
            energy = np.sqrt((x**2).sum(axis=1) * (y**2).sum(axis=1))[:, None]
            got = np.divide(got, energy, out=np.zeros_like(got), where=energy > 0)
        return got

    return beside(c, other).map_traces(kernel, Axis(size, a.o - b.o - (b.n - 1 - first) * a.d, a.d, "Lag"))


# two axes
def fk_spectrum(c: Cube) -> Cube:
    """Amplitudes over centred frequency (axis 1) and wavenumber (axis 2)."""
    a, b = c.meta.axes[:2]
    got = complexes.modulus(complexes.fft(complexes.fft(c, 1), 2))
    return replace(got, meta=replace(got.meta, axes=(_centred(a, "Frequency", "Hz"), _centred(b, "Wavenumber", ""), *c.meta.axes[2:]), attrs=c.meta.attrs))


def _centred(a: Axis, label: str, unit: str) -> Axis:
    f = np.fft.fftshift(np.fft.fftfreq(a.n, a.d))
    return Axis(a.n, float(f[0]), float(1 / (a.n * a.d)), label, unit)


def fk_filter(c: Cube, low: float | None = None, high: float | None = None, taper: float = 0.0, reject: bool = False) -> Cube:
    """Keeps apparent velocities |f| / |k| from low to high, with cosine edges ``taper`` wide outside."""
    if low is None and high is None or low is not None and high is not None and low > high:
        raise ValueError("low or high, in order")
    a, b = c.meta.axes[:2]
    k = F.abs(F.lit(float(-(b.n // 2))) + F.col("i2")) / (b.n * b.d)

    def weight(i: Column) -> Column:
        f = F.abs(F.lit(float(-(a.n // 2))) + i) / (a.n * a.d)
        speed = F.when((k == 0) & (f == 0), 0.0).when(k == 0, float("inf")).otherwise(F.try_divide(f, k))
        w = F.lit(1.0)
        if low is not None and (low or taper):
            stop = max(0.0, low - taper)
            ramp = 0.5 * (1 - F.cos(np.pi * (speed - stop) / (low - stop))) if low > stop else F.lit(0.0)
            w = w * F.when(speed >= low, 1.0).when(speed > stop, ramp).otherwise(0.0)
        if high is not None:
            ramp = 0.5 * (1 + F.cos(np.pi * (speed - high) / taper)) if taper else F.lit(0.0)
            w = w * F.when(speed <= high, 1.0).when(speed < high + taper, ramp).otherwise(0.0)
        return 1 - w if reject else w

    spectrum = complexes.fft(complexes.fft(c, 1), 2)
    weighted = spectrum.df.withColumn("_w", F.transform("re", lambda v, i: weight(i)))
    by = lambda name: F.zip_with(name, "_w", lambda v, w: v * w).alias(name)
    kept = replace(spectrum, df=weighted.select(*spectrum.keys, by("re"), by("im")))
    out = complexes.real(complexes.ifft(complexes.ifft(kept, 2), 1))
    return Cube(out.df, c.meta, "trace")


def spectra2(c: Cube, power: bool = False) -> Cube:
    """Amplitude (or power) over frequency and centred wavenumber, divided by sqrt(n1 n2)."""
    a, b = c.meta.axes[:2]
    half = complexes.rfft(c, 1)
    by = lambda name: F.transform(name, lambda v: F.when(F.col("i2") % 2 == 1, -v).otherwise(v))
    df = transforms.along(half.df.withColumns({"re": by("re"), "im": by("im")}), half.keys, 2, b.n)
    size = (a.n * b.n) ** 0.5
    got = complexes.modulus(replace(half, df=df)).map(lambda v: v / size * (v / size) if power else v / size)
    axes = (Axis(a.n // 2 + 1, 0.0, 1 / (a.n * a.d), "Frequency", "Hz"), _centred(b, "Wavenumber", ""), *c.meta.axes[2:])
    return replace(got, meta=replace(got.meta, axes=axes, attrs=c.meta.attrs))
