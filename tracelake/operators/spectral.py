"""Spectra, filters and correlation: NumPy kernels on batches of whole traces."""

from __future__ import annotations

import numpy as np

from tracelake.cube import Axis, Cube


def window_weights(n: int, kind: str = "hann", periodic: bool = False) -> np.ndarray:
    m = n + 1 if periodic else n
    if m == 1:
        return np.ones(n)
    k = 2 * np.pi * np.arange(m) / (m - 1)
    table = {
        "hann": lambda: 0.5 - 0.5 * np.cos(k),
        "hamming": lambda: 0.54 - 0.46 * np.cos(k),
        "blackman": lambda: 0.42 - 0.5 * np.cos(k) + 0.08 * np.cos(2 * k),
        "bartlett": lambda: 1 - np.abs(2 * np.arange(m) / (m - 1) - 1),
        "boxcar": lambda: np.ones(m),
        "cosine": lambda: np.sin(np.pi * (np.arange(m) + 0.5) / m),
    }
    return table[kind]()[:n]


def firwin(taps: int, cutoff: float | tuple[float, float], fs: float, pass_zero: bool = True, kind: str = "hann") -> np.ndarray:
    """Windowed sinc low-, high-, band-pass or band-stop of unit gain at its reference frequency."""
    edges = np.atleast_1d(np.asarray(cutoff, float)) / (fs / 2)
    high_open = pass_zero == (len(edges) % 2 == 0)
    if taps % 2 == 0 and high_open:
        raise ValueError("an even number of taps has no gain at half the sampling rate")
    cuts = np.concatenate([[0.0] if pass_zero else [], edges, [1.0] if high_open else []]).reshape(-1, 2)
    m = np.arange(taps) - (taps - 1) / 2
    h = sum(b * np.sinc(b * m) - a * np.sinc(a * m) for a, b in cuts) * window_weights(taps, kind)
    a, b = cuts[0]
    at = 0.0 if a == 0 else 1.0 if b == 1 else (a + b) / 2
    return h / np.sum(h * np.cos(np.pi * m * at))


def rfft_parts(c: Cube) -> tuple[Cube, Cube]:
    """Real and imaginary parts of the one-sided transform along axis 1."""
    n, d = c.meta.axes[0].n, c.meta.axes[0].d
    first = Axis(n // 2 + 1, 0.0, 1 / (n * d), "Frequency", "Hz")
    return c.map_traces(lambda x: np.fft.rfft(x).real, first), c.map_traces(lambda x: np.fft.rfft(x).imag, first)


def power_spectrum(c: Cube) -> Cube:
    n, d = c.meta.axes[0].n, c.meta.axes[0].d
    return c.map_traces(lambda x: np.abs(np.fft.rfft(x)) ** 2, Axis(n // 2 + 1, 0.0, 1 / (n * d), "Frequency", "Hz"))


def _one_sided(p: np.ndarray, n: int) -> np.ndarray:
    p = p.copy()
    p[..., 1 : (n + 1) // 2] *= 2
    return p


def psd(c: Cube, kind: str = "hann", scaling: str = "density") -> Cube:
    n, d = c.meta.axes[0].n, c.meta.axes[0].d
    w = window_weights(n, kind)
    by = (w**2).sum() / d if scaling == "density" else w.sum() ** 2
    return c.map_traces(lambda x: _one_sided(np.abs(np.fft.rfft(x * w)) ** 2 / by, n), Axis(n // 2 + 1, 0.0, 1 / (n * d), "Frequency", "Hz"))


def welch(c: Cube, nperseg: int, noverlap: int | None = None, kind: str = "hann") -> Cube:
    d = c.meta.axes[0].d
    hop = nperseg - (nperseg // 2 if noverlap is None else noverlap)
    w = window_weights(nperseg, kind)

    def kernel(x: np.ndarray) -> np.ndarray:
        parts = np.lib.stride_tricks.sliding_window_view(x, nperseg, axis=1)[:, ::hop]
        return _one_sided(np.abs(np.fft.rfft(parts * w)) ** 2 * d / (w**2).sum(), nperseg).mean(axis=1)

    return c.map_traces(kernel, Axis(nperseg // 2 + 1, 0.0, 1 / (nperseg * d), "Frequency", "Hz"))


def convolve(c: Cube, kernel: np.ndarray, mode: str = "same") -> Cube:
    n, k, a = c.meta.axes[0].n, len(kernel), c.meta.axes[0]
    size = n + k - 1
    crop, keep = {"full": (0, size), "same": ((k - 1) // 2, n), "valid": (k - 1, n - k + 1)}[mode]
    m = 1 << (size - 1).bit_length()
    spectrum = np.fft.rfft(kernel, m)
    return c.map_traces(lambda x: np.fft.irfft(np.fft.rfft(x, m) * spectrum, m)[:, crop : crop + keep], Axis(keep, a.o + crop * a.d, a.d, a.label, a.unit))


def autocorrelate(c: Cube, lags: int) -> Cube:
    """Sums of x[i] x[i + lag], lag = 0 .. lags - 1."""
    n, d = c.meta.axes[0].n, c.meta.axes[0].d
    m = 1 << (2 * n - 1).bit_length()
    return c.map_traces(lambda x: np.fft.irfft(np.abs(np.fft.rfft(x, m)) ** 2, m)[:, :lags], Axis(lags, 0.0, d, "Lag"))


def fir_filter(c: Cube, taps: np.ndarray) -> Cube:
    return convolve(c, taps, "same")


def bandpass(c: Cube, low: float | None, high: float | None, fade: float = 0.0) -> Cube:
    """Frequency-domain gain of 1 from low to high with cosine flanks of ``fade`` Hz."""
    n, d = c.meta.axes[0].n, c.meta.axes[0].d
    f = np.fft.rfftfreq(n, d)
    g = np.ones(len(f))
    if low is not None:
        g *= np.clip((f - low) / fade + 1, 0, 1) if fade else f >= low
    if high is not None:
        g *= np.clip((high - f) / fade + 1, 0, 1) if fade else f <= high
    g = 0.5 - 0.5 * np.cos(np.pi * g)
    return c.map_traces(lambda x: np.fft.irfft(np.fft.rfft(x) * g, n))


def analytic(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * h)


def envelope(c: Cube) -> Cube:
    return c.map_traces(lambda x: np.abs(analytic(x)))


def hilbert(c: Cube) -> Cube:
    return c.map_traces(lambda x: analytic(x).imag)


def whiten(c: Cube, floor: float = 1e-6) -> Cube:
    n = c.meta.axes[0].n

    def kernel(x: np.ndarray) -> np.ndarray:
        s = np.fft.rfft(x)
        a = np.abs(s)
        return np.fft.irfft(s / np.maximum(a, np.maximum(floor * a.max(axis=1, keepdims=True), 1e-300)), n)

    return c.map_traces(kernel)


def frequency_attributes(c: Cube) -> Cube:
    """Dominant frequency, centroid and bandwidth of the power spectrum."""
    n, d = c.meta.axes[0].n, c.meta.axes[0].d
    f = np.fft.rfftfreq(n, d)

    def kernel(x: np.ndarray) -> np.ndarray:
        p = np.abs(np.fft.rfft(x)) ** 2
        total = np.maximum(p.sum(axis=1), 1e-300)
        centre = p @ f / total
        return np.stack([f[p.argmax(axis=1)], centre, np.sqrt(np.maximum(0, p @ f**2 / total - centre**2))], axis=1)

    return c.map_traces(kernel, Axis(3))


def dct(c: Cube, inverse: bool = False) -> Cube:
    """Orthonormal cosine transform of the second kind, or its inverse."""
    n = c.meta.axes[0].n
    k = np.arange(n)
    basis = np.cos(np.pi * (k[:, None] + 0.5) * k / n) * np.sqrt(2 / n) * np.where(k == 0, np.sqrt(0.5), 1)
    return c.map_traces(lambda x: x @ (basis.T if inverse else basis))


def spline(c: Cube, axis: Axis, fill: float = 0.0) -> Cube:
    """Natural cubic spline at the coordinates of ``axis``; ``fill`` outside."""
    a = c.meta.axes[0]
    at = (axis.o + axis.d * np.arange(axis.n) - a.o) / a.d
    inside = (at >= 0) & (at <= a.n - 1)
    k = np.clip(np.floor(at).astype(int), 0, max(0, a.n - 2))
    t = at - k
    # bends m: 0 at the ends, m[i - 1] + 4 m[i] + m[i + 1] = six times the second difference between; elimination factors are the same for all traces
    factor = np.zeros(a.n)
    for i in range(1, a.n - 1):
        factor[i] = 1 / (4 - factor[i - 1])

    def kernel(x: np.ndarray) -> np.ndarray:
        m = np.zeros_like(x)
        m[:, 1:-1] = 6 * (x[:, 2:] - 2 * x[:, 1:-1] + x[:, :-2])
        for i in range(1, a.n - 1):
            m[:, i] = (m[:, i] - m[:, i - 1]) * factor[i]
        for i in range(a.n - 3, 0, -1):
            m[:, i] -= factor[i] * m[:, i + 1]
        u = 1 - t
        got = u * x[:, k] + t * x[:, k + 1] + ((u**3 - u) * m[:, k] + (t**3 - t) * m[:, k + 1]) / 6
        return np.where(inside, got, fill)

    return c.map_traces(kernel, axis)
