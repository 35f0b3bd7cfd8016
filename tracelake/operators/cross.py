"""Spectra of pairs of panels, short-time spectra and filters by band, on batches of whole traces."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import functions as F

from tracelake.cube import Axis, Cube
from tracelake.operators.spectral import firwin, window_weights

#: How a complex result becomes samples.
PARTS: dict[str, Callable] = {"real": np.real, "imag": np.imag, "abs": np.abs, "phase": np.angle}


def pair(a: Cube, b: Cube, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], first: Axis) -> Cube:
    """A kernel of the traces that two cubes hold at the same place."""
    if a.meta.shape != b.meta.shape:
        raise ValueError("the cubes differ in shape")
    left, n = a.traces(), a.meta.axes[0].n
    both = left.beside(b).select(*(left.keys[1:] or ["i2"]), F.concat("samples", "_other").alias("samples"))
    return left.derive(both).map_traces(lambda x: kernel(x[:, :n], x[:, n:]), first)


def _frequencies(n: int, d: float) -> Axis:
    return Axis(n // 2 + 1, 0.0, 1 / (n * d), "Frequency", "Hz")


def _doubling(n: int) -> np.ndarray:
    k = np.arange(n // 2 + 1)
    return np.where((k == 0) | (2 * k == n), 1.0, 2.0)


def _segments(n: int, nperseg: int | None, noverlap: int | None) -> tuple[int, int]:
    length = min(n, nperseg or n)
    overlap = length // 2 if noverlap is None else noverlap
    if not 0 <= overlap < length:
        raise ValueError("segments overlap by less than their length")
    return length, length - overlap


def _short_time(x: np.ndarray, length: int, hop: int, weights: np.ndarray) -> np.ndarray:
    return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, length, axis=1)[:, ::hop] * weights)


def _moments(length: int, hop: int, weights: np.ndarray):
    """Segment means of |A|^2, |B|^2 and conj(A) B."""

    def run(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fa, fb = _short_time(a, length, hop, weights), _short_time(b, length, hop, weights)
        return (np.abs(fa) ** 2).mean(1), (np.abs(fb) ** 2).mean(1), (fa.conj() * fb).mean(1)

    return run


def csd(a: Cube, b: Cube, nperseg: int | None = None, noverlap: int | None = None, kind: str = "hann", scaling: str = "density", part: str = "real") -> Cube:
    """One-sided conj(A) B, of the whole trace or the mean of its segments."""
    d = a.meta.axes[0].d
    length, hop = _segments(a.meta.axes[0].n, nperseg, noverlap)
    w = window_weights(length, kind)
    by = (w**2).sum() / d if scaling == "density" else w.sum() ** 2
    moments = _moments(length, hop, w)
    return pair(a, b, lambda x, y: PARTS[part](moments(x, y)[2] * _doubling(length) / by), _frequencies(length, d))


def coherence(a: Cube, b: Cube, nperseg: int, noverlap: int | None = None, kind: str = "hann", eps: float = 1e-12) -> Cube:
    """|Pab|^2 / (Paa Pbb) in 0 .. 1; 0 where the product is eps or less."""
    length, hop = _segments(a.meta.axes[0].n, nperseg, noverlap)
    moments = _moments(length, hop, window_weights(length, kind))

    def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        pa, pb, pab = moments(x, y)
        return np.clip(np.where(pa * pb > eps, np.abs(pab) ** 2 / np.maximum(pa * pb, eps), 0.0), 0, 1)

    return pair(a, b, kernel, _frequencies(length, a.meta.axes[0].d))


def transfer(a: Cube, b: Cube, nperseg: int, noverlap: int | None = None, kind: str = "hann", method: str = "H1", eps: float = 1e-12, part: str = "abs") -> Cube:
    """H1 = Pab / Paa or H2 = Pbb / conj(Pab); 0 where the denominator is eps or less in size."""
    if method not in ("H1", "H2"):
        raise ValueError("method is H1 or H2")
    length, hop = _segments(a.meta.axes[0].n, nperseg, noverlap)
    moments = _moments(length, hop, window_weights(length, kind))

    def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        pa, pb, pab = moments(x, y)
        above, below = (pab, pa) if method == "H1" else (pb, pab.conj())
        small = np.abs(below) <= eps
        return PARTS[part](np.where(small, 0, above / np.where(small, 1, below)))

    return pair(a, b, kernel, _frequencies(length, a.meta.axes[0].d))


def spectrogram(c: Cube, nperseg: int = 64, noverlap: int | None = None, kind: str = "hann", mode: str = "power") -> Cube:
    """Short-time spectra: axis 1 frequency, axis 2 frame, then the other axes; a tail shorter than a segment is left out."""
    a = c.meta.axes[0]
    length, hop = _segments(a.n, nperseg, noverlap)
    w, bins = window_weights(length, kind), length // 2 + 1
    power = 2 if mode == "power" else 1

    def kernel(x: np.ndarray) -> np.ndarray:
        return (np.abs(_short_time(x, length, hop, w)) ** power / w.sum() ** power * _doubling(length)).reshape(len(x), -1)

    frames = (a.n - length) // hop + 1
    flat = c.map_traces(kernel, Axis(bins * frames)).long()
    rest = [F.col(k).alias(f"i{int(k[1:]) + 1}") for k in flat.keys[1:]]
    df = flat.df.select((F.col("i1") % bins).alias("i1"), F.floor(F.col("i1") / bins).cast("long").alias("i2"), *rest, "v")
    axes = (_frequencies(length, a.d), Axis(frames, a.o + (length - 1) / 2 * a.d, hop * a.d, a.label, a.unit), *c.meta.axes[1:])
    return Cube(df, type(c.meta)(axes, c.meta.attrs), "long")


def normalize_spectrum(c: Cube, mode: str = "unit_rms", low: float | None = None, high: float | None = None, eps: float = 1e-12) -> Cube:
    """Traces divided by the RMS or the largest amplitude of their spectrum within a closed band."""
    a = c.meta.axes[0]
    f = np.fft.rfftfreq(a.n, a.d)
    band = (f >= (f[0] if low is None else low)) & (f <= (f[-1] if high is None else high))
    size = (lambda s: np.sqrt((s * s).mean(1))) if mode == "unit_rms" else (lambda s: s.max(1))
    return c.map_traces(lambda x: x / np.maximum(size(np.abs(np.fft.rfft(x))[:, band]), eps)[:, None])


def band_energy(c: Cube, bands: list[tuple[float, float]], mode: str = "rms") -> Cube:
    """Energy, mean power or RMS of every trace within closed frequency bands (axis 1: the band), by Parseval's sum."""
    a = c.meta.axes[0]
    f = np.fft.rfftfreq(a.n, a.d)
    inside = np.array([(f >= low) & (f <= high) for low, high in bands])
    if not inside.any(1).all():
        raise ValueError("a band holds no frequency")

    def kernel(x: np.ndarray) -> np.ndarray:
        energy = (np.abs(np.fft.rfft(x)) ** 2 * _doubling(a.n) / a.n) @ inside.T
        return energy if mode == "energy" else energy / a.n if mode == "power" else np.sqrt(energy / a.n)

    return c.map_traces(kernel, Axis(len(bands), label="Band"))


def _centred(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    size = x.shape[1] + len(taps) - 1
    full = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(taps, size), size)
    start = (len(taps) - 1) // 2
    return full[:, start : start + x.shape[1]]


def zero_phase(c: Cube, taps: np.ndarray, pad: bool = True) -> Cube:
    """Filtered forwards and backwards, with up to 3 (taps - 1) reflected samples at both ends."""
    n = c.meta.axes[0].n
    if len(taps) > n:
        raise ValueError("more taps than samples")
    more = min(3 * (len(taps) - 1), n - 1) if pad else 0

    def kernel(x: np.ndarray) -> np.ndarray:
        once = _centred(np.pad(x, ((0, 0), (more, more)), "reflect"), taps)
        return _centred(once[:, ::-1], taps)[:, ::-1][:, more : more + n]

    return c.map_traces(kernel)


def filter_bank(c: Cube, bands: list[tuple[float, float]], taps: int = 101, kind: str = "hann") -> Cube:
    """A band-pass filtered copy for each band, the band being a new last axis."""
    own, a = c.traces(), c.meta.axes[0]
    filters = [firwin(taps, band, 1 / a.d, False, kind) for band in bands]
    flat = own.map_traces(lambda x: np.concatenate([_centred(x, h) for h in filters], axis=1), Axis(a.n * len(bands))).long()
    df = flat.df.select((F.col("i1") % a.n).alias("i1"), *flat.keys[1:], F.floor(F.col("i1") / a.n).cast("long").alias(f"i{c.rank + 1}"), "v")
    return Cube(df, type(c.meta)((*c.meta.axes, Axis(len(bands), label="Band")), c.meta.attrs), "long")


def frequency_response(taps: np.ndarray, fs: float = 2.0, nfft: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and complex response of a filter; both are of the filter's size, not the data's."""
    return np.fft.rfftfreq(nfft, 1 / fs), np.fft.rfft(taps, nfft)
