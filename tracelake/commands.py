"""Programs on dataset files: ``python -m tracelake.commands PROGRAM input output key=value ..``.

A program reads one or more datasets, applies one operator as a Spark job and
writes a dataset, or prints a line of numbers.  ``par=file`` takes more
parameters from a file; of a key given twice the last value counts.
"""

from __future__ import annotations

import shlex
import sys
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.cube import Axis, Cube, grid
from tracelake.operators import aggregate, complexes, cross, filters, gathers, generators, headers, metrics, modelling, neighbour, pointwise, resample, reshape, scatter, solvers, spectral
from tracelake.sources import rsf, segy


class Parameters:
    """key=value words and positional ones."""

    TRUE, FALSE = {"y", "yes", "true", "t", "1", "on"}, {"n", "no", "false", "f", "0", "off"}

    def __init__(self, words: list[str]):
        self.values: dict[str, str] = {}
        self.files: list[str] = []
        for word in words:
            key, equals, value = word.partition("=")
            if not equals:
                self.files.append(word)
            elif key == "par":
                system, name = rsf._open(value)
                with system.open_input_stream(name) as f:
                    more = Parameters(shlex.split(f.read().decode(), comments=True))
                self.values |= more.values
            else:
                self.values[key] = value

    def _get(self, key: str, default: object, cast: Callable[[str], object]):
        if key not in self.values:
            if default is ...:
                raise ValueError(f"{key}= is needed")
            return default
        try:
            return cast(self.values[key])
        except (ValueError, KeyError) as e:
            raise ValueError(f"{key}={self.values[key]} is not understood") from e

    def int(self, key: str, default=...):
        return self._get(key, default, int)

    def float(self, key: str, default=...):
        return self._get(key, default, float)

    def text(self, key: str, default=...):
        return self._get(key, default, str)

    def bool(self, key: str, default=...):
        def cast(word: str) -> bool:
            if word.lower() in self.TRUE:
                return True
            if word.lower() in self.FALSE:
                return False
            raise ValueError(word)

        return self._get(key, default, cast)

    def floats(self, key: str, default=...):
        return self._get(key, default, lambda s: [float(x) for x in s.split(",")])

    def ints(self, key: str, default=...):
        return self._get(key, default, lambda s: [int(x) for x in s.split(",")])

    def axis(self, k: int, like: Axis | None = None) -> Axis:
        """n#, o#, d#, label# and unit#, those of ``like`` where they are absent."""
        like = like or Axis(self.int(f"n{k}"))
        return Axis(self.int(f"n{k}", like.n), self.float(f"o{k}", like.o), self.float(f"d{k}", like.d), self.text(f"label{k}", like.label), self.text(f"unit{k}", like.unit))


def _axes(p: Parameters):
    out = [p.axis(1)]
    while f"n{len(out) + 1}" in p.values:
        out.append(p.axis(len(out) + 1))
    return tuple(out)


def _offset(c: Cube):
    return c.coordinate(2)


def _with(c: Cube, df: DataFrame, **axes: Axis) -> Cube:
    """(i1, i2, v) of an operator as a cube with new axes."""
    made = list(c.meta.axes[:2])
    for k, a in axes.items():
        made[int(k[1:]) - 1] = a
    return Cube(df.select("i1", "i2", "v"), replace(c.meta, axes=tuple(made)))


def _velocities(p: Parameters) -> list[float]:
    low, high, step = p.float("vmin"), p.float("vmax"), p.float("dv")
    return [low + step * k for k in range(int((high - low) / step + 0.5) + 1)]


def _omits(p: Parameters) -> bool:
    policy = p.text("nan_policy", "propagate")
    if policy not in ("propagate", "omit"):
        raise ValueError("nan_policy is propagate or omit")
    return policy == "omit"


def _slopes(p: Parameters) -> Axis:
    return Axis(p.int("np"), p.float("p0", 0.0), p.float("dp", 1.0), "Slope")


def _vscan(c: Cube, p: Parameters) -> Cube:
    speeds = _velocities(p)
    found = resample.semblance(c.traces(), _offset(c.traces()), F.lit(0), speeds, p.bool("half", True), p.float("h0", 0.0), p.float("str", 0.5), p.int("smooth", 0))
    return _with(c, found, i2=Axis(len(speeds), speeds[0], p.float("dv"), "Velocity"))


def _radon(c: Cube, p: Parameters) -> Cube:
    a = _slopes(p)
    own = c.traces()
    found = resample.radon(own, _offset(own), [a.o + a.d * k for k in range(a.n)], parabolic=p.bool("parab", False), x0=p.float("x0", 1.0))
    return _with(c, found, i2=a)


def _iradon(c: Cube, p: Parameters) -> Cube:
    a = Axis(p.int("nx"), p.float("ox", 0.0), p.float("dx", 1.0), "Offset")
    return _with(c, gathers.radon_model(c, [a.o + a.d * k for k in range(a.n)], p.bool("parab", False), p.float("x0", 1.0)), i2=a)


def _window(c: Cube, p: Parameters) -> Cube:
    for k, a in enumerate(c.meta.axes, 1):
        f, j = p.int(f"f{k}", 0), p.int(f"j{k}", 1)
        if {f"f{k}", f"j{k}", f"n{k}"} & p.values.keys():
            c = reshape.window(c, k, f, p.int(f"n{k}", -(-(a.n - f) // j)), j)
    return c


def _pad(c: Cube, p: Parameters) -> Cube:
    for k in range(1, c.rank + 1):
        c = reshape.pad(c, k, p.int(f"beg{k}", 0), p.int(f"end{k}", 0), p.float("value", 0.0))
    return c


def _taps(p: Parameters):
    import numpy as np

    return np.array(p.floats("taps"))


def _pairs(p: Parameters, key: str) -> list[tuple[float, float]]:
    """a:b,a:b,.."""
    return p._get(key, ..., lambda s: [tuple(map(float, x.split(":"))) for x in s.split(",")])


def _migrated(c: Cube, p: Parameters) -> Cube:
    return _with(c, gathers.kirchhoff(c, p.float("v"), p.float("aperture", None), p.bool("normalize", False)))


def _vector(spark: SparkSession, values, axis: Axis) -> Cube:
    """A short trace that the parameters give."""
    rows = spark.createDataFrame([(0, [float(v) for v in values])], "i2 long, samples array<double>")
    return Cube(rows, rsf.Meta((axis,)), "trace")


def _fir(p: Parameters):
    cutoff = p.floats("cutoff")
    return spectral.firwin(p.int("taps"), cutoff[0] if len(cutoff) == 1 else tuple(cutoff), p.float("fs"), p.bool("pass_zero", True), p.text("window", "hann"))


def _solved(spark: SparkSession, p: Parameters) -> str:
    """matrix and right side in, solution out: dense matrices, axis 1 being columns."""
    m, b = (rsf.read(spark, f).traces() for f in p.files[:2])
    columns, rows = m.meta.axes[0].n, m.meta.leftsize(1)
    entries = m.df.select(F.col("i2").alias("row"), F.posexplode("samples").alias("col", "value")).withColumn("col", F.col("col").cast("long"))
    right = b.df.select(F.posexplode("samples").alias("i", "v")).withColumn("i", F.col("i").cast("long"))
    solve = {"spd": solvers.conjugate_gradient, "normal": solvers.cgnr, "cgls": solvers.cgls, "lsqr": solvers.lsqr}[p.text("mode", "normal")]
    found = solve(solvers.Matrix(entries, rows, columns), right, None, p.int("niter", 10), p.float("tol", 1e-6), p.float("damp", 0.0))
    rsf.write(Cube(found.x.select(F.col("i").alias("i1"), "v"), rsf.Meta((Axis(columns),))), p.files[2])
    return f"iterations={found.iterations} converged={found.converged}"


def _complex_entries(c: complexes.ComplexCube) -> tuple[DataFrame, int, int]:
    """(row, col, re, im) of a dense matrix whose axis 1 is columns."""
    pairs = c.df.select(F.col("i2").alias("row"), F.posexplode(F.arrays_zip("re", "im")).alias("col", "z"))
    return pairs.select("row", F.col("col").cast("long").alias("col"), "z.re", "z.im"), c.meta.leftsize(1), c.meta.axes[0].n


def _solved_complex(spark: SparkSession, p: Parameters) -> str:
    """Complex matrix and right side in, solution out; mode hermitian or normal."""
    entries, _, columns = _complex_entries(rsf.read(spark, p.files[0]))
    right = rsf.read(spark, p.files[1]).long().select(F.col("i1").alias("i"), "re", "im")
    found = complexes.complex_conjugate_gradient(entries, right, columns, None, p.int("niter", 10), p.float("tol", 1e-6), p.float("damp", 0.0), p.text("mode", "normal"))
    sorted_parts = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("i", name))), lambda z: z[name]).alias(name)
    every = spark.range(columns).withColumnRenamed("id", "i").join(found.x, "i", "left").fillna(0.0)
    rsf.write(complexes.ComplexCube(every.agg(sorted_parts("re"), sorted_parts("im")).select(F.lit(0).cast("long").alias("i2"), "re", "im"), rsf.Meta((Axis(columns),))), p.files[2])
    return f"iterations={found.iterations} converged={found.converged}"


def _dot_tested(spark: SparkSession, p: Parameters, complex_: bool) -> str:
    """Whether a matrix and its adjoint agree on drawn vectors; op=identity n=.. needs no matrix."""
    if p.text("op", "matrix") == "identity":
        n = p.int("n")
        a = solvers.identity(2 * n if complex_ else n)
    elif complex_:
        a = complexes.complex_matrix(*_complex_entries(rsf.read(spark, p.files[0])))
    else:
        m = rsf.read(spark, p.files[0]).traces()
        entries = m.df.select(F.col("i2").alias("row"), F.posexplode("samples").alias("col", "value")).withColumn("col", F.col("col").cast("long"))
        a = solvers.Matrix(entries, m.meta.leftsize(1), m.meta.axes[0].n)
    left, right, agree = solvers.dot_test(spark, a, p.int("seed", 0), p.float("rtol", 1e-5), p.float("atol", 1e-6))
    return f"forward={left!r} adjoint={right!r} passed={agree}"


def _shot(c: Cube, p: Parameters) -> Cube:
    """Traces at receivers rx=.. rz=.. (indices) of a shot at sx=, sz= over a velocity model."""
    spark = c.df.sparkSession
    shot = spark.createDataFrame([(0, p.int("sx"), p.int("sz"), p.ints("rx"), p.ints("rz"))], "shot long, sx int, sz int, rx array<int>, rz array<int>")
    time = Axis(p.int("nt"), 0.0, p.float("dt"), "Time", "s")
    return Cube(modelling.acoustic_survey(shot, c, time, p.float("frequency", 25.0)).select("i2", "samples"), rsf.Meta((time, Axis(len(p.ints("rx")), label="Receiver"))), "trace")


def _columns(p: Parameters, k: int) -> list:
    return [F.col(x) for x in p.text("keys").split(",")][:k]


#: Header tables: a table in, a table or a grid out.
def _sorted(df: DataFrame, p: Parameters) -> DataFrame:
    return headers.sort(df, p.text("key"), "trace", p.bool("reverse", False)).withColumn("trace", F.col("position")).drop("position")


TABLES: dict[str, Callable[[DataFrame, Parameters], DataFrame]] = {
    "headersort": _sorted,
    "headermath": lambda df, p: headers.math(df, p.text("output"), p.text("key")),
    "headerattr": lambda df, p: headers.attributes(df, [c for c in df.columns if c != "trace"]),
    "bin": lambda df, p: aggregate.bin_2d(df, *_columns(p, 3), (p.axis(1), p.axis(2)), p.text("statistic", "mean"), p.float("fill", 0.0)),
    "fold": lambda df, p: aggregate.fold(df, _columns(p, 3), (p.axis(1), p.axis(2), p.axis(3))),
    "intbin": lambda df, p: headers.intbin(df, *_columns(p, 3), F.col("trace"), (p.axis(1), p.axis(2))),
    "intbin3": lambda df, p: headers.intbin3(df, *_columns(p, 4), F.col("trace"), (p.axis(1), p.axis(2), p.axis(3))),
    "linefit": lambda df, p: aggregate.linefit(df, *_columns(p, 2), p.axis(1)),
}


def _binned(spark: SparkSession, program: str, p: Parameters) -> str:
    """intbin, intbin3 with head=: traces of the dataset by keys of the table, which are numbered from 0."""
    table = rsf.read_table(spark, p.text("head"))
    names = [c for c in table.columns if c != "trace"]
    letters = "xyz"[: 3 if program == "intbin3" else 2]
    places = [p.int(f"{x}key", k) for k, x in enumerate(letters)]
    if not all(0 <= k < len(names) for k in places):
        raise ValueError(f"the table has {len(names)} keys")
    bounds = [(p.int(f"{x}min", None), p.int(f"{x}max", None)) for x in letters]
    rsf.write(headers.bin_traces(rsf.read(spark, p.files[0]), table, [names[k] for k in places], bounds), p.files[1])
    return p.files[1]


def _on_table(spark: SparkSession, program: str, p: Parameters) -> str:
    """A table stays a table (trace and keys); a grid (i1, .., v) becomes a dataset; anything else is said."""
    if "head" in p.values and program in ("intbin", "intbin3"):
        return _binned(spark, program, p)
    df = TABLES[program](rsf.read_table(spark, p.files[0]), p)
    if "trace" in df.columns:
        rsf.write_table(df, [c for c in df.columns if c != "trace"], p.files[1], "trace")
        return p.files[1]
    if "i1" in df.columns:
        keys = [c for c in df.columns if c != "v"]
        rsf.write(Cube(df.withColumn("v", F.col("v").cast("double")), rsf.Meta(tuple(p.axis(k) for k in range(1, len(keys) + 1)))), p.files[1])
        return p.files[1]
    return _table(df)


def _masked(c: Cube, table: DataFrame, p: Parameters, name: str) -> DataFrame:
    return table.select(F.col("trace").alias("i"), (F.col(p.text("key")) != 0).alias(name))


#: One dataset in, one out.
ONE: dict[str, Callable[[Cube, Parameters], Cube]] = {
    "abs": lambda c, p: pointwise.absolute(c),
    "ai2refl": lambda c, p: neighbour.reflectivity(c, p.float("eps", 1e-7)),
    "agc": lambda c, p: neighbour.agc(c, p.float("rect"), p.int("axis", 1)),
    "autocorr": lambda c, p: spectral.autocorrelate(c, p.int("lags", c.meta.axes[0].n)),
    "bandpass": lambda c, p: spectral.bandpass(c, p.float("flo", None), p.float("fhi", None), p.float("fade", 0.0)),
    "bandstop": lambda c, p: filters.bandstop(c, p.float("flo"), p.float("fhi"), p.float("fade", 0.0)),
    "boxsmooth": lambda c, p: neighbour.smooth(c, p.int("rect"), p.int("axis", 1), repeat=p.int("repeat", 1)),
    "byte": lambda c, p: pointwise.byte_scale(c, p.float("clip", None), p.float("bias", None), p.bool("allpos", False), p.float("pclip", None)),
    "causint": lambda c, p: neighbour.integrate(c, p.int("axis", 1)),
    "clip": lambda c, p: pointwise.clip(c, p.float("clip"), p.float("value", None)),
    "clip2": lambda c, p: pointwise.clip_bounds(c, p.float("min", p.float("lower", None)), p.float("max", p.float("upper", None)), p.float("pclip", None), p.bool("symmetric", False)),
    "cmp2shot": lambda c, p: gathers.cmp2shot(c, p.bool("positive", True)),
    "convolve": lambda c, p: spectral.convolve(c, _taps(p), p.text("mode", "same")),
    "cosft": lambda c, p: spectral.dct(c, p.bool("inv", False)),
    "costaper": lambda c, p: pointwise.cosine_taper(c, {k: p.int(f"nw{k}", 0) for k in range(1, c.rank + 1)}),
    "cut": lambda c, p: reshape.cut(c, p.int("axis", 1), p.int("f", 0), p.int("n", None), p.int("j", 1)),
    "decimate": lambda c, p: neighbour.decimate(c, p.int("factor"), p.int("axis", 1)),
    "demean": lambda c, p: neighbour.demean(c, p.int("axis", 1)),
    "deriv": lambda c, p: neighbour.deriv(c, p.int("axis", 1), p.text("method", "central")),
    "detrend": lambda c, p: neighbour.detrend(c, p.int("axis", 1)),
    "envelope": lambda c, p: spectral.envelope(c),
    "exp": lambda c, p: pointwise.exp(c),
    "fillnan": lambda c, p: pointwise.fill_nan(c, p.float("value", 0.0), p.text("mode", "nan")),
    "firfilter": lambda c, p: spectral.fir_filter(c, _taps(p)),
    "fkfilter": lambda c, p: filters.fk_filter(c, p.float("vmin"), p.float("vmax", None), reject=p.bool("reject", False)),
    "freqattr": lambda c, p: spectral.frequency_attributes(c),
    "gain": lambda c, p: pointwise.gain(c, p.float("tpow", 1.0), p.int("axis", 1), p.float("scale", 1.0), p.float("epow", 0.0)),
    "grad2": lambda c, p: neighbour.sobel_square(c),
    "grad3": lambda c, p: neighbour.sobel3(c, p.int("dim", 0)),
    "halfint": lambda c, p: filters.half_integral(c, p.bool("inv", False), p.bool("adj", False), p.float("rho", None)),
    "highpass": lambda c, p: spectral.bandpass(c, p.float("flo"), None, p.float("fade", 0.0)),
    "integral": lambda c, p: neighbour.integrate(c, p.int("axis", 1), "trapezoid", True),
    "iradon": _iradon,
    "isnan": lambda c, p: pointwise.is_nan(c, p.text("mode", "nan")),
    "laplac": lambda c, p: neighbour.laplacian(c, p.ints("axes", [1])),
    "linear": lambda c, p: resample.linear(c, p.int("n1"), p.float("o1"), p.float("d1"), p.float("fill", 0.0)),
    "localrms": lambda c, p: neighbour.local_rms(c, p.int("rect"), p.int("axis", 1)),
    "log": lambda c, p: pointwise.log(c, p.float("base", None)),
    "lowpass": lambda c, p: spectral.bandpass(c, None, p.float("fhi"), p.float("fade", 0.0)),
    "lpad": lambda c, p: reshape.lpad(c),
    "mask": lambda c, p: pointwise.mask(c, p.float("min", None), p.float("max", None)),
    "math": lambda c, p: pointwise.math_expression(c, p.text("output")),
    "mutter": lambda c, p: scatter.line_mute(c, p.float("v0"), p.float("t0", 0.0), p.text("side", "above"), p.int("taper", 0)),
    "nmo": lambda c, p: resample.nmo(c.traces(), _offset(c.traces()), p.float("v"), p.bool("half", True), p.float("h0", 0.0), p.float("str", 0.5)),
    "noise": lambda c, p: generators.add_noise(c, p.float("level", 1.0), p.float("mean", 0.0), p.int("seed", 0), p.text("type", "normal")),
    "normalize": lambda c, p: aggregate.normalize(c, p.text("mode", "max")),
    "notch": lambda c, p: filters.notch(c, p.float("f0"), p.float("width", None), p.float("q", None), p.float("fade", 0.0)),
    "pad": _pad,
    "pow": lambda c, p: pointwise.power(c, p.float("pow")),
    "psd": lambda c, p: spectral.psd(c, p.text("window", "hann"), p.text("scaling", "density")),
    "quantile": lambda c, p: aggregate.quantile(c, p.floats("q"), p.int("axis", 0) or None, _omits(p)),
    "radon": _radon,
    "slant": _radon,
    "refl2ai": lambda c, p: neighbour.impedance(c, p.float("a0")),
    "reshape": lambda c, p: reshape.reshape(c, tuple(a.n for a in _axes(p))),
    "reverse": lambda c, p: reshape.reverse(c, p.int("axis", 1)),
    "rotate": lambda c, p: reshape.rotate(c, p.int("axis", 1), p.int("rot")),
    "scale": lambda c, p: pointwise.scale(c, p.float("dscale")),
    "semblance": _vscan,
    "vscan": _vscan,
    "shifts": lambda c, p: reshape.shift(c, p.int("shift"), p.int("axis", 1), p.float("fill", 0.0)),
    "shot2cmp": lambda c, p: gathers.shot2cmp(c, p.bool("positive", True)),
    "sign": lambda c, p: pointwise.sign(c),
    "slice": lambda c, p: reshape.slice_axis(c, p.int("axis", 1), p.int("index")),
    "smooth": lambda c, p: neighbour.smooth(c, p.int("rect"), p.int("axis", 1), "triangle", p.int("repeat", 1)),
    "specnorm": lambda c, p: cross.normalize_spectrum(c, p.text("mode", "unit_rms")),
    "spectra": lambda c, p: spectral.power_spectrum(c),
    "spectra2": lambda c, p: filters.spectra2(c),
    "spectrogram": lambda c, p: cross.spectrogram(c, p.int("nperseg", 64), p.int("noverlap", None), p.text("window", "hann")),
    "spline": lambda c, p: spectral.spline(c, p.axis(1, c.meta.axes[0]), p.float("fill", 0.0)),
    "spray": lambda c, p: reshape.spray(c, p.int("axis"), p.int("n"), p.float("o", 0.0), p.float("d", 1.0)),
    "sqrt": lambda c, p: pointwise.sqrt(c),
    "stack": lambda c, p: aggregate.stack(c, p.int("axis", 2), p.text("mode", "mean"), p.bool("nonzero", True)),
    "t2warp": lambda c, p: resample.t2warp(c, p.int("n", c.meta.axes[0].n), p.bool("inv", False)),
    "tclip": lambda c, p: pointwise.tclip(c, p.float("lower", 0.2), p.float("upper", 0.8)),
    "threshold": lambda c, p: pointwise.threshold(c, p.float("thr"), p.text("mode", "hard"), p.float("value", 0.0)),
    "tile": lambda c, p: reshape.tile(c, p.int("axis", 1), p.int("n")),
    "tpow": lambda c, p: pointwise.tpow(c, p.float("tpow", 1.0), p.int("axis", 1)),
    "transp": lambda c, p: reshape.transpose(c, tuple(int(x) for x in p.text("plane", "21"))),
    "trapez": lambda c, p: filters.trapezoid(c, tuple(p.floats("frequency"))),
    "welch": lambda c, p: spectral.welch(c, p.int("nperseg"), p.int("noverlap", None), p.text("window", "hann")),
    "whiten": lambda c, p: spectral.whiten(c, p.float("floor", 1e-6)),
    "window": _window,
    "acoustic2d": _shot,
    "avo": lambda c, p: scatter.avo(c.traces(), half=p.bool("half", True)),
    "bandenergy": lambda c, p: cross.band_energy(c, _pairs(p, "bands"), p.text("mode", "rms")),
    "cos2ang": lambda c, p: scatter.to_angle(c, "cos", p.int("na", None), p.float("a0", 0.0), p.float("da", None)),
    "isin2ang": lambda c, p: scatter.to_angle(c, "sin", p.int("na", None), p.float("a0", 0.0), p.float("da", None)),
    "cconv": lambda c, p: filters.circular_convolve(c, _taps(p)),
    "conv": lambda c, p: spectral.convolve(c, _taps(p), p.text("mode", "full")),
    "corr": lambda c, p: filters.correlate(c, _taps(p), p.text("mode", "same")),
    "filterbank": lambda c, p: cross.filter_bank(c, _pairs(p, "bands"), p.int("taps", 101), p.text("window", "hann")),
    "filtfilt": lambda c, p: cross.zero_phase(c, _taps(p), p.bool("pad", True)),
    "fk": lambda c, p: filters.fk_spectrum(c),
    "kirchhoff": _migrated,
    "match": lambda c, p: scatter.match(c, _taps(p)),
    "moveout": lambda c, p: scatter.moveout_spikes(c, p.axis(1)),
    "mute": lambda c, p: pointwise.mute(c.long(), p.float("t0", 0.0), p.float("v0"), _offset(c), p.float("taper", 0.0)),
    "remap1": lambda c, p: resample.linear(c, p.int("n1"), p.float("o1"), p.float("d1"), p.float("fill", 0.0)),
    **{stat: (lambda c, p, s=stat: aggregate.reduce(c, s, p.int("axis", None), p.bool("omitnan", False), p.int("ddof", 0))) for stat in ("mean", "median", "rms", "std", "var", "min", "max")},
    "range": lambda c, p: aggregate.reduce(c, "range", p.int("axis", None)),
}

#: Two datasets in, one out.
TWO: dict[str, Callable[[Cube, Cube, Parameters], Cube]] = {
    **{how: (lambda a, b, p, h=how: pointwise.combine(a, b, h, p.text("zero", "raise"))) for how in ("add", "mul", "sub", "div")},
    "cat": lambda a, b, p: reshape.cat([a, b], p.int("axis", 1)),
    "interleave": lambda a, b, p: reshape.interleave([a, b]),
    "map2coh": lambda a, b, p: scatter.map_to_coherence(a, b, Axis(p.int("nv"), p.float("v0"), p.float("dv"), "Velocity")),
    "xcorr": lambda a, b, p: filters.trace_correlation(a, b, p.text("mode", "full"), normalize=p.bool("normalize", False)),
    "envcorr": lambda a, b, p: filters.trace_correlation(a, b, p.text("mode", "full"), True, p.bool("normalize", False)),
    "coherence": lambda a, b, p: cross.coherence(a, b, p.int("nperseg"), p.int("noverlap", None), p.text("window", "hann")),
    "csd": lambda a, b, p: cross.csd(a, b, p.int("nperseg", None), p.int("noverlap", None), p.text("window", "hann"), part=p.text("part", "real")),
    "welchcsd": lambda a, b, p: cross.csd(a, b, p.int("nperseg"), p.int("noverlap", None), p.text("window", "hann"), part=p.text("part", "real")),
    "transfer": lambda a, b, p: cross.transfer(a, b, p.int("nperseg"), p.int("noverlap", None), p.text("window", "hann"), p.text("method", "H1")),
}

#: Complex datasets.
COMPLEX: dict[str, Callable] = {
    "fft": lambda c, p: complexes.fft(c, p.int("axis", 1), p.text("norm", None)),
    "ifft": lambda c, p: complexes.ifft(c, p.int("axis", 1), p.text("norm", None)),
    "rfft": lambda c, p: complexes.rfft(c, p.int("axis", 1), p.text("norm", None)),
    "irfft": lambda c, p: complexes.irfft(c, p.int("axis", 1), p.int("n", None), p.text("norm", None)),
    "fft1": lambda c, p: complexes.fft1(c, p.int("axis", 1), p.bool("inv", False), p.text("norm", None)),
    "real": lambda c, p: complexes.real(c),
    "imag": lambda c, p: complexes.imag(c),
    "rtoc": lambda c, p: complexes.rtoc(c),
}

#: No dataset in, one out.
NONE: dict[str, Callable[[SparkSession, Parameters], Cube]] = {
    "spike": lambda s, p: generators.spike(s, _axes(p), [tuple(p.int(f"k{k}", 1) for k in range(1, len(_axes(p)) + 1))], [p.float("mag", 1.0)]),
    "firwin": lambda s, p: _vector(s, _fir(p), Axis(p.int("taps"))),
    "freqz": lambda s, p: _vector(s, abs(cross.frequency_response(_taps(p), p.float("fs", 2.0), p.int("nfft", 512))[1]), Axis(p.int("nfft", 512) // 2 + 1, 0.0, p.float("fs", 2.0) / p.int("nfft", 512), "Frequency")),
    "polymask": lambda s, p: scatter.polygon_mask(s, _axes(p)[:2], _pairs(p, "corners")),
    "windowfunc": lambda s, p: _vector(s, spectral.window_weights(p.int("n1"), p.text("window", "hann")), p.axis(1)),
    "ricker": lambda s, p: generators.ricker(s, p.float("frequency"), p.axis(1), p.float("peak", None)),
}

#: One dataset in, numbers out.
SAID: dict[str, Callable[[Cube, Parameters], DataFrame]] = {
    "attr": lambda c, p: aggregate.attributes(c),
    "histogram": lambda c, p: aggregate.histogram(c, p.int("bins"), p.float("min"), p.float("max"), p.bool("density", False)),
    "max1": lambda c, p: aggregate.argmax(c, p.bool("abs", False)),
    "otsu": lambda c, p: aggregate.otsu(aggregate.histogram(c, p.int("bins"), p.float("min"), p.float("max"))),
    "snr": lambda c, p: aggregate.snr(c, (p.int("from"), p.int("to"))),
    "metrics": lambda c, p: metrics.panel_metrics(c, tuple(p.ints("signal")), tuple(p.ints("noise"))),
}

#: On headers and whole files.
FILES: dict[str, Callable[[SparkSession, Parameters], str]] = {
    "cp": lambda s, p: "\n".join(rsf.copy(*p.files[:2], overwrite=p.bool("overwrite", False))),
    "dd": lambda s, p: rsf.convert(s, *p.files[:2], p.text("format"), p.bool("trunc", False)) or p.files[1],
    "disfil": lambda s, p: rsf.disfil(rsf.read(s, p.files[0]), p.int("max", 1000), p.int("precision", 6), p.text("axis_format", "flat")),
    "get": lambda s, p: "\n".join(f"{k}={v}" for k, v in zip(p.files[1:], rsf.get(*p.files), strict=True)),
    "info": lambda s, p: "\n".join(map(rsf.info_text, p.files)),
    "put": lambda s, p: rsf.put(p.files[0], **p.values) or p.files[0],
    "rm": lambda s, p: "\n".join(rsf.remove(p.files[0], p.bool("dry_run", True), p.bool("confirm", False), p.bool("missing_ok", False))),
    "diff": lambda s, p: _table(metrics.compare(*(rsf.read(s, f) for f in p.files[:2]), p.float("rtol", 1e-5), p.float("atol", 1e-8))),
    "segyread": lambda s, p: _from_segy(s, p),
    "segywrite": lambda s, p: _to_segy(s, p),
    "conjgrad": _solved,
    "cconjgrad": _solved_complex,
    "dottest": lambda s, p: _dot_tested(s, p, False),
    "cdottest": lambda s, p: _dot_tested(s, p, True),
    "headercut": lambda s, p: _under(s, p, "cut", headers.cut),
    "headerwindow": lambda s, p: _under(s, p, "keep", headers.window),
}


def _from_segy(spark: SparkSession, p: Parameters) -> str:
    """SEG-Y to a dataset; headers= names a folder that gets the trace headers as CSV, in order of the traces."""
    path, to = p.files[:2]
    traces, found = segy.read(spark, path, p.text("endian", "auto"), p.int("format", None))
    rows = traces.select(F.col("trace").alias("i2"), F.col("samples").cast("array<double>").alias("samples"))
    rsf.write(Cube(rows, replace(rsf.meta_of({"n1": str(found.samples), "n2": str(found.traces), "d1": str(found.interval / 1e6), "label1": "Time", "unit1": "s", "label2": "Trace"})), "trace"), to)
    if "headers" in p.values:
        segy.header_table(spark, path).repartitionByRange("trace").sortWithinPartitions("trace").write.option("header", True).csv(p.text("headers"))
    return to


def _to_segy(spark: SparkSession, p: Parameters) -> str:
    """A dataset to SEG-Y; header words come from the columns of that name of the header table head=."""
    path, to = p.files[:2]
    c = rsf.read(spark, path).traces()
    rows = c.df.select(_places(c).alias("trace"), "samples")
    if "head" in p.values:
        table = rsf.read_table(spark, p.text("head"))
        words = [w for w in table.columns if w in segy.NAMES]
        rows = rows.join(table.select("trace", *[F.rint(F.col(w)).cast("int").alias(w) for w in words]), "trace", "left").fillna(0, words)
    order = {"big": ">", "little": "<"}[p.text("endian", "big")]
    segy.write(rows, to, c.meta.axes[0].n, round(c.meta.axes[0].d * 1e6), p.int("format", 5), order)
    return to


def _places(c: Cube):
    return rsf._place(c.meta)


def _under(spark: SparkSession, p: Parameters, name: str, operator: Callable) -> str:
    """dataset, header table and output: the operator on traces where a key is not 0."""
    c, table = rsf.read(spark, p.files[0]), rsf.read_table(spark, p.files[1])
    out = operator(c, _masked(c, table, p, name))
    if name == "keep":
        out = replace(out, meta=out.meta.with_axis(2, n=max(1, table.where(F.col(p.text("key")) != 0).count())))
    rsf.write(out, p.files[2])
    return p.files[2]


def _table(df: DataFrame, most: int = 1000) -> str:
    """The first rows as text; a report, so it is bounded."""
    rows = df.limit(most).collect()
    return "\n".join(["\t".join(df.columns), *("\t".join(map(str, r)) for r in rows)])


def programs() -> list[str]:
    return sorted({*ONE, *TWO, *COMPLEX, *NONE, *SAID, *FILES, *TABLES, "cmplx"})


def run(spark: SparkSession, program: str, words: list[str]) -> str:
    """Run one program; what it has to say, or the path it wrote."""
    p = Parameters(words)
    files = p.files
    if program in FILES:
        return FILES[program](spark, p)
    if program in TABLES:
        return _on_table(spark, program, p)
    if program in NONE or program == "math" and len(files) == 1:
        made = pointwise.math_expression(Cube(grid(spark, _axes(p)).withColumn("v", F.lit(0.0)), rsf.Meta(_axes(p))), p.text("output")) if program == "math" else NONE[program](spark, p)
        rsf.write(made, files[0])
        return files[0]
    if program in SAID:
        return _table(SAID[program](rsf.read(spark, files[0]), p))
    if program in TWO or program == "cmplx":
        a, b = (rsf.read(spark, f) for f in files[:2])
        rsf.write(complexes.cmplx(a, b) if program == "cmplx" else TWO[program](a, b, p), files[2])
        return files[2]
    if program in COMPLEX or program in ONE:
        rsf.write((COMPLEX.get(program) or ONE[program])(rsf.read(spark, files[0]), p), files[1], p.text("form", ""))
        return files[1]
    raise ValueError(f"no program {program}; there are {' '.join(programs())}")


def main() -> None:
    if len(sys.argv) < 2:
        print(" ".join(programs()))
        return
    spark = SparkSession.builder.appName(sys.argv[1]).getOrCreate()
    print(run(spark, sys.argv[1], sys.argv[2:]))


if __name__ == "__main__":
    main()
