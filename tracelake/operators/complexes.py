"""Complex samples: trace layout with the real and the imaginary parts as two arrays, and Fourier transforms along any axis."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.cube import Axis, Cube, Meta
from tracelake.operators import solvers, transforms


@dataclass(frozen=True)
class ComplexCube:
    """One row a trace: ``i2 .. iN``, ``re`` and ``im``."""

    df: DataFrame
    meta: Meta

    @property
    def keys(self) -> list[str]:
        return [f"i{k}" for k in range(2, len(self.meta.axes) + 1)] or ["i2"]

    def long(self) -> DataFrame:
        """(i1 .. iN, re, im), one row a sample."""
        both = F.posexplode(F.arrays_zip("re", "im")).alias("i1", "z")
        return self.df.select(*self.keys, both).select(F.col("i1").cast("long").alias("i1"), *self.keys, "z.re", "z.im")

    def part(self, value: Callable[[Column, Column], Column]) -> Cube:
        """A real function of the two parts of each sample."""
        return Cube(self.df.select(*self.keys, F.zip_with("re", "im", value).alias("samples")), self.meta, "trace")


def cmplx(re: Cube, im: Cube) -> ComplexCube:
    """Two real cubes of one shape as one complex cube; traces are joined whole."""
    if re.meta.shape != im.meta.shape:
        raise ValueError("cubes differ in shape")
    x, y = re.traces(), im.traces()
    keys = x.keys[1:] or ["i2"]
    return ComplexCube(x.df.select(*keys, F.col("samples").alias("re")).join(y.df.select(*keys, F.col("samples").alias("im")), keys), re.meta)


def rtoc(c: Cube) -> ComplexCube:
    """A real cube with imaginary parts of 0."""
    own = c.traces()
    return ComplexCube(own.df.select(*(own.keys[1:] or ["i2"]), F.col("samples").alias("re"), F.transform("samples", lambda v: F.lit(0.0)).alias("im")), own.meta)


def real(c: ComplexCube) -> Cube:
    return c.part(lambda re, im: re)


def imag(c: ComplexCube) -> Cube:
    return c.part(lambda re, im: im)


def modulus(c: ComplexCube) -> Cube:
    return c.part(F.hypot)


def phase(c: ComplexCube) -> Cube:
    return c.part(lambda re, im: F.atan2(im, re))


def conjugate(c: ComplexCube) -> ComplexCube:
    return replace(c, df=c.df.withColumn("im", F.transform("im", lambda v: -v)))


def _kernel(c: ComplexCube, kernel: Callable[[np.ndarray], np.ndarray], meta: Meta) -> ComplexCube:
    """A NumPy kernel on matrices of whole complex traces, Arrow batch by batch."""
    keys = c.keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            re, im = (np.asarray(batch.column(k).flatten(), np.float64).reshape(batch.num_rows, -1) for k in (len(keys), len(keys) + 1))
            out = kernel(re + 1j * im)
            ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1], pa.int32())
            parts = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x, np.float64).reshape(-1))) for x in (out.real, out.imag)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *parts], names=[*keys, "re", "im"])

    schema = ", ".join([*(f"{k} long" for k in keys), "re array<double>", "im array<double>"])
    return ComplexCube(c.df.select(*keys, "re", "im").mapInArrow(run, schema), meta)


def _scaled(c: ComplexCube, factor: float) -> ComplexCube:
    by = lambda name: F.transform(name, lambda v: v * factor)
    return c if factor == 1 else replace(c, df=c.df.withColumns({"re": by("re"), "im": by("im")}))


def _factor(n: int, norm: str | None, inverse: bool) -> float:
    return {None: 1 / n if inverse else 1.0, "backward": 1 / n if inverse else 1.0, "ortho": n**-0.5, "forward": 1.0 if inverse else 1 / n}[norm]


def _across(c: ComplexCube, axis: int, n: int, inverse: bool, norm: str | None) -> ComplexCube:
    """Transform along an axis across traces, in exchanges of bounded groups of traces."""
    return _scaled(replace(c, df=transforms.along(c.df, c.keys, axis, n, 1 if inverse else -1)), _factor(n, norm, inverse))


def _moved(c: ComplexCube, axis: int, by: int) -> ComplexCube:
    return replace(c, df=transforms.shifted(c.df, axis, c.meta.axis(axis).n, by))


def _meta(c: ComplexCube, axis: int, new: Axis, attrs: dict) -> Meta:
    axes = list(c.meta.axes)
    axes[axis - 1] = new
    return replace(c.meta, axes=tuple(axes), attrs=attrs)


def _with_origin(c: ComplexCube, axis: int) -> dict:
    a = c.meta.axis(axis)
    return c.meta.attrs | {f"fft_n{axis}": a.n, f"fft_o{axis}": a.o, f"fft_d{axis}": a.d, f"fft_label{axis}": a.label, f"fft_unit{axis}": a.unit}


def _origin(c: ComplexCube, axis: int, n: int) -> tuple[Axis, dict]:
    """The axis that a transform replaced, with n samples, and the attributes without it."""
    a = c.meta.attrs
    back = Axis(n, float(a.get(f"fft_o{axis}", 0.0)), float(a.get(f"fft_d{axis}", 1.0)), str(a.get(f"fft_label{axis}", "")), str(a.get(f"fft_unit{axis}", "")))
    return back, {k: v for k, v in a.items() if k not in {f"fft_{w}{axis}" for w in ("n", "o", "d", "label", "unit")}}


def fft(c: Cube | ComplexCube, axis: int = 1, norm: str | None = None) -> ComplexCube:
    """Transform along an axis, the zero frequency in the middle."""
    own = rtoc(c) if isinstance(c, Cube) else c
    a = own.meta.axis(axis)
    f = np.fft.fftshift(np.fft.fftfreq(a.n, a.d))
    new = Axis(a.n, float(f[0]), float(f[1] - f[0]) if a.n > 1 else 1.0, "Frequency", "Hz" if a.unit == "s" else "")
    meta = _meta(own, axis, new, _with_origin(own, axis))
    if axis == 1:
        return _kernel(own, lambda x: np.fft.fftshift(np.fft.fft(x, norm=norm), axes=1), meta)
    return replace(_moved(_across(own, axis, a.n, False, norm), axis, a.n // 2), meta=meta)


def ifft(c: ComplexCube, axis: int = 1, norm: str | None = None) -> ComplexCube:
    """The inverse of ``fft``; the axis comes from what the transform kept of it."""
    n = c.meta.axis(axis).n
    meta = _meta(c, axis, *_origin(c, axis, n))
    if axis == 1:
        return _kernel(c, lambda x: np.fft.ifft(np.fft.ifftshift(x, axes=1), norm=norm), meta)
    return replace(_across(_moved(c, axis, -(n // 2)), axis, n, True, norm), meta=meta)


def rfft(c: Cube, axis: int = 1, norm: str | None = None) -> ComplexCube:
    """One-sided transform of real samples."""
    own = rtoc(c)
    a = own.meta.axis(axis)
    new = Axis(a.n // 2 + 1, 0.0, 1 / (a.n * a.d), "Frequency", "Hz" if a.unit == "s" else "")
    meta = _meta(own, axis, new, _with_origin(own, axis))
    if axis == 1:
        return _kernel(own, lambda x: np.fft.rfft(x.real, norm=norm), meta)
    both = _across(own, axis, a.n, False, norm)
    return ComplexCube(both.df.where(F.col(f"i{axis}") < new.n), meta)


def irfft(c: ComplexCube, axis: int = 1, n: int | None = None, norm: str | None = None) -> Cube:
    """Real samples of a one-sided transform: n of them, else as many as there were, else 2 (n - 1)."""
    size = n or int(c.meta.attrs.get(f"fft_n{axis}", max(1, 2 * (c.meta.axis(axis).n - 1))))
    meta = _meta(c, axis, *_origin(c, axis, size))
    if axis == 1:
        return real(_kernel(c, lambda x: np.fft.irfft(x, size, norm=norm).astype(np.complex128), meta))
    key = F.col(f"i{axis}")
    own = c.df.where(key <= size // 2)
    mirrored = own.where(key.between(1, (size - 1) // 2)).withColumns({f"i{axis}": F.lit(size) - key, "im": F.transform("im", lambda v: -v)})
    return real(replace(_across(replace(c, df=own.unionByName(mirrored)), axis, size, True, norm), meta=meta))


def fft1(c: Cube | ComplexCube, axis: int = 1, inverse: bool = False, norm: str | None = None) -> Cube | ComplexCube:
    """``rfft`` of a real cube, or ``irfft`` of a complex one."""
    return irfft(c, axis, norm=norm) if inverse else rfft(c, axis, norm)


# complex linear systems, as real ones of twice the size: place i is 2 i (real) and 2 i + 1 (imaginary)
def paired(vector: DataFrame) -> DataFrame:
    """(i, re, im) as a real vector (i, v)."""
    both = F.explode(F.array(F.struct((F.col("i") * 2).alias("i"), F.col("re").alias("v")), F.struct((F.col("i") * 2 + 1).alias("i"), F.col("im").alias("v")))).alias("e")
    return vector.select(both).select("e.*")


def unpaired(vector: DataFrame) -> DataFrame:
    """A real vector (i, v) as (i, re, im)."""
    part = lambda k: F.coalesce(F.sum(F.when(F.pmod("i", F.lit(2)) == k, F.col("v"))), F.lit(0.0))
    return vector.groupBy(F.floor(F.col("i") / 2).cast("long").alias("k")).agg(part(0).alias("re"), part(1).alias("im")).withColumnRenamed("k", "i")


def complex_matrix(entries: DataFrame, rows: int, columns: int) -> solvers.Matrix:
    """Sparse complex matrix (row, col, re, im) on paired vectors; its adjoint is the conjugate transpose."""
    cell = lambda a, b, v: F.struct((F.col("row") * 2 + a).alias("row"), (F.col("col") * 2 + b).alias("col"), v.alias("value"))
    cells = F.array(cell(0, 0, F.col("re")), cell(0, 1, -F.col("im")), cell(1, 0, F.col("im")), cell(1, 1, F.col("re")))
    return solvers.Matrix(entries.select(F.explode(cells).alias("e")).select("e.*").where("value <> 0"), 2 * rows, 2 * columns)


def complex_conjugate_gradient(entries: DataFrame, b: DataFrame, n: int, x0: DataFrame | None = None, steps: int = 10, tol: float = 1e-6, damp: float = 0.0, mode: str = "hermitian") -> solvers.Solution:
    """Conjugate gradients for a Hermitian system, or with mode ``normal`` for its normal equations; x is (i, re, im).

    The real inner product of paired vectors is the real part of the complex
    one, so steps and residuals are those of the complex iteration.
    """
    solve = {"hermitian": solvers.conjugate_gradient, "spd": solvers.conjugate_gradient, "normal": solvers.cgnr}[mode]
    rows = n if mode != "normal" else int((entries.agg(F.max("row")).first()[0] or 0) + 1)
    found = solve(complex_matrix(entries, rows, n), paired(b), None if x0 is None else paired(x0), steps, tol, damp)
    return replace(found, x=unpaired(found.x))
