"""Linear interpolation as index arithmetic and array look-ups, and the transforms built on it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.cube import Axis, Cube
from tracelake.operators import sums


def at_place(samples: Column, place: Column, n: int, fill: float = 0.0) -> Column:
    """Value at a fractional index, ``fill`` outside 0 .. n - 1."""
    k = F.floor(place)
    part = place - k
    a = F.try_element_at(samples, (k + 1).cast("int"))
    b = F.coalesce(F.try_element_at(samples, (F.least(k + 1, F.lit(n - 1)) + 1).cast("int")), F.lit(0.0))
    return F.when((place >= 0) & (place <= n - 1), a * (1 - part) + b * part).otherwise(float(fill))


def remap(c: Cube, axis: Axis, place: Callable[[Column], Column] | None = None, fill: float = 0.0) -> Cube:
    """Axis 1 anew: sample k of ``axis`` is the input at coordinate ``place(o + d k)``."""
    own, a = c.traces(), c.meta.axes[0]
    k = F.sequence(F.lit(0).cast("long"), F.lit(axis.n - 1).cast("long"))

    def value(i: Column) -> Column:
        x = F.lit(axis.o) + i * axis.d
        x = place(x) if place else x
        return at_place(F.col("samples"), (x - a.o) / a.d, a.n, fill)

    df = own.df.withColumn("samples", F.transform(k, value))
    return own.derive(df, replace(own.meta, axes=(axis, *own.meta.axes[1:])))


def linear(c: Cube, n: int, o: float, d: float, fill: float = 0.0) -> Cube:
    return remap(c, Axis(n, o, d), fill=fill)


def t2warp(c: Cube, n: int, inverse: bool = False) -> Cube:
    """t to t^2, over the same span, or back."""
    a = c.meta.axes[0]
    if a.o < 0:
        raise ValueError("coordinates below 0")
    end = a.o + (a.n - 1) * a.d
    if inverse:
        t0, t1 = a.o**0.5, end**0.5
        return remap(c, Axis(n, t0, (t1 - t0) / (n - 1)), lambda x: x * x)
    t0, t1 = a.o**2, end**2
    return remap(c, Axis(n, t0, (t1 - t0) / (n - 1)), lambda x: F.sqrt(F.greatest(x, F.lit(0.0))))


def _moved(rows: DataFrame, h: Column, speed: Callable[[Column], Column], a: Axis, h0: float, stretch: float | None) -> DataFrame:
    """``samples`` of rows after moveout of the offset h; the places are made once, as an array.

    With ``stretch``, a sample is 0 where its place and that of the sample
    before it (which must be past the first) are less than that apart.
    """
    k = F.sequence(F.lit(0).cast("long"), F.lit(a.n - 1).cast("long"))

    def place(i: Column) -> Column:
        square = F.pow(F.lit(a.o) + i * a.d, F.lit(2.0)) + (h * h - h0 * h0) / (speed(i) * speed(i))
        return F.when(square >= 0, (F.sqrt(square) - a.o) / a.d)

    placed = rows.withColumn("_place", F.transform(k, place))
    value = lambda p: at_place(F.col("samples"), p, a.n)
    if not stretch:
        return placed.withColumn("samples", F.transform("_place", value)).drop("_place")
    before = F.concat(F.array(F.lit(None).cast("double")), F.slice("_place", 1, a.n - 1))
    squeezed = lambda p, b: F.coalesce((b > 0) & (F.abs(p - b) < stretch), F.lit(False))
    return placed.withColumn("samples", F.zip_with("_place", before, lambda p, b: F.when(squeezed(p, b), 0.0).otherwise(value(p)))).drop("_place")


def _speed(velocity: float | list[float], n: int) -> Callable[[Column], Column]:
    """Velocity at sample i: one for all, or a list with one for each."""
    if isinstance(velocity, (int, float)):
        return lambda i: F.lit(float(velocity))
    if len(velocity) != n:
        raise ValueError(f"{len(velocity)} velocities for {n} samples")
    values = F.array(*[F.lit(float(v)) for v in velocity])
    return lambda i: F.element_at(values, (i + 1).cast("int"))


def nmo(c: Cube, offset: Column, velocity: float | list[float], half: bool = True, h0: float = 0.0, stretch: float | None = 0.5) -> Cube:
    """Normal moveout: the sample at t comes from sqrt(t^2 + (h^2 - h0^2) / v^2); stretched samples are 0."""
    own, a = c.traces(), c.meta.axes[0]
    times = 2.0 if half else 1.0
    return own.derive(_moved(own.df, offset * times, _speed(velocity, a.n), a, h0 * times, stretch))


def _moveout(x: np.ndarray, h: np.ndarray, speed: float, a: Axis, h0: float, stretch: float | None) -> np.ndarray:
    """``_moved`` on a matrix of traces."""
    square = (a.o + np.arange(a.n) * a.d) ** 2 + ((h * h - h0 * h0) / (speed * speed))[:, None]
    with np.errstate(invalid="ignore"):
        place = np.where(square >= 0, (np.sqrt(square) - a.o) / a.d, np.nan)
        got = sums.lookup(x, place)
        if stretch:
            got[:, 1:][(place[:, :-1] > 0) & (np.abs(np.diff(place, axis=1)) < stretch)] = 0.0
    return got


def semblance(c: Cube, offset: Column, gather: Column, velocities: list[float], half: bool = True, h0: float = 0.0, stretch: float | None = 0.5, smooth: int = 0) -> DataFrame:
    """(gather, i1, i2, v): (sum of a)^2 / (fold * sum of a^2) over live traces after moveout with velocity i2.

    ``smooth`` adds up numerator and denominator over that many samples either
    side.  Tasks add up whole traces for each gather and velocity, so one row
    for each of these leaves a task.
    """
    own, a = c.traces(), c.meta.axes[0]
    times = 2.0 if half else 1.0
    rows = own.df.select(gather.alias("gather"), (offset * times).cast("double").alias("h"), "samples")

    def kernel(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
        x, h, grouped = sums.matrix(batch), batch.column(1).to_numpy(zero_copy_only=False), sums.by_group(batch, ["gather"])
        for j, speed in enumerate(velocities):
            moved = _moveout(x, h, float(speed), a, h0 * times, stretch)
            for key, values in grouped(np.concatenate([moved, moved * moved, moved != 0], axis=1)):
                yield (*key, j), values

    got = sums.array_sums(rows, {"gather": rows.schema["gather"].dataType.simpleString(), "i2": "bigint"}, kernel)
    found = sums.exploded(got, ["gather", "i2"], a.n, ["s", "q", "n"]).select("gather", "i1", "i2", (F.col("s") * F.col("s")).alias("above"), (F.col("n") * F.col("q")).alias("below"))
    if smooth:
        near = Window.partitionBy("gather", "i2").orderBy("i1").rowsBetween(-smooth, smooth)
        found = found.select("gather", "i1", "i2", F.sum("above").over(near).alias("above"), F.sum("below").over(near).alias("below"))
    return found.select("gather", "i1", "i2", F.when(F.col("below") > 0, F.col("above") / F.col("below")).otherwise(0.0).alias("v"))


def radon(c: Cube, offset: Column, slopes: list[float], gather: Column | None = None, parabolic: bool = False, x0: float = 1.0, normalize: bool = False) -> DataFrame:
    """(gather, i1, i2, v): sums along tau + p x (or p (x / x0)^2), linear interpolation; ``normalize`` divides by the number of traces.

    Tasks add up whole traces for each gather and slope.
    """
    own, a = c.traces(), c.meta.axes[0]
    move = F.pow(offset / x0, F.lit(2.0)) if parabolic else offset
    rows = own.df.select((gather if gather is not None else F.lit(0)).alias("gather"), move.cast("double").alias("x"), "samples")

    def kernel(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
        samples, x, grouped = sums.matrix(batch), batch.column(1).to_numpy(zero_copy_only=False), sums.by_group(batch, ["gather"])
        one = np.ones((len(samples), 1))
        for j, p in enumerate(slopes):
            moved = sums.lookup(samples, np.arange(a.n) + float(p) * x[:, None] / a.d)
            for key, values in grouped(np.concatenate([moved, one], axis=1)):
                yield (*key, j), values

    got = sums.array_sums(rows, {"gather": rows.schema["gather"].dataType.simpleString(), "i2": "bigint"}, kernel)
    by = F.element_at("sums", a.n + 1) if normalize else F.lit(1.0)
    return sums.exploded(got.withColumn("sums", F.transform("sums", lambda v: v / by)), ["gather", "i2"], a.n, ["v"]).select("gather", "i1", "i2", "v")
