"""Masks, fits along offset, scatters into a new axis, matrices and matching filters."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.cube import Axis, Cube, Meta, grid
from tracelake.operators.resample import remap


def polygon_mask(spark: SparkSession, axes: tuple[Axis, Axis], corners: list[tuple[float, float]]) -> Cube:
    """1 at grid points inside a polygon (crossings of a ray, half-open edges), else 0."""
    if len(corners) < 3:
        raise ValueError("a polygon has three corners or more")
    x, y = axes[0].coordinate(F.col("i1")), axes[1].coordinate(F.col("i2"))
    crossed = F.lit(0)
    for (ax, ay), (bx, by) in zip(corners, [corners[-1], *corners[:-1]], strict=True):
        if ay != by:
            at = (bx - ax) * (y - ay) / (by - ay) + ax
            crossed = crossed + (((F.lit(ay) > y) != (F.lit(by) > y)) & (x < at)).cast("int")
    return Cube(grid(spark, axes).withColumn("v", (crossed % 2).cast("double")), Meta(axes))


def line_mute(c: Cube, velocity: float, t0: float = 0.0, side: str = "above", taper: int = 0, axis: int = 1, offset_axis: int = 2) -> Cube:
    """Zero before (above) or after (below) t0 + |offset| / velocity; sin^2 flank of ``taper`` samples."""
    if velocity <= 0 or side not in ("above", "below") or taper < 0:
        raise ValueError("velocity, side or taper")
    own = c.long()
    late = own.coordinate(axis) - (t0 + F.abs(own.coordinate(offset_axis)) / velocity)
    late = late if side == "above" else -late
    width = taper * abs(own.meta.axis(axis).d)
    factor = F.when(late < 0, 0.0).otherwise(1.0) if not taper else F.pow(F.sin(F.greatest(F.least(late / width, F.lit(1.0)), F.lit(0.0)) * (np.pi / 2)), F.lit(2.0))
    return own.derive(own.df.withColumn("v", F.col("v") * factor))


def avo(c: Cube, offset: Column | None = None, half: bool = True) -> Cube:
    """Least-squares intercept (i2 = 0) and gradient (i2 = 1) of amplitude over offset, for each time and gather.

    Offsets that are all alike raise.
    """
    own = c.long()
    h = (own.coordinate(2) if offset is None else offset) * (2.0 if half else 1.0)
    rows = own.df.withColumn("h", h)
    sums = rows.groupBy(*own.others(2)).agg(F.count("v").alias("n"), F.sum("h").alias("sh"), F.sum(F.col("h") * F.col("h")).alias("shh"), F.sum("v").alias("sx"), F.sum(F.col("v") * F.col("h")).alias("sxh"))
    det = F.col("n") * F.col("shh") - F.col("sh") * F.col("sh")
    det = F.when(det == 0, F.raise_error(F.lit("offsets do not determine a line"))).otherwise(det)
    pair = F.array((F.col("sx") * F.col("shh") - F.col("sxh") * F.col("sh")) / F.col("det"), (F.col("sxh") * F.col("n") - F.col("sx") * F.col("sh")) / F.col("det"))
    out = sums.withColumn("det", det).select(*own.others(2), F.posexplode(pair).alias("i2", "v")).withColumn("i2", F.col("i2").cast("long"))
    return own.derive(out, own.meta.with_axis(2, n=2, o=0.0, d=1.0, label="", unit=""))


def map_to_coherence(c: Cube, maps: Cube, velocities: Axis, low: float | None = None, high: float | None = None) -> Cube:
    """Adds each sample to the two velocity bins beside its parameter, split linearly; axis 2 becomes velocity.

    ``maps`` has the parameter of every sample; only rows of axis 2 that reach
    into low .. high count.
    """
    own, other, a = c.long(), maps.long(), c.meta.axis(2)
    if own.meta.shape != other.meta.shape:
        raise ValueError("both cubes have one shape")
    last = a.o + a.d * (a.n - 1)
    low, high = max(a.o, a.o if low is None else low), min(last, last if high is None else high)
    if low > high:
        raise ValueError("no rows from low to high")
    first, final = int(np.floor((low - a.o) / a.d)), int(np.ceil((high - a.o) / a.d))
    rows = own.df.where(F.col("i2").between(first, final)).join(other.df.withColumnRenamed("v", "p"), own.keys)
    place = (F.col("p") - velocities.o) / velocities.d
    part = place - F.floor(place)
    halves = F.array(F.struct(F.floor(place).alias("k"), (F.col("v") * (1 - part)).alias("w")), F.struct((F.floor(place) + 1).alias("k"), (F.col("v") * part).alias("w")))
    split = rows.select(*own.others(2), F.explode(halves).alias("half")).select(*own.others(2), F.col("half.k").alias("i2"), F.col("half.w").alias("w")).where(F.col("i2").between(0, velocities.n - 1))
    summed = split.groupBy(*own.keys).agg(F.sum("w").alias("w"))
    meta = replace(own.meta, axes=(own.meta.axes[0], velocities, *own.meta.axes[2:]))
    cells = grid(c.df.sparkSession, meta.axes)
    return own.derive(cells.join(summed, own.keys, "left").select(*own.keys, F.coalesce("w", F.lit(0.0)).alias("v")), meta)


def moveout_spikes(times: Cube, axis: Axis, nearest: bool = False) -> Cube:
    """A trace for each time of ``times`` (its axes move up by one): a unit spike, shared linearly or at the nearest sample."""
    own = times.long()
    place = (F.col("v") - axis.o) / axis.d
    at = F.rint(place) if nearest else place
    k = F.sequence(F.lit(0).cast("long"), F.lit(axis.n - 1).cast("long"))
    samples = F.transform(k, lambda i: F.greatest(1.0 - F.abs(i - at), F.lit(0.0)))
    keys = [F.col(f"i{j}").alias(f"i{j + 1}") for j in range(1, own.rank + 1)]
    return Cube(own.df.select(*keys, samples.alias("samples")), Meta((axis, *own.meta.axes), own.meta.attrs), "trace")


def to_angle(c: Cube, kind: str = "cos", n: int | None = None, o: float = 0.0, d: float | None = None, fill: float = 0.0) -> Cube:
    """Axis 1 resampled at -1 / cos or 1 / sin of angles in degrees; ``fill`` where there is none."""
    a = c.meta.axes[0]
    axis = Axis(n or a.n, o, 90.0 / (a.n - 1) if d is None else d, "Angle", "deg")
    number = {"cos": lambda x: F.try_divide(F.lit(-1.0), F.cos(F.radians(x))), "sin": lambda x: F.try_divide(F.lit(1.0), F.sin(F.radians(x)))}[kind]
    return remap(c, axis, number, fill)


def matmult(c: Cube, matrix: np.ndarray, adjoint: bool = False) -> Cube:
    """The matrix (rows x columns), or its transpose, times every trace."""
    m = np.asarray(matrix, np.float64)
    m = m.T if adjoint else m
    if m.ndim != 2 or m.shape[1] != c.meta.axes[0].n:
        raise ValueError("the matrix has a column for each sample")
    return c.map_traces(lambda x: x @ m.T, Axis(m.shape[0]))


def match(c: Cube, taps: np.ndarray) -> Cube:
    """Sums over i of x[k - i + len // 2] * taps[i]; samples beyond the ends are 0."""
    f = np.asarray(taps, np.float64)
    half = len(f) // 2

    def kernel(x: np.ndarray) -> np.ndarray:
        wide = np.pad(x, ((0, 0), (len(f), len(f))))
        return sum(w * wide[:, len(f) - i + half : len(f) - i + half + x.shape[1]] for i, w in enumerate(f))

    return c.map_traces(kernel)


def match_adjoint(c: Cube, noise: Cube, taps: int) -> Cube:
    """The filter that data give back: for each tap, the sum over all traces of noise[k - i + taps // 2] * data[k]."""
    n, half = c.meta.axes[0].n, taps // 2

    def kernel(both: np.ndarray) -> np.ndarray:
        x, wide = both[:, :n], np.pad(both[:, n:], ((0, 0), (taps, taps)))
        return np.stack([(x * wide[:, taps - i + half : taps - i + half + n]).sum(axis=1) for i in range(taps)], axis=1)

    per = beside(c, noise).map_traces(kernel, Axis(taps)).long()
    return Cube(per.df.groupBy("i1").agg(F.sum("v").alias("v")), Meta((Axis(taps),)))


def beside(c: Cube, other: Cube) -> Cube:
    """Traces of two cubes end to end, by the trace keys."""
    a = c.traces()
    if a.meta.shape[1:] != other.meta.shape[1:]:
        raise ValueError("both cubes have the same traces")
    df = a.beside(other).withColumn("samples", F.concat("samples", "_other")).drop("_other")
    return a.derive(df, replace(a.meta, axes=(Axis(a.meta.axes[0].n + other.meta.axes[0].n), *a.meta.axes[1:])))
