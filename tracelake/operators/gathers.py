"""Resorting of gathers, moveout and Radon modelling, time migration and travel-time searches as plans."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.cube import Axis, Cube, Meta
from tracelake.operators import sums
from tracelake.operators.resample import at_place


def _ratio(above: float, below: float) -> int:
    r = math.floor(above / below + 0.5)
    if r < 1 or not math.isclose(above / below, r, rel_tol=1e-5):
        raise ValueError("the two samplings have no whole ratio")
    return r


def _three(c: Cube) -> Cube:
    if c.rank != 3:
        raise ValueError("gathers have three axes: time, offset and midpoint or shot")
    return c.traces()


def _filled(df: DataFrame, meta: Meta) -> Cube:
    """Zero traces where the new geometry has none; the grid of traces is outer-joined once."""
    n1, n2, n3 = meta.shape
    places = df.sparkSession.range(n2 * n3).select((F.col("id") % n2).alias("i2"), F.floor(F.col("id") / n2).cast("long").alias("i3"))
    zeros = F.array_repeat(F.lit(0.0), n1)
    return Cube(places.join(df, ["i2", "i3"], "left").withColumn("samples", F.coalesce("samples", zeros)), meta, "trace")


def cmp2shot(c: Cube, positive: bool = True) -> Cube:
    """Midpoint gathers to shot gathers: each trace has one place there, so places are projected."""
    own = _three(c)
    time, h, y = c.meta.axes
    r = _ratio(h.d, y.d)
    kind = F.pmod(F.col("i3") if positive else -F.col("i3"), F.lit(r))
    shot = F.floor(F.col("i3") / r) - F.col("i2") + (h.n - 1) if positive else (F.col("i3") + kind) / r + F.col("i2")
    n = (y.n - 1) // r + h.n
    df = own.df.select((F.col("i2") * r + kind).cast("long").alias("i2"), shot.cast("long").alias("i3"), "samples").where(F.col("i3").between(0, n - 1))
    start = y.o - h.o - (h.n - 1) * h.d if positive else y.o + h.o
    return _filled(df, Meta((time, Axis(h.n * r, h.o, h.d / r, h.label, h.unit), Axis(n, start, h.d, "Shot", y.unit)), c.meta.attrs))


def shot2cmp(c: Cube, positive: bool = True) -> Cube:
    """Shot gathers to midpoint gathers of half offsets."""
    own = _three(c)
    time, h, s = c.meta.axes
    r = _ratio(s.d, h.d)
    n = s.n * r + h.n - 1
    class_ = F.col("i2") % r
    mirrored = (F.col("i3") + (h.n - 1) // r - F.floor(F.col("i2") / r) - F.floor(2 * class_ / r)) * r + class_
    mid = F.col("i3") * r + F.col("i2") if positive else mirrored
    df = own.df.select(F.floor(F.col("i2") / r).cast("long").alias("i2"), mid.cast("long").alias("i3"), "samples").where(F.col("i3").between(0, n - 1))
    start = s.o + h.o if positive else s.o - h.o - r * ((h.n - 1) // r) * h.d
    return _filled(df, Meta((time, Axis(-(-h.n // r), h.o, r * h.d, h.label, h.unit), Axis(n, start, h.d, "Midpoint", s.unit)), c.meta.attrs))


def radon_model(c: Cube, offsets: list[float], parabolic: bool = False, x0: float = 1.0) -> DataFrame:
    """(i1, i2, v): every sample at tau and slope i2 is spread over the two times round tau + p x (or p (x / x0)^2) of each offset.

    Partial sums are made before the exchange, so what moves is of the size of the result.
    """
    own, a = c.long(), c.meta.axes[0]
    moves = F.posexplode(F.array(*[F.lit(float(x) if not parabolic else (x / x0) ** 2) for x in offsets]))
    place = (own.coordinate(1) + own.coordinate(2) * F.col("x") - a.o) / a.d
    spread = own.df.where("v <> 0").select("*", moves.alias("j", "x")).withColumn("place", place).withColumn("k", F.floor("place"))
    two = F.explode(F.array(F.struct(F.col("k").alias("i1"), (F.col("v") * (1 - F.col("place") + F.col("k"))).alias("v")), F.struct((F.col("k") + 1).alias("i1"), (F.col("v") * (F.col("place") - F.col("k"))).alias("v"))))
    cells = spread.select(F.col("j").cast("long").alias("i2"), two.alias("s")).select("s.i1", "i2", "s.v")
    return cells.where(F.col("i1").between(0, a.n - 1)).groupBy("i1", "i2").agg(F.sum("v").alias("v"))


def inverse_nmo(c: Cube, offset: Column, velocity: float, half: bool = True, h0: float = 0.0) -> Cube:
    """Moveout put back: the sample at t comes from sqrt(t^2 - (h^2 - h0^2) / v^2); 0 where that has no root."""
    own, a = c.traces(), c.meta.axes[0]
    h = offset * (2.0 if half else 1.0)
    k = F.sequence(F.lit(0).cast("long"), F.lit(a.n - 1).cast("long"))

    def value(i: Column) -> Column:
        square = F.pow(F.lit(a.o) + i * a.d, F.lit(2.0)) - (h * h - h0 * h0) / (velocity * velocity)
        return F.when(square >= 0, at_place(F.col("samples"), (F.sqrt(F.greatest(square, F.lit(0.0))) - a.o) / a.d, a.n)).otherwise(0.0)

    return own.derive(own.df.withColumn("samples", F.transform(k, value)))


def kirchhoff(c: Cube, velocity: float, aperture: float | None = None, normalize: bool = False) -> DataFrame:
    """(i1, i2, v): sum over traces s of the data at sqrt(tau^2 + (2 (s - x) / v)^2), or its mean over live traces.

    Traces are taken some at a time, with the images that any of them reaches:
    within the aperture, and no farther than the last sample's time allows.  The
    task adds up images, so one row for each image that it reached leaves it.
    """
    own = c.traces()
    time, line = own.meta.axes[:2]
    per_place = 2.0 * abs(line.d) / velocity
    latest = time.o + time.n * time.d
    least = min(abs(time.o + k * time.d) for k in range(time.n))
    reach = min(line.n - 1, math.ceil(math.sqrt(max(latest * latest - least * least, 0.0)) / per_place))
    if aperture is not None:
        reach = min(reach, math.floor(aperture / abs(line.d) + 1e-9))
    rows = own.df.select(F.col("i2").alias("s"), "samples")

    def kernel(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
        at, x = np.asarray(batch.column(0)), sums.matrix(batch)
        order = np.argsort(at, kind="stable")
        at, x = at[order], np.pad(x[order], ((0, 0), (1, 1)))  # a zero sample before and after, so that the edges are interpolated too
        tau = (time.o + np.arange(time.n) * time.d) ** 2
        images = np.unique(np.concatenate([np.arange(max(0, a - reach), min(line.n, b + reach + 1)) for a, b in _stretches(at, reach)]))
        for image in images.tolist():
            a, b = np.searchsorted(at, [image - reach, image + reach + 1])
            if a < b:
                lateral = (at[a:b] - image) * (2.0 * line.d / velocity)
                place = (np.sqrt(tau + (lateral * lateral)[:, None]) - time.o) / time.d
                live = (place >= -1) & (place < time.n)
                yield (image,), np.concatenate([sums.lookup(x[a:b], place + 1).sum(axis=0), live.sum(axis=0)])

    got = sums.exploded(sums.array_sums(rows, {"i2": "bigint"}, kernel), ["i2"], time.n, ["v", "live"])
    total = F.col("v") / F.greatest(F.col("live"), F.lit(1.0)) if normalize else F.col("v")
    return got.select("i1", "i2", total.alias("v"))


def _stretches(at: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """First and last of the ascending places whose surroundings of ``reach`` meet."""
    cuts = np.flatnonzero(np.diff(at) > 2 * reach + 1)
    return list(zip(at[np.append(0, cuts + 1)].tolist(), at[np.append(cuts, len(at) - 1)].tolist(), strict=True))


def direct_time(sx: Column, sz: Column, rx: Column, rz: Column, velocity: float) -> Column:
    return F.hypot(rx - sx, rz - sz) / velocity


def diffraction_time(sx: Column, sz: Column, rx: Column, rz: Column, x: Column, z: Column, velocity: float) -> Column:
    return (F.hypot(x - sx, z - sz) + F.hypot(rx - x, rz - z)) / velocity


def locate(picks: DataFrame, velocity: float, x: Axis, z: Axis) -> DataFrame:
    """One row (iz, ix, x, z, objective): the grid point of least half weighted square residual, the first in z, x order of equals.

    ``picks``: sx, sz, rx, rz, observed, weight.  Each pick makes its term for
    every grid point and terms are summed before the exchange, so one row a
    point leaves a task.
    """
    cell = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(x.n * z.n - 1).cast("long"))).alias("cell")
    px, pz = F.lit(x.o) + (F.col("cell") % x.n) * x.d, F.lit(z.o) + F.floor(F.col("cell") / x.n) * z.d
    predicted = diffraction_time(F.col("sx"), F.col("sz"), F.col("rx"), F.col("rz"), px, pz, velocity)
    term = 0.5 * F.col("weight") * F.pow(F.col("observed") - predicted, F.lit(2.0))
    sums = picks.select("sx", "sz", "rx", "rz", "observed", "weight", cell).groupBy("cell").agg(F.sum(term).alias("objective"))
    best = sums.agg(F.min(F.struct(F.col("objective"), F.col("cell"))).alias("b")).select("b.*").where("cell is not null")
    return best.select(F.floor(F.col("cell") / x.n).cast("long").alias("iz"), (F.col("cell") % x.n).alias("ix"), px.alias("x"), pz.alias("z"), "objective")
