"""Velocity models, acoustic shots and location with unknown velocity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.cube import Axis, Cube, Meta, grid

#: A model goes to every task, so it may not be larger than this.
MOST_MODEL_BYTES = 256 << 20


def layered_velocity(spark: SparkSession, z: Axis, x: Axis, layers: list[tuple[float, float]], background: float | None = None) -> Cube:
    """Axis 1 depth, axis 2 distance: the velocity of the deepest (top, velocity) at or above a point.

    Points above the first top have the background, which must then be given.
    """
    tops = [t for t, _ in layers]
    if len(set(tops)) < len(tops) or any(not v > 0 for _, v in layers):
        raise ValueError("tops differ and velocities are positive")
    if background is None and (not layers or min(tops) > z.o):
        raise ValueError("points above the first layer have no velocity")
    depth, v = z.coordinate(F.col("i1")), F.lit(0.0 if background is None else float(background))
    for top, speed in sorted(layers):
        v = F.when(depth >= top, float(speed)).otherwise(v)
    return Cube(grid(spark, (z, x)).withColumn("v", v), Meta((z, x)))


def constant_velocity(spark: SparkSession, z: Axis, x: Axis, velocity: float) -> Cube:
    return layered_velocity(spark, z, x, [(z.o, velocity)])


def _changed(c: Cube, inside: Column, velocity: float | None, delta: float | None) -> Cube:
    if (velocity is None) == (delta is None):
        raise ValueError("velocity or delta")
    own = c.long()
    return own.derive(own.df.withColumn("v", F.when(inside, F.lit(float(velocity)) if delta is None else F.col("v") + float(delta)).otherwise(F.col("v"))))


def rectangle(c: Cube, x: tuple[float, float], z: tuple[float, float], velocity: float | None = None, delta: float | None = None) -> Cube:
    """The velocity set, or changed, from x[0] to x[1] and z[0] to z[1], ends included."""
    return _changed(c, c.coordinate(2).between(*x) & c.coordinate(1).between(*z), velocity, delta)


def circle(c: Cube, x: float, z: float, radius: float, velocity: float | None = None, delta: float | None = None) -> Cube:
    here = F.pow(c.coordinate(2) - x, F.lit(2.0)) + F.pow(c.coordinate(1) - z, F.lit(2.0)) <= radius * radius
    return _changed(c, here, velocity, delta)


def nearest_index(place: Column, axis: Axis) -> Column:
    """Index of the nearest sample, halves up; outside the axis raises."""
    k = F.floor((place - axis.o) / axis.d + 0.5)
    return F.when(k.between(0, axis.n - 1), k).otherwise(F.raise_error(F.lit("a place outside the grid")))


def receiver_line(spark: SparkSession, start: float, stop: float, z: float, spacing: float) -> DataFrame:
    n = int(np.floor((stop - start) / spacing + 1e-9)) + 1
    return spark.range(n).select("id", (F.lit(float(start)) + F.col("id") * float(spacing)).alias("x"), F.lit(float(z)).alias("z"))


def stability(velocity: np.ndarray, dt: float, dx: float, dz: float) -> float:
    return float(velocity.max() * dt * np.hypot(1 / dx, 1 / dz))


def sponge(shape: tuple[int, int], width: int, strength: float) -> np.ndarray:
    """Weights of 1 inside, exp(-strength * d^2) within ``width`` of an edge, d counted from inside."""
    def side(n: int) -> np.ndarray:
        k = np.arange(n)
        return np.exp(-strength * np.maximum(0, min(width, max(shape)) - np.minimum(k, n - 1 - k)) ** 2.0)

    return np.outer(side(shape[0]), side(shape[1]))


def propagate(velocity: np.ndarray, wavelet: np.ndarray, dt: float, dx: float, dz: float, source: tuple[int, int], receivers: np.ndarray, width: int = 20, strength: float = 0.015) -> np.ndarray:
    """(receivers, times) of the scalar wave equation, second order in time and space; velocity is (x, z)."""
    speed, damp = (velocity * dt) ** 2, sponge(velocity.shape, width, strength)
    old, now = np.zeros(velocity.shape), np.zeros(velocity.shape)
    out = np.zeros((len(receivers), len(wavelet)))
    for step, push in enumerate(wavelet):
        new = 2 * now - old
        middle = now[1:-1, 1:-1]
        curve = (now[2:, 1:-1] - 2 * middle + now[:-2, 1:-1]) / dx**2 + (now[1:-1, 2:] - 2 * middle + now[1:-1, :-2]) / dz**2
        new[1:-1, 1:-1] += speed[1:-1, 1:-1] * curve
        new[source] += push
        new *= damp
        out[:, step] = new[receivers[:, 0], receivers[:, 1]]
        old, now = now * damp, new
    return out


def acoustic_survey(shots: DataFrame, model: Cube, time: Axis, frequency: float = 25.0, t0: float | None = None, width: int = 20, strength: float = 0.015) -> DataFrame:
    """(shot, i2, samples): a trace for each receiver of each shot; shots run side by side, one task a shot at a time.

    ``shots``: shot, sx, sz, rx, rz, the latter two arrays; all are indices of
    the model.  The model (axis 1 depth, axis 2 distance) must be within
    ``MOST_MODEL_BYTES``, as it goes to each task; an unstable step raises.
    """
    z, x = model.meta.axes
    if z.n * x.n * 8 > MOST_MODEL_BYTES:
        raise ValueError("the model is too large to go to each task")
    rows = model.traces().df.select("i2", "samples").collect()  # size checked above
    velocity = np.zeros((x.n, z.n))
    for r in rows:
        velocity[r["i2"]] = r["samples"]
    if not (velocity > 0).all() or not np.isfinite(velocity).all():
        raise ValueError("velocities are positive and finite")
    if stability(velocity, time.d, x.d, z.d) > 1:
        raise ValueError("the step is unstable")
    t = np.arange(time.n) * time.d
    square = (np.pi * frequency * (t - (1 / frequency if t0 is None else t0))) ** 2
    wavelet = (1 - 2 * square) * np.exp(-square)
    shared = shots.sparkSession.sparkContext.broadcast(velocity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shot, sx, sz, rx, rz in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                got = propagate(shared.value, wavelet, time.d, x.d, z.d, (sx, sz), np.array([rx, rz], np.int64).T.reshape(-1, 2), width, strength)
                yield pa.RecordBatch.from_arrays([pa.array([shot] * len(got), pa.int64()), pa.array(range(len(got)), pa.int64()), pa.array(list(got), pa.list_(pa.float64()))], names=["shot", "i2", "samples"])

    wanted = shots.select(F.col("shot").cast("long"), "sx", "sz", "rx", "rz")
    return wanted.repartition("shot").mapInArrow(run, "shot long, i2 long, samples array<double>")


def locate_velocity(picks: DataFrame, x: Axis, z: Axis, low: float | None = None, high: float | None = None, velocities: list[float] | None = None) -> DataFrame:
    """``gathers.locate`` with one unknown velocity, from low to high or of a list: (iz, ix, x, z, velocity, objective).

    At each point the best slowness is sum(w p t) / sum(w p^2), p the length of
    the path, held within the bounds; three sums a point leave a task, and give
    the objective of any velocity, so those of a list are tried on them alone
    (of equals the first in the list).
    """
    if (velocities is None) == (low is None and high is None):
        raise ValueError("bounds or a list of velocities")
    if velocities is None and not 0 < (low or 0) <= (high or 0) or velocities is not None and not (velocities and all(0 < v < float("inf") for v in velocities)):
        raise ValueError("velocities are positive, and bounds in order")
    cell = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(x.n * z.n - 1).cast("long"))).alias("cell")
    px, pz = F.lit(x.o) + (F.col("cell") % x.n) * x.d, F.lit(z.o) + F.floor(F.col("cell") / x.n) * z.d
    path = F.hypot(F.col("sx") - px, F.col("sz") - pz) + F.hypot(F.col("rx") - px, F.col("rz") - pz)
    rows = picks.select("sx", "sz", "rx", "rz", "observed", "weight", cell).withColumn("p", path)
    w, p, t = F.col("weight"), F.col("p"), F.col("observed")
    sums = rows.groupBy("cell").agg(F.sum(w * t * t).alias("tt"), F.sum(w * p * t).alias("pt"), F.sum(w * p * p).alias("pp"))
    cost = lambda slow: 0.5 * (F.col("tt") - 2 * slow * F.col("pt") + slow * slow * F.col("pp"))
    if velocities is None:
        slow = F.greatest(F.least(F.coalesce(F.try_divide("pt", "pp"), F.lit(1 / high)), F.lit(1 / low)), F.lit(1 / high))
        sums = sums.withColumn("slow", slow).withColumn("objective", cost(F.col("slow")))
    else:
        tried = F.array(*[F.struct(cost(F.lit(1 / v)).alias("objective"), F.lit(k).alias("k"), F.lit(1 / v).alias("slow")) for k, v in enumerate(velocities)])
        sums = sums.withColumn("tried", F.array_min(tried)).select("cell", "tried.objective", "tried.slow")
    best = sums.agg(F.min(F.struct("objective", "cell", "slow")).alias("b")).select("b.*").where("cell is not null")
    return best.select(F.floor(F.col("cell") / x.n).cast("long").alias("iz"), (F.col("cell") % x.n).alias("ix"), px.alias("x"), pz.alias("z"), (1 / F.col("slow")).alias("velocity"), "objective")
