"""Cubes made from parameters alone: each sample is a function of its indices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tracelake.cube import Axis, Cube, Meta, grid


def spike(spark: SparkSession, axes: tuple[Axis, ...], places: list[tuple[int, ...]], sizes: list[float] | None = None) -> Cube:
    """Zeros but for the given places (from 1, axis 1 first); sizes at one place add up."""
    sizes = sizes or [1.0] * len(places)
    value = F.lit(0.0)
    for place, size in zip(places, sizes, strict=True):
        if len(place) != len(axes) or any(not 1 <= k <= a.n for k, a in zip(place, axes, strict=True)):
            raise ValueError(f"place {place}")
        here = F.lit(True)
        for k, at in enumerate(place, 1):
            here = here & (F.col(f"i{k}") == at - 1)
        value = value + F.when(here, float(size)).otherwise(0.0)
    return Cube(grid(spark, axes).withColumn("v", value), Meta(axes))


def _uniform(keys: list[str], seed: int, salt: int) -> Column:
    """In (0, 1), from a hash of the indices, so alike however the cube is split."""
    bits = F.shiftrightunsigned(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed), F.lit(salt)), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def noise(c: Cube, level: float = 1.0, mean: float = 0.0, seed: int = 0, kind: str = "normal") -> Cube:
    """The cube's grid filled with noise: normal of deviation ``level``, or uniform in mean +- level."""
    own = c.long()
    u, w = _uniform(own.keys, seed, 0), _uniform(own.keys, seed, 1)
    drawn = F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * w) if kind == "normal" else 2 * u - 1
    return own.derive(own.df.withColumn("v", F.lit(mean) + F.lit(level) * drawn))


def add_noise(c: Cube, level: float = 1.0, mean: float = 0.0, seed: int = 0, kind: str = "normal") -> Cube:
    own = c.long()
    made = noise(own.derive(own.df.withColumnRenamed("v", "_v")), level, mean, seed, kind)
    return own.derive(made.df.withColumn("v", F.col("v") + F.col("_v")).drop("_v"))


def ricker(spark: SparkSession, frequency: float, time: Axis, peak: float | None = None, amplitude: float = 1.0) -> Cube:
    """Zero-phase wavelet of a peak frequency; its centre is at 1 / frequency unless given."""
    square = F.pow(np.pi * frequency * (F.col("i1") * time.d - (1 / frequency if peak is None else peak)), F.lit(2.0))
    return Cube(grid(spark, (time,)).withColumn("v", amplitude * (1 - 2 * square) * F.exp(-square)), Meta((time,)))
