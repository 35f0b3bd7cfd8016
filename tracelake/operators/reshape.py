"""Selections, axis edits and concatenation: index arithmetic only."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.cube import Axis, Cube, Meta, grid


def window(c: Cube, axis: int, f: int = 0, n: int | None = None, j: int = 1) -> Cube:
    """n samples from f in steps of j; a negative f counts from the end."""
    own, a = c.long(), c.meta.axis(axis)
    f = f + a.n if f < 0 else f
    n = -(-(a.n - f) // j) if n is None else n
    if n < 1 or f < 0 or f + (n - 1) * j >= a.n:
        raise ValueError("window is outside the axis")
    i = F.col(f"i{axis}")
    kept = own.df.where((i >= f) & (i <= f + (n - 1) * j) & ((i - f) % j == 0)).withColumn(f"i{axis}", F.floor((i - f) / j).cast("long"))
    return own.derive(kept, own.meta.with_axis(axis, n=n, o=a.o + f * a.d, d=a.d * j))


def slice_axis(c: Cube, axis: int, index: int = 0) -> Cube:
    own = c.long()
    kept = own.df.where(F.col(f"i{axis}") == index)
    return _renumber(own, kept, axis, own.meta.without(axis))


def _renumber(c: Cube, df: DataFrame, dropped: int, meta: Meta) -> Cube:
    cols = [F.col(k).alias(f"i{n}") for n, k in enumerate(c.others(dropped), 1)] or [F.lit(0).cast("long").alias("i1")]
    return Cube(df.select(*cols, "v"), meta)


def cut(c: Cube, axis: int, f: int = 0, n: int | None = None, j: int = 1) -> Cube:
    own, size = c.long(), c.meta.axis(axis).n
    n = -(-(size - f) // j) if n is None else n
    i = F.col(f"i{axis}")
    inside = (i >= f) & (i <= f + (n - 1) * j) & ((i - f) % j == 0)
    return own.derive(own.df.withColumn("v", F.when(inside, 0.0).otherwise(F.col("v"))))


def reverse(c: Cube, axis: int = 1) -> Cube:
    own, a = c.long(), c.meta.axis(axis)
    df = own.df.withColumn(f"i{axis}", F.lit(a.n - 1) - F.col(f"i{axis}"))
    return own.derive(df, own.meta.with_axis(axis, o=a.o + (a.n - 1) * a.d, d=-a.d))


def rotate(c: Cube, axis: int, by: int) -> Cube:
    own, n = c.long(), c.meta.axis(axis).n
    return own.derive(own.df.withColumn(f"i{axis}", F.pmod(F.col(f"i{axis}") - by, F.lit(n)).cast("long")))


def shift(c: Cube, by: int, axis: int = 1, fill: float = 0.0) -> Cube:
    """Samples move up by ``by``; what comes in is ``fill``."""
    own, n = c.long(), c.meta.axis(axis).n
    i = F.col(f"i{axis}")
    filled = own.df.withColumn("v", F.when((i + by < 0) | (i + by >= n), float(fill)).otherwise(F.col("v")))
    return own.derive(filled.withColumn(f"i{axis}", F.pmod(i + by, F.lit(n)).cast("long")))


def transpose(c: Cube, order: tuple[int, ...]) -> Cube:
    own = c.long()
    if sorted(order) != list(range(1, own.rank + 1)):
        raise ValueError("order must name every axis once")
    cols = [F.col(f"i{k}").alias(f"i{n}") for n, k in enumerate(order, 1)]
    return own.derive(own.df.select(*cols, "v"), replace(own.meta, axes=tuple(own.meta.axis(k) for k in order)))


def reshape(c: Cube, shape: tuple[int, ...]) -> Cube:
    """Other axes over the same linear order."""
    own = c.long()
    linear, step = F.lit(0).cast("long"), 1
    for k, a in enumerate(own.meta.axes, 1):
        linear, step = linear + F.col(f"i{k}") * step, step * a.n
    total, cols = 1, []
    for k, n in enumerate(shape, 1):
        cols.append((F.floor(linear / total).cast("long") % n).alias(f"i{k}"))
        total *= n
    if total != step:
        raise ValueError("sizes differ")
    return own.derive(own.df.select(*cols, "v"), Meta(tuple(map(Axis, shape)), own.meta.attrs))


def pad(c: Cube, axis: int, beg: int = 0, end: int = 0, value: float = 0.0) -> Cube:
    own, a = c.long(), c.meta.axis(axis)
    moved = own.df.withColumn(f"i{axis}", F.col(f"i{axis}") + beg)
    if not beg + end:
        return own
    # new samples come from each trace's first row, so no grid is joined
    new = F.array(*[F.lit(k).cast("long") for k in [*range(beg), *range(beg + a.n, beg + a.n + end)]])
    edge = own.df.where(F.col(f"i{axis}") == 0).withColumn(f"i{axis}", F.explode(new)).withColumn("v", F.lit(float(value)))
    return own.derive(moved.unionByName(edge), own.meta.with_axis(axis, n=a.n + beg + end, o=a.o - beg * a.d))


def spray(c: Cube, axis: int, n: int, o: float = 0.0, d: float = 1.0) -> Cube:
    """A new axis of n copies."""
    own = c.long()
    cols = [F.col(f"i{k}").alias(f"i{k if k < axis else k + 1}") for k in range(1, own.rank + 1)]
    df = own.df.select(*cols, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(f"i{axis}"), "v")
    axes = (*own.meta.axes[: axis - 1], Axis(n, o, d), *own.meta.axes[axis - 1 :])
    return own.derive(df, replace(own.meta, axes=axes))


def tile(c: Cube, axis: int, repeat: int) -> Cube:
    own, a = c.long(), c.meta.axis(axis)
    df = own.df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1)))).withColumn(f"i{axis}", F.col(f"i{axis}") + F.col("_k") * a.n).drop("_k")
    return own.derive(df, own.meta.with_axis(axis, n=a.n * repeat))


def lpad(c: Cube, axis: int = 2, jump: int = 2) -> Cube:
    """Zeros between the samples of an axis."""
    own, a = c.long(), c.meta.axis(axis)
    k = F.explode(F.sequence(F.lit(0), F.lit(jump - 1)))
    df = own.df.withColumn("_k", k).withColumn("v", F.when(F.col("_k") == 0, F.col("v")).otherwise(0.0)).withColumn(f"i{axis}", F.col(f"i{axis}") * jump + F.col("_k")).drop("_k")
    return own.derive(df, own.meta.with_axis(axis, n=a.n * jump, d=a.d / jump))


def cat(cubes: list[Cube], axis: int) -> Cube:
    own = [c.long() for c in cubes]
    at, df = 0, None
    for c in own:
        for k, (a, b) in enumerate(zip(own[0].meta.axes, c.meta.axes, strict=True), 1):
            if k != axis and (a.n != b.n or abs(a.o - b.o) > 1e-6 or abs(a.d - b.d) > 1e-6):
                raise ValueError("axes differ")
        part = c.df.withColumn(f"i{axis}", F.col(f"i{axis}") + at)
        df, at = part if df is None else df.unionByName(part), at + c.meta.axis(axis).n
    return own[0].derive(df, own[0].meta.with_axis(axis, n=at))


def interleave(cubes: list[Cube], axis: int = 1) -> Cube:
    own, m, df = [c.long() for c in cubes], len(cubes), None
    for j, c in enumerate(own):
        part = c.df.withColumn(f"i{axis}", F.col(f"i{axis}") * m + j)
        df = part if df is None else df.unionByName(part)
    return own[0].derive(df, own[0].meta.with_axis(axis, n=own[0].meta.axis(axis).n * m))


def dense(c: Cube, fill: float = 0.0) -> Cube:
    """All cells of the axes; those without a row are ``fill``."""
    own = c.long()
    every = grid(own.df.sparkSession, own.meta.axes)
    return own.derive(every.join(own.df, own.keys, "left").withColumn("v", F.coalesce("v", F.lit(float(fill)))))
