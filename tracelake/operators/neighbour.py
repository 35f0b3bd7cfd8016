"""Local neighbourhoods along an axis.

Along axis 1 of traces they are NumPy kernels on whole traces, so nothing is
exchanged.  Along other axes the same kernels work on overlapping blocks of
traces (see ``blocks``), so no task holds a line.  Along axis 1 of samples they
are windows over a trace's samples.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.cube import Cube
from tracelake.operators import blocks


def _along(c: Cube, axis: int):
    return Window.partitionBy(*c.others(axis)).orderBy(f"i{axis}")


def _whole(c: Cube, axis: int) -> bool:
    """Whether every row holds all samples along the axis."""
    return axis == 1 and c.layout == "trace"


def _windows(x: np.ndarray, left: int, width: int, edge: bool = False) -> np.ndarray:
    """(traces, samples, width): the samples round each one, beyond the ends 0 or the end sample."""
    padded = np.pad(x, ((0, 0), (left, width - 1 - left)), mode="edge" if edge else "constant")
    return np.lib.stride_tricks.sliding_window_view(padded, width, axis=1)


def _differences(x: np.ndarray, method: str) -> np.ndarray:
    if x.shape[1] < 2:
        return np.zeros_like(x)
    step = np.diff(x, axis=1)
    forward, backward = np.concatenate([step, step[:, -1:]], axis=1), np.concatenate([step[:, :1], step], axis=1)
    return {"central": (forward + backward) / 2, "forward": forward, "backward": backward}[method]


def beside(df: DataFrame, keys: list[str], axis: int, n: int, columns: list[str]) -> DataFrame:
    """``columns`` of each row with those of the rows one before and after along an axis, as <name>_b and <name>_a (null at the ends).

    Each row goes to its own and two neighbouring places, so no task holds a line of the axis.
    """
    key = f"i{axis}"
    sides = df.withColumn("_side", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(key, F.col(key) + F.col("_side")).where(F.col(key).between(0, n - 1))
    pick = lambda name, side: F.first(F.when(F.col("_side") == side, F.col(name)), ignorenulls=True)
    return sides.groupBy(*keys).agg(*(pick(name, side).alias(name + end) for name in columns for side, end in ((1, "_b"), (0, ""), (-1, "_a"))))


def deriv(c: Cube, axis: int = 1, method: str = "central") -> Cube:
    d = c.meta.axis(axis).d
    kernel = lambda x: _differences(x, method) / d
    if axis > 1:
        return blocks.along(c, axis, kernel, 2)
    if _whole(c, axis):
        return c.map_traces(kernel)
    own = c.long()
    w = _along(own, axis)
    v, before, after = F.col("v"), F.lag("v").over(w), F.lead("v").over(w)
    value = {
        "central": F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2),
        "forward": F.coalesce(after - v, v - before),
        "backward": F.coalesce(v - before, after - v),
    }[method]
    return own.derive(own.df.withColumn("v", F.coalesce(value, F.lit(0.0)) / d))


def integrate(c: Cube, axis: int = 1, method: str = "sum", by_d: bool = False) -> Cube:
    """Running sum, or trapezoids from 0."""
    by = c.meta.axis(axis).d if by_d else 1.0
    terms = lambda x: x if method == "sum" else np.concatenate([np.zeros((len(x), 1)), (x[:, 1:] + x[:, :-1]) / 2], axis=1)
    if axis > 1:
        return blocks.running(c, axis, lambda x: terms(x) * by, 1)
    if _whole(c, axis):
        return c.map_traces(lambda x: np.cumsum(terms(x), axis=1) * by)
    own = c.long()
    w = _along(own, axis)
    v = F.col("v")
    term = v if method == "sum" else F.coalesce((v + F.lag("v").over(w)) / 2, F.lit(0.0))
    df = own.df.withColumn("t", term).withColumn("v", F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) * (own.meta.axis(axis).d if by_d else 1.0)).drop("t")
    return own.derive(df)


def local_rms(c: Cube, width: int, axis: int = 1) -> Cube:
    """Root of the windowed mean square over ``width`` samples, as far as there are any; even widths lean left."""
    left = width // 2
    kernel = lambda x: np.sqrt((_windows(x, left, width) ** 2).sum(axis=2) / _windows(np.ones_like(x[:1]), left, width).sum(axis=2))
    if axis > 1:
        return blocks.along(c, axis, kernel, width)
    if _whole(c, axis):
        return c.map_traces(kernel)
    own = c.long()
    w = _along(own, axis).rowsBetween(-left, width - 1 - left)
    return own.derive(own.df.withColumn("v", F.sqrt(F.sum(F.col("v") * F.col("v")).over(w) / F.count("v").over(w))))


def agc(c: Cube, rect: float, axis: int = 1, eps: float = 1e-12) -> Cube:
    """Sample over the local rms of a window of ``rect`` seconds padded with zeros; 0 where that is eps or less."""
    width = max(1, round(rect / c.meta.axis(axis).d))
    left = width // 2

    def kernel(x: np.ndarray) -> np.ndarray:
        rms = np.sqrt((_windows(x, left, width) ** 2).sum(axis=2) / width)
        return np.where(rms > eps, x / np.where(rms > eps, rms, 1), 0.0)

    if axis > 1:
        return blocks.along(c, axis, kernel, width)
    if _whole(c, axis):
        return c.map_traces(kernel)
    own = c.long()
    w = _along(own, axis).rowsBetween(-left, width - 1 - left)
    rms = F.sqrt(F.sum(F.col("v") * F.col("v")).over(w) / width)
    return own.derive(own.df.withColumn("r", rms).withColumn("v", F.when(F.col("r") > eps, F.try_divide("v", F.col("r"))).otherwise(0.0)).drop("r"))


def _weighted(own: Cube, axis: int, left: int, weights: list[float]) -> DataFrame:
    """``own`` with s, the weighted mean of the samples from ``left`` before on, ends repeated."""
    i, n = F.col(f"i{axis}"), own.meta.axis(axis).n
    whole, along = Window.partitionBy(*own.others(axis)), _along(own, axis)
    df = own.df.withColumn("_first", F.max(F.when(i == 0, F.col("v"))).over(whole)).withColumn("_last", F.max(F.when(i == n - 1, F.col("v"))).over(whole))
    total: Column = F.lit(0.0)
    for k, weight in enumerate(weights, -left):
        near = F.lag("v", -k).over(along) if k < 0 else F.lead("v", k).over(along) if k else F.col("v")
        total = total + F.coalesce(near, F.col("_first") if k < 0 else F.col("_last")) * float(weight)
    return df.withColumn("s", total / float(sum(weights)))


def smooth(c: Cube, r: int, axis: int = 1, kind: str = "box", repeat: int = 1) -> Cube:
    """Box of 2r - 1 samples with ends repeated, or triangle weights r - |k|; ``repeat`` times."""
    weights = [r - abs(k) if kind == "triangle" else 1 for k in range(1 - r, r)]

    def kernel(x: np.ndarray) -> np.ndarray:
        for _ in range(repeat):
            x = _windows(x, r - 1, 2 * r - 1, edge=True) @ (np.array(weights, float) / sum(weights))
        return x

    if axis > 1:
        return blocks.along(c, axis, kernel, repeat * (r - 1) + 1)
    if _whole(c, axis):
        return c.map_traces(kernel)
    own = c.long()
    for _ in range(repeat):
        own = own.derive(_weighted(own, axis, r - 1, weights).select(*own.keys, F.col("s").alias("v")))
    return own


def decimate(c: Cube, factor: int, axis: int = 1) -> Cube:
    """Moving average with ends repeated, then every ``factor``-th sample."""
    a, left = c.meta.axis(axis), (factor - 1) // 2
    n, d = -(-a.n // factor), a.d * factor
    if axis > 1:
        out = blocks.chosen(blocks.along(c, axis, lambda x: _windows(x, left, factor, edge=True).mean(axis=2), factor), axis, factor, n, d)
        return out if c.layout == "trace" else out.long()
    if _whole(c, axis):
        return c.map_traces(lambda x: _windows(x, left, factor, edge=True)[:, ::factor].mean(axis=2), replace(a, n=n, d=d))
    own, i = c.long(), F.col(f"i{axis}")
    out = _weighted(own, axis, left, [1] * factor).where(i % factor == 0)
    out = out.select(*[F.floor(i / factor).cast("long").alias(k) if k == f"i{axis}" else F.col(k) for k in own.keys], F.col("s").alias("v"))
    return own.derive(out, own.meta.with_axis(axis, n=n, d=d))


def laplacian(c: Cube, axes: list[int]) -> Cube:
    """Sum over axes of (centre - neighbour) / d^2, neighbours beyond an end left out."""
    bent = lambda d: lambda x: (np.diff(x, axis=1, prepend=x[:, :1]) - np.diff(x, axis=1, append=x[:, -1:])) / (d * d)
    own, total = c.traces(), None
    for axis in axes:
        kernel = bent(own.meta.axis(axis).d)
        part = own.map_traces(kernel) if axis == 1 else blocks.along(own, axis, kernel, 1)
        if total is None:
            total = part
            continue
        both = total.df.join(part.df.withColumnRenamed("samples", "_more"), own.keys[1:] or ["i2"])
        total = own.derive(both.select(*(own.keys[1:] or ["i2"]), F.zip_with("samples", "_more", lambda a, b: a + b).alias("samples")))
    return total if c.layout == "trace" else total.long()


def sobel_square(c: Cube) -> Cube:
    """Square of the Sobel gradient over axes 1 and 2, edges 0; a trace meets its two neighbours, whole."""
    own = c.traces()
    keys, (n1, n2) = own.keys[1:] or ["i2"], (*own.meta.shape, 1)[:2]
    zeros = F.array_repeat(F.lit(0.0), n1)
    if min(n1, n2) < 3:
        return own.derive(own.df.withColumn("samples", zeros))
    df = beside(own.df, keys, 2, n2, ["samples"])
    at = lambda name, i: F.element_at(name, i.cast("int"))
    step = lambda name, i: at(name, i + 2) - at(name, i)
    wide = lambda name, i: at(name, i) + 2 * at(name, i + 1) + at(name, i + 2)
    one = lambda i: step("samples_b", i) + 2 * step("samples", i) + step("samples_a", i)
    two = lambda i: wide("samples_a", i) - wide("samples_b", i)
    middle = F.transform(F.sequence(F.lit(1), F.lit(n1 - 2)), lambda i: one(i) * one(i) + two(i) * two(i))
    edge = F.array(F.lit(0.0))
    return own.derive(df.select(*keys, F.when(F.col("i2").between(1, n2 - 2), F.concat(edge, middle, edge)).otherwise(zeros).alias("samples")))


def sobel3(c: Cube, part: int = 0) -> Cube:
    """Sobel gradient over axes 1, 2 and 3, edges 0: the sum of squares (``part`` 0), or component 1, 2 or 3.

    A component is the difference along its axis of sums across the other two,
    weighted 1 at corners and 4 at sides and centre.  Whole traces meet their
    neighbours along axis 2, then along axis 3, so samples are never exploded.
    """
    if c.rank < 3:
        raise ValueError("three axes are needed")
    own = c.traces()
    keys, (n1, n2, n3) = own.keys[1:], own.meta.shape[:3]
    outer = lambda x: F.zip_with(x + "_b", x + "_a", lambda a, b: a + b)
    sum4 = lambda x: F.zip_with(outer(x), x, lambda a, b: a + 4 * b)
    step = lambda x: F.zip_with(x + "_b", x + "_a", lambda a, b: b - a)
    df = beside(own.df, keys, 2, n2, ["samples"]).select(*keys, "samples", sum4("samples").alias("a"), step("samples").alias("b"))
    df = beside(df, keys, 3, n3, ["samples", "a", "b"]).select(*keys, "samples", "b", sum4("a").alias("p"), sum4("b").alias("q"), step("a").alias("r"), step("samples").alias("s"))
    inner = F.col("i2").between(1, n2 - 2) & F.col("i3").between(1, n3 - 2)
    at = lambda name, i: F.element_at(name, i.cast("int"))
    wide = lambda name, i: at(name, i) + 4 * at(name, i + 1) + at(name, i + 2)
    one = lambda i: at("p", i + 2) - 12 * at("samples", i + 2) - at("p", i) + 12 * at("samples", i)
    two = lambda i: wide("q", i) - 12 * at("b", i + 1)
    three = lambda i: wide("r", i) - 12 * at("s", i + 1)
    value = {0: lambda i: (one(i) * one(i) + two(i) * two(i) + three(i) * three(i)) / 36, 1: lambda i: one(i) / 6, 2: lambda i: two(i) / 6, 3: lambda i: three(i) / 6}[part]
    zeros = F.array_repeat(F.lit(0.0), n1)
    if n1 < 3:
        return own.derive(own.df.withColumn("samples", zeros))
    middle = F.transform(F.sequence(F.lit(1), F.lit(n1 - 2)), value)
    edge = F.array(F.lit(0.0))
    return own.derive(df.select(*keys, F.when(inner, F.concat(edge, middle, edge)).otherwise(zeros).alias("samples")))


def demean(c: Cube, axis: int | None = 1) -> Cube:
    own = c.long()
    w = Window.partitionBy(*own.others(axis)) if axis else Window.partitionBy(F.lit(1))
    if axis is None:
        whole = own.df.agg(F.avg("v").alias("m"))
        return own.derive(own.df.join(F.broadcast(whole)).select(*own.keys, (F.col("v") - F.col("m")).alias("v")))
    if _whole(c, axis):
        return c.map_traces(lambda x: x - x.mean(axis=1, keepdims=True))
    return own.derive(own.df.withColumn("v", F.col("v") - F.avg("v").over(w)))


def detrend(c: Cube, axis: int = 1) -> Cube:
    """Minus the least-squares line of each trace."""
    if _whole(c, axis):

        def kernel(x: np.ndarray) -> np.ndarray:
            k = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2
            slope = x @ k / max((k * k).sum(), 1e-300)
            return x - x.mean(axis=1, keepdims=True) - slope[:, None] * k

        return c.map_traces(kernel)
    own = c.long()
    x = F.col(f"i{axis}").cast("double")
    w = Window.partitionBy(*own.others(axis))
    slope, level = F.regr_slope(F.col("v"), x).over(w), F.regr_intercept(F.col("v"), x).over(w)
    return own.derive(own.df.withColumn("s", F.col("v") - (F.coalesce(slope, F.lit(0.0)) * x + F.coalesce(level, F.col("v")))).select(*own.keys, F.col("s").alias("v")))


def reflectivity(c: Cube, eps: float) -> Cube:
    """(next - this) / (next + this + eps), last 0."""
    if _whole(c, 1):

        def kernel(x: np.ndarray) -> np.ndarray:
            below = x[:, 1:] + x[:, :-1] + eps
            return np.concatenate([np.where(below == 0, 0, np.diff(x, axis=1) / np.where(below == 0, 1, below)), np.zeros((len(x), 1))], axis=1)

        return c.map_traces(kernel)
    own = c.long()
    after = F.lead("v").over(_along(own, 1))
    return own.derive(own.df.withColumn("s", F.coalesce(F.try_divide(after - F.col("v"), after + F.col("v") + eps), F.lit(0.0))).select(*own.keys, F.col("s").alias("v")))


def impedance(c: Cube, start: float) -> Cube:
    """start times the product of (1 + r) / (1 - r) of the samples before."""
    factor = lambda r: (1 + r) / F.when(r == 1, F.raise_error(F.lit("reflectivity of 1"))).otherwise(1 - r)
    own = c.traces()
    running = F.aggregate("samples", F.array(F.lit(float(start))), lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) * factor(r))))
    return own.derive(own.df.withColumn("samples", F.slice(running, F.lit(1), F.size("samples"))))
