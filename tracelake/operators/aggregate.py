"""Reductions: partial aggregates, then one exchange on the remaining axes; along whole traces array functions, without any."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.cube import Axis, Cube, Meta, grid
from tracelake.operators import order, sums
from tracelake.operators.reshape import _renumber


def _skip(v: Column, omit: bool) -> Column:
    return F.nanvl(v, F.lit(None).cast("double")) if omit else v


def _value(stat: str, omit: bool, ddof: int) -> Column:
    v = _skip(F.col("v"), omit)
    n = F.count(v)
    spread = F.when(n > ddof, F.greatest(F.var_pop(v), F.lit(0.0)) * n / (n - ddof)).otherwise(F.lit(float("nan")))
    least = F.min(v) if omit else F.when(F.max(F.isnan("v")), F.lit(float("nan"))).otherwise(F.min("v"))
    middle = F.median(v) if omit else F.when(F.max(F.isnan("v")), F.lit(float("nan"))).otherwise(F.median("v"))
    return {"sum": F.sum(v), "mean": F.avg(v), "rms": F.sqrt(F.avg(v * v)), "var": spread, "std": F.sqrt(spread), "min": least, "max": F.max(v), "range": F.max(v) - least, "median": middle, "count": n.cast("double")}[stat]


def _of_trace(stat: str, omit: bool) -> Column:
    """The statistic of the array ``samples``."""
    x = F.filter("samples", lambda v: ~F.isnan(v)) if omit else F.col("samples")
    n = F.size(x)
    total = lambda value: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + value(v))
    some = lambda value: F.when(n > 0, value)
    mean = total(lambda v: v) / n
    odd = F.exists(x, F.isnan)
    put = F.array_sort(x)
    middle = (F.element_at(put, (F.floor((n - 1) / 2) + 1).cast("int")) + F.element_at(put, (F.floor(n / 2) + 1).cast("int"))) / 2
    nan = lambda value: some(F.when(odd, F.lit(float("nan"))).otherwise(value))
    return {"sum": lambda: some(total(lambda v: v)), "mean": lambda: some(mean), "rms": lambda: some(F.sqrt(total(lambda v: v * v) / n)), "min": lambda: nan(F.array_min(x)), "max": lambda: some(F.array_max(x)), "range": lambda: nan(F.array_max(x) - F.array_min(x)), "median": lambda: nan(middle), "count": lambda: n.cast("double")}[stat]()


def _spreads(x: np.ndarray, omit: bool, ddof: int) -> np.ndarray:
    """Variance of each row; NaN where there are no more samples than ``ddof``."""
    live = ~np.isnan(x) if omit else np.ones(x.shape, bool)
    n = live.sum(axis=1)
    mean = np.where(live, x, 0).sum(axis=1) / np.maximum(n, 1)
    square = (np.where(live, x - mean[:, None], 0) ** 2).sum(axis=1)
    return np.where(n > ddof, square / np.maximum(n - ddof, 1), np.nan)


def reduce(c: Cube, stat: str, axis: int | None = None, omit_nan: bool = False, ddof: int = 0) -> Cube:
    """sum, mean, rms, var, std, min, max, range, median or count over one axis or all."""
    if axis == 1 and c.layout == "trace" and stat in ("var", "std"):
        root = np.sqrt if stat == "std" else np.asarray
        rows = c.map_traces(lambda x: root(_spreads(x, omit_nan, ddof))[:, None], Axis(1)).df
        return _renumber(c, rows.select(*(c.keys[1:] or ["i2"]), F.element_at("samples", 1).alias("v")), 1, c.meta.without(1))
    if axis == 1 and c.layout == "trace":
        return _renumber(c, c.df.select(*(c.keys[1:] or ["i2"]), _of_trace(stat, omit_nan).alias("v")), 1, c.meta.without(1))
    own = c.long()
    value = _value(stat, omit_nan, ddof).alias("v")
    if axis is None and stat == "median":
        return quantile(c, [0.5], None, omit_nan)
    if axis is None:
        return Cube(own.df.agg(value).select(F.lit(0).cast("long").alias("i1"), "v"), Meta((Axis(1),)))
    return _renumber(own, own.df.groupBy(*own.others(axis)).agg(value), axis, own.meta.without(axis))


def quantile(c: Cube, q: list[float], axis: int | None = None, omit_nan: bool = False) -> Cube:
    """Linear-interpolated quantiles over an axis, which becomes that of the quantiles, or over all samples.

    A NaN makes every quantile of its line NaN, unless NaN is left out; a line without any sample is NaN.
    """
    step = q[1] - q[0] if len(q) > 1 else 1.0
    if axis is None:
        values = F.array(*[F.lit(float(x)) for x in order.quantiles(c.long().df, q, omit_nan=omit_nan)])
        return Cube(c.df.sparkSession.range(len(q)).select(F.col("id").alias("i1"), F.element_at(values, (F.col("id") + 1).cast("int")).alias("v")), Meta((Axis(len(q), q[0], step),)))
    if axis == 1 and c.layout == "trace":
        put, n = F.array_sort(F.filter("samples", lambda v: ~F.isnan(v)) if omit_nan else F.col("samples")), F.size("_put")
        odd = (n == 0) if omit_nan else F.isnan(F.element_at("_put", -1))  # NaN is last
        at = lambda x: F.floor(F.lit(float(x)) * (n - 1)).cast("int")
        part = lambda x: F.lit(float(x)) * (n - 1) - at(x)
        values = [F.when(odd, F.lit(float("nan"))).otherwise(F.get("_put", at(x)) * (1 - part(x)) + F.get("_put", F.least(at(x) + 1, n - 1)) * part(x)) for x in q]
        return c.derive(c.df.withColumn("_put", put).select(*(c.keys[1:] or ["i2"]), F.array(*values).alias("samples")), c.meta.with_axis(1, n=len(q), o=q[0], d=step))
    own = c.long()
    v = _skip(F.col("v"), True)
    nan = F.count(v) == 0 if omit_nan else F.max(F.isnan("v"))
    got = own.df.groupBy(*own.others(axis)).agg(F.percentile(v, q).alias("q"), nan.alias("nan"))
    values = F.when(F.col("nan"), F.array_repeat(F.lit(float("nan")), len(q))).otherwise(F.col("q"))
    df = got.select(*own.others(axis), F.posexplode(values).alias("k", "v")).withColumn(f"i{axis}", F.col("k").cast("long")).select(*own.keys, "v")
    return own.derive(df, own.meta.with_axis(axis, n=len(q), o=q[0], d=step))


def argmax(c: Cube, absolute: bool = False) -> DataFrame:
    """First largest sample of each trace: the other indices, value, index, coord."""
    if c.layout == "trace":
        ranks = F.transform("samples", F.abs) if absolute else F.col("samples")
        at = F.array_position(ranks, F.array_max(ranks))
        placed = c.df.select(*(c.keys[1:] or ["i2"]), "samples", at.alias("_at"))
        return placed.select(*(c.keys[1:] or ["i2"]), F.element_at("samples", F.col("_at").cast("int")).alias("value"), (F.col("_at") - 1).alias("index"), c.meta.axis(1).coordinate(F.col("_at") - 1).alias("coord"))
    own = c.long()
    rank = F.abs("v") if absolute else F.col("v")
    best = F.max(F.struct(rank.alias("r"), (-F.col("i1")).alias("k"), F.col("v").alias("v"))).alias("m")
    got = own.df.groupBy(*own.others(1)).agg(best)
    index = -F.col("m.k")
    return got.select(*own.others(1), F.col("m.v").alias("value"), index.alias("index"), own.meta.axis(1).coordinate(index).alias("coord"))


def extreme(c: Cube, kind: str) -> DataFrame:
    """Smallest or largest sample and its first flat index."""
    own = c.long()
    flat, step = F.lit(0).cast("long"), 1
    for k, a in enumerate(own.meta.axes, 1):
        flat, step = flat + F.col(f"i{k}") * step, step * a.n
    if kind == "min":
        return own.df.agg(F.min(F.struct("v", flat.alias("i"))).alias("m")).select(F.col("m.v").alias("value"), F.col("m.i").alias("index"))
    return own.df.agg(F.max(F.struct("v", (-flat).alias("i"))).alias("m")).select(F.col("m.v").alias("value"), (-F.col("m.i")).alias("index"))


def attributes(c: Cube) -> DataFrame:
    """count, min, max, mean, rms, var (ddof 1), nonzero, nan; NaN left out."""
    own = c.long()
    v = _skip(F.col("v"), True)
    return own.df.agg(
        F.count("*").alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rms"),
        F.var_samp(v).alias("var"), F.count_if(v != 0).alias("nonzero"), F.count_if(F.isnan("v")).alias("nan"),
    )


def histogram(c: Cube, bins: int, low: float, high: float, density: bool = False) -> DataFrame:
    """(bin, centre, value) of every bin; the last bin holds its right end."""
    own = c.long()
    if high == low:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    k = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1))
    got = own.df.where((F.col("v") >= low) & (F.col("v") <= high) & ~F.isnan("v")).groupBy(k.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    every = own.df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(got, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if density:
        total = got.agg(F.sum("n").alias("total"))
        return every.join(F.broadcast(total)).select("bin", (F.lit(low) + (F.col("bin") + 0.5) * width).alias("centre"), (F.col("n") / (F.col("total") * width)).alias("value"))
    return every.select("bin", (F.lit(low) + (F.col("bin") + 0.5) * width).alias("centre"), F.col("n").cast("double").alias("value"))


def otsu(hist: DataFrame) -> DataFrame:
    """Threshold that parts a histogram (bin, value) best: first maximum of the variance between classes."""
    from pyspark.sql import Window

    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(F.lit(1))
    w = hist.withColumn("w0", F.sum("value").over(upto)).withColumn("s0", F.sum(F.col("value") * F.col("bin")).over(upto))
    w = w.withColumn("w", F.sum("value").over(whole)).withColumn("s", F.sum(F.col("value") * F.col("bin")).over(whole))
    w1 = F.col("w") - F.col("w0")
    apart = F.try_divide("s0", "w0") - F.try_divide(F.col("s") - F.col("s0"), w1)
    between = F.coalesce(F.col("w0") * w1 * apart * apart, F.lit(0.0))
    return w.agg(F.max(F.struct(between.alias("b"), (-F.col("bin")).alias("k"))).alias("m")).select((-F.col("m.k") + 0.5).alias("threshold"))


def stack(c: Cube, axis: int = 2, mode: str = "mean", nonzero: bool = True) -> Cube:
    """Mean, sum or rms over an axis; ``nonzero`` counts live samples only, and none gives 0.

    Over axis 2 and up whole traces are added up inside tasks.
    """
    if axis > 1:
        own = c.traces()
        rest = [k for k in own.keys[1:] if k != f"i{axis}"]
        got = _trace_sums(own.df, rest, {k: "bigint" for k in rest}, mode, nonzero)
        names = {f"i{k}": f"i{k - 1}" for k in range(axis + 1, own.rank + 1)}
        df = got.withColumnsRenamed({k: f"_{v}" for k, v in names.items()}).withColumnsRenamed({f"_{v}": v for v in names.values()})
        return Cube(df if rest else df.withColumn("i2", F.lit(0).cast("long")), own.meta.without(axis), "trace")
    own = c.long()
    live = F.when((F.col("v") != 0) if nonzero else F.lit(True), F.col("v"))
    n = F.count(live)
    value = {"sum": F.coalesce(F.sum(live), F.lit(0.0)), "mean": F.coalesce(F.sum(live) / F.nullif(n, F.lit(0)), F.lit(0.0)), "rms": F.coalesce(F.sqrt(F.sum(live * live) / F.nullif(n, F.lit(0))), F.lit(0.0)), "count_nonzero": F.count_if(F.col("v") != 0).cast("double")}[mode]
    return _renumber(own, own.df.groupBy(*own.others(axis)).agg(value.alias("v")), axis, own.meta.without(axis))


def _trace_sums(rows: DataFrame, keys: list[str], kinds: dict[str, str], mode: str, nonzero: bool) -> DataFrame:
    """(keys, samples): traces of a key stacked sample by sample."""

    def kernel(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
        x = sums.matrix(batch)
        live = (x != 0) if nonzero else np.ones_like(x, bool)
        kept = np.where(live, x, 0.0)
        yield from sums.by_group(batch, keys)(np.concatenate([kept * kept if mode == "rms" else kept, live if mode != "count_nonzero" else x != 0], axis=1))

    got = sums.array_sums(rows.select(*keys, "samples"), kinds, kernel)
    half = F.size("sums") / 2
    total, count = F.slice("sums", F.lit(1), half.cast("int")), F.slice("sums", (half + 1).cast("int"), half.cast("int"))
    mean = F.zip_with(total, count, lambda s, n: F.when(n > 0, s / n).otherwise(0.0))
    value = {"sum": total, "mean": mean, "rms": F.transform(mean, F.sqrt), "count_nonzero": count}[mode]
    return got.select(*keys, value.alias("samples"))


def stack_by(c: Cube, gather: Column, mode: str = "mean", nonzero: bool = True) -> DataFrame:
    """(gather, samples): the traces of each gather stacked; a null gather is one as any other."""
    rows = c.traces().df.select(gather.alias("gather"), "samples")
    return _trace_sums(rows, ["gather"], {"gather": rows.schema["gather"].dataType.simpleString()}, mode, nonzero)


def difference(a: Cube, b: Cube, metric: str = "sum_square") -> DataFrame:
    x, y = a.long(), b.long()
    d = F.col("v") - F.col("w")
    value = {"sum_square": F.sum(d * d), "rms": F.sqrt(F.avg(d * d)), "max_abs": F.max(F.abs(d))}[metric]
    return x.df.join(y.df.withColumnRenamed("v", "w"), x.keys).agg(value.alias("value"))


def bin_1d(df: DataFrame, x: Column, value: Column, axis: Axis, statistic: str = "mean", fill: float = 0.0) -> DataFrame:
    """(i1, v): values in bins floor((x - o) / d), outside dropped, all bins present."""
    spark = df.sparkSession
    k = F.floor((x - axis.o) / axis.d).cast("long")
    agg = {"mean": F.avg(value), "sum": F.sum(value), "count": F.count(value).cast("double")}[statistic]
    got = df.where((k >= 0) & (k < axis.n)).groupBy(k.alias("i1")).agg(agg.alias("v"))
    return grid(spark, (axis,)).join(got, "i1", "left").select("i1", F.coalesce("v", F.lit(float(fill))).alias("v"))


def bin_2d(df: DataFrame, x: Column, y: Column, value: Column, axes: tuple[Axis, Axis], statistic: str = "mean", fill: float = 0.0) -> DataFrame:
    spark = df.sparkSession
    k1, k2 = (F.floor((c - a.o) / a.d).cast("long") for c, a in zip((x, y), axes, strict=True))
    agg = {"mean": F.avg(value), "sum": F.sum(value), "count": F.count(value).cast("double")}[statistic]
    inside = (k1 >= 0) & (k1 < axes[0].n) & (k2 >= 0) & (k2 < axes[1].n)
    got = df.where(inside).groupBy(k1.alias("i1"), k2.alias("i2")).agg(agg.alias("v"))
    return grid(spark, axes).join(got, ["i1", "i2"], "left").select("i1", "i2", F.coalesce("v", F.lit(float(fill))).alias("v"))


def fold(df: DataFrame, columns: list[Column], axes: tuple[Axis, Axis, Axis]) -> DataFrame:
    """Counts on a three-axis grid, nearest cell (half to even)."""
    ks = [F.rint((c - a.o) / a.d).cast("long") for c, a in zip(columns, axes, strict=True)]
    named = df.select(*(k.alias(f"i{n}") for n, k in enumerate(ks, 1)))
    for n, a in enumerate(axes, 1):
        named = named.where((F.col(f"i{n}") >= 0) & (F.col(f"i{n}") < a.n))
    got = named.groupBy("i1", "i2", "i3").agg(F.count("*").alias("v"))
    return grid(df.sparkSession, axes).join(got, ["i1", "i2", "i3"], "left").select("i1", "i2", "i3", F.coalesce("v", F.lit(0)).alias("v"))


def linefit(df: DataFrame, x: Column, y: Column, axis: Axis) -> DataFrame:
    """Least-squares line of (x, y), at the coordinates of ``axis``."""
    line = df.agg(F.regr_slope(y, x).alias("a"), F.regr_intercept(y, x).alias("b"))
    return grid(df.sparkSession, (axis,)).join(F.broadcast(line)).select("i1", (F.col("a") * axis.coordinate(F.col("i1")) + F.col("b")).alias("v"))


def normalize(c: Cube, mode: str = "max") -> Cube:
    """Over the largest magnitude or the rms of all finite samples; a factor of 0 counts as 1."""
    own = c.long()
    fine = F.when(~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v"))
    factor = own.df.agg((F.max(F.abs(fine)) if mode == "max" else F.sqrt(F.avg(fine * fine))).alias("f"))
    joined = own.df.join(F.broadcast(factor))
    return own.derive(joined.withColumn("v", F.col("v") / F.when(F.col("f") == 0, 1.0).otherwise(F.col("f"))).drop("f"))


def snr(c: Cube, signal: tuple[int, int], eps: float = 1e-12) -> DataFrame:
    """rms in the samples [from, to) over rms outside, in dB."""
    own = c.long()
    inside = (F.col("i1") >= signal[0]) & (F.col("i1") < signal[1])
    s = F.sqrt(F.avg(F.when(inside, F.col("v") * F.col("v"))))
    n = F.sqrt(F.avg(F.when(~inside, F.col("v") * F.col("v"))))
    return own.df.groupBy(*own.others(1)).agg((F.log10(F.greatest(s, F.lit(eps)) / F.greatest(n, F.lit(eps))) * 20).alias("v"))
