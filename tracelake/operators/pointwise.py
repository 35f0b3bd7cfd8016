"""Sample-wise operators (no shuffle, whole-stage code)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.cube import Cube
from tracelake.functions.expr import compile_expression, safe_log, safe_sqrt
from tracelake.operators import order

NAN = float("nan")


def absolute(c: Cube) -> Cube:
    return c.map(F.abs)


def sign(c: Cube) -> Cube:
    return c.map(lambda v: F.when(F.isnan(v), v).otherwise(F.signum(v)))


def sqrt(c: Cube) -> Cube:
    return c.map(safe_sqrt)


def log(c: Cube, base: float | None = None) -> Cube:
    return c.map(lambda v: safe_log(v) / (math.log(base) if base else 1.0))


def exp(c: Cube) -> Cube:
    return c.map(F.exp)


def power(c: Cube, exponent: float) -> Cube:
    return c.map(lambda v: F.pow(v, F.lit(float(exponent))))


def scale(c: Cube, factor: float) -> Cube:
    return c.map(lambda v: v * float(factor))


def math_expression(c: Cube, text: str) -> Cube:
    """``input``/``data`` is the sample, x1 .. xN the coordinates."""
    own = c.long()
    names = {"input": F.col("v"), "data": F.col("v"), **{f"x{k}": own.coordinate(k) for k in range(1, own.rank + 1)}}
    return own.derive(own.df.withColumn("v", compile_expression(text, names)))


def combine(a: Cube, b: Cube, how: str, zero: str = "raise") -> Cube:
    """add, multiply or divide of two cubes of one shape, joined on all indices, or whole traces on theirs.

    Cubes that are functions of the same samples are not joined.
    """
    if a.meta.shape != b.meta.shape:
        raise ValueError("cubes differ in shape")
    own = a if a.layout == b.layout else a.long()
    value = {"add": lambda v, w: v + w, "mul": lambda v, w: v * w, "sub": lambda v, w: v - w, "div": lambda v, w: _divide(v, w, zero)}[how]
    both = own.beside(b)
    if own.layout == "trace":
        return own.derive(both.withColumn("samples", F.zip_with("samples", "_other", value)).drop("_other"))
    return own.derive(both.withColumn("v", value(F.col("v"), F.col("_other"))).drop("_other"))


def _divide(v: Column, w: Column, zero: str) -> Column:
    if zero == "raise":
        return v / F.when(w == 0, F.raise_error(F.lit("division by zero"))).otherwise(w)
    if zero == "nan":
        return F.when(w == 0, F.lit(NAN)).otherwise(F.try_divide(v, w))
    whole = F.when(v == 0, F.lit(NAN)).otherwise(F.signum(v) * float("inf"))
    return F.when(w == 0, whole).otherwise(F.try_divide(v, w))


def tpow(c: Cube, exponent: float = 1.0, axis: int = 1) -> Cube:
    """Times coordinate to a power; 0 at or below 0 for a fractional power."""
    own = c.long()
    x = own.coordinate(axis)
    factor = F.pow(x, F.lit(float(exponent)))
    if exponent != int(exponent):
        factor = F.when(x <= 0, 0.0).otherwise(factor)
    return own.derive(own.df.withColumn("v", F.col("v") * factor))


def gain(c: Cube, exponent: float = 1.0, axis: int = 1, factor: float = 1.0, exponential: float = 0.0) -> Cube:
    """Times factor * t^exponent * exp(exponential * t) with t = o + (i + 1) d."""
    own = c.long()
    a = own.meta.axis(axis)
    t = F.lit(a.o) + (F.col(f"i{axis}") + 1) * a.d
    return own.derive(own.df.withColumn("v", F.col("v") * factor * F.pow(t, F.lit(float(exponent))) * F.exp(t * exponential)))


def clip(c: Cube, limit: float, value: float | None = None) -> Cube:
    """Beyond +-limit, and where not finite, +-value by sign."""
    to = limit if value is None else value
    return c.map(lambda v: F.when(F.isnan(v) | (F.abs(v) > limit), F.when(v < 0, -to).otherwise(to)).otherwise(v))


def _finite(c: Cube) -> DataFrame:
    return c.long().df.where(~_odd(F.col("v"), "nonfinite"))


def _percent(p: float) -> float:
    if not 0 < p <= 100:
        raise ValueError("a percentage is above 0 and at most 100")
    return p / 100


def clip_bounds(c: Cube, low: float | None = None, high: float | None = None, pclip: float | None = None, symmetric: bool = False) -> Cube:
    """Between bounds: given ones, or those of the central ``pclip`` percent of all finite samples.

    ``symmetric``: +- the ``pclip`` percentile of magnitudes, or +- the one
    bound, or the two equal ones, that are given.
    """
    if pclip is not None:
        if low is not None or high is not None:
            raise ValueError("pclip or bounds")
        p, fine = _percent(pclip), _finite(c)
        got = order.quantiles(fine.select(F.abs("v").alias("v")), [p]) if symmetric else order.quantiles(fine, [(1 - p) / 2, (1 + p) / 2])
        if math.isnan(got[0]):
            raise ValueError("no finite samples")
        low, high = (-got[0], got[0]) if symmetric else got
    elif low is None and high is None:
        raise ValueError("pclip or bounds")
    elif symmetric:
        limits = [abs(float(x)) for x in (low, high) if x is not None]
        if not math.isclose(limits[0], limits[-1], rel_tol=1e-5, abs_tol=1e-8):
            raise ValueError("symmetric bounds differ")
        low, high = -limits[0], limits[0]
    if low is not None and high is not None and low > high:
        raise ValueError("bounds are out of order")

    def bound(v: Column) -> Column:
        v = v if low is None else F.when(F.isnan(v), v).otherwise(F.greatest(v, F.lit(float(low))))
        return v if high is None else F.when(F.isnan(v), v).otherwise(F.least(v, F.lit(float(high))))

    return c.map(bound)


def tclip(c: Cube, lower: float = 0.2, upper: float = 0.8) -> Cube:
    return c.map(lambda v: F.when(v < lower, 0.0).when((v > upper) & ~F.isnan(v), 1.0).otherwise(v))


def threshold(c: Cube, value: float, mode: str = "hard", substitute: float = 0.0) -> Cube:
    if mode == "hard":
        return c.map(lambda v: F.when(F.abs(v) < value, float(substitute)).otherwise(v))
    if mode != "soft":
        raise ValueError("mode is hard or soft")
    return c.map(lambda v: F.signum(v) * F.greatest(F.abs(v) - value, F.lit(0.0)))


def mask(c: Cube, low: float | None = None, high: float | None = None) -> Cube:
    def inside(v: Column) -> Column:
        good = ~F.isnan(v)
        good = good if low is None else good & (v >= low)
        good = good if high is None else good & (v <= high)
        return good.cast("double")

    return c.map(inside)


def is_nan(c: Cube, mode: str = "nan") -> Cube:
    return c.map(lambda v: _odd(v, mode).cast("double"))


def _odd(v: Column, mode: str) -> Column:
    infinite = F.abs(v) == float("inf")
    return {"nan": F.isnan(v), "inf": infinite, "nonfinite": F.isnan(v) | infinite, "finite": ~(F.isnan(v) | infinite)}[mode]


def fill_nan(c: Cube, value: float = 0.0, mode: str = "nan") -> Cube:
    return c.map(lambda v: F.when(_odd(v, mode), float(value)).otherwise(v))


def _byte_limits(c: Cube, limit: float | None, bias: float | None, positive: bool, pclip: float | None) -> tuple[float, float]:
    middle = bias or 0.0
    if limit is not None:
        if not limit > 0 or math.isinf(limit):
            raise ValueError("a limit is positive and finite")
        return (middle, middle + limit) if positive else (middle - limit, middle + limit)
    fine = _finite(c)
    from_middle = F.col("v") - middle
    if pclip is not None:
        own = fine.select((from_middle if positive else F.abs(from_middle)).alias("v"))
        width = order.quantiles(own.where("v > 0") if positive else own, [_percent(pclip)])[0]
        width = 0.0 if math.isnan(width) else width
        return (middle, middle + width) if positive else (middle - width, middle + width)
    least, most, far = fine.agg(F.min("v"), F.max("v"), F.max(F.abs(from_middle))).first()
    if least is None:
        raise ValueError("no finite samples")
    return (middle, most) if positive else (least, most) if bias is None else (middle - far, middle + far)


def byte_scale(c: Cube, limit: float | None = None, bias: float | None = None, positive: bool = False, pclip: float | None = None) -> Cube:
    """0 .. 255 (half to even) over bias +- limit, or with ``positive`` over bias .. bias + limit.

    Without a limit, the ``pclip`` percentile of the distances from the bias
    (with ``positive`` of those above it) is it; without either, the samples'
    range. Samples that are not finite are 0, as is all where the range is empty.
    """
    low, high = _byte_limits(c, limit, bias, positive, pclip)
    if high <= low:
        return c.map(lambda v: F.lit(0.0))
    squeezed = lambda v: F.greatest(F.least(v, F.lit(float(high))), F.lit(float(low)))
    return c.map(lambda v: F.when(_odd(v, "nonfinite"), 0.0).otherwise(F.rint((squeezed(v) - low) * 255.0 / (high - low))))


def cosine_taper(c: Cube, widths: dict[int, int]) -> Cube:
    """Edge weights sin^2(pi k / 2 / (width + 1)), k = 1 .. width, axis by axis."""
    own = c.long()
    value = F.col("v")
    for axis, width in widths.items():
        n = own.meta.axis(axis).n
        if 2 * width > n:
            raise ValueError("tapers overlap")
        if width:
            i = F.col(f"i{axis}")
            k = F.least(i, F.lit(n - 1) - i) + 1
            value = value * F.when(k <= width, F.pow(F.sin(k * math.pi / (2 * (width + 1))), F.lit(2.0))).otherwise(1.0)
    return own.derive(own.df.withColumn("v", value))


def mute(c: Cube, t0: float, velocity: float, offset: Column, taper: float = 0.0) -> Cube:
    """0 before t0 + |offset| / velocity; sin^2 over ``taper`` seconds after it."""
    own = c.long()
    late = own.coordinate(1) - (F.lit(t0) + F.abs(offset) / velocity)
    weight = F.when(late < 0, 0.0)
    if taper > 0:
        weight = weight.when(late < taper, F.pow(F.sin(late / taper * (math.pi / 2)), F.lit(2.0)))
    return own.derive(own.df.withColumn("v", F.col("v") * weight.otherwise(1.0)))


def with_axis_values(c: Cube, values: DataFrame, axis: int, how: str = "mul") -> Cube:
    """Every sample and the value of its place along an axis, ``values(i, w)``: add, sub, mul or div; places without a value count as 0."""
    own = c.traces() if axis > 1 else c.long()
    key = f"i{axis}"
    joined = own.df.join(values.select(F.col("i").alias(key), F.col("w").cast("double").alias("w")), key, "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    value = {"add": lambda v: v + F.col("w"), "sub": lambda v: v - F.col("w"), "mul": lambda v: v * F.col("w"), "div": lambda v: _divide(v, F.col("w"), "inf")}[how]
    if own.layout == "trace":
        return own.derive(joined.select(*(own.keys[1:] or ["i2"]), F.transform("samples", value).alias("samples")))
    return own.derive(joined.select(*own.keys, value(F.col("v")).alias("v")))
