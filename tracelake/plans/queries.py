"""Registered queries over the driver's tables, each with its DuckDB twin.

``embeddings`` is a panel of traces (axis 1: the 64 components, axis 2: vec_id,
gather key: label); ``events`` are irregular samples; ``lineitem``, ``orders``
and ``part`` are header tables.  Floats are rounded to six decimals on both
sides, as sums may be taken in any order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.cube import Axis, Cube, Meta, from_traces
from tracelake.operators import aggregate as agg
from tracelake.operators import complexes, cross, filters, gathers, generators, headers, metrics, modelling, neighbour, pointwise, resample, reshape, runs, scatter, solvers, spectral
from tracelake.sources import planned, rsf, segy
from tracelake.streaming import binning

N, DT = 64, 0.004
TIME = Axis(N, 0.0, DT, "Time", "s")
#: The panel in DuckDB.
PANEL = "(SELECT vec_id AS i2, label, unnest(range(64)) AS i1, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
#: One-sided transform of every trace in DuckDB.
DFT = f"(SELECT i2, k AS i1, sum(v * cos(2 * pi() * i1 * k / 64)) AS re, -sum(v * sin(2 * pi() * i1 * k / 64)) AS im FROM {PANEL}, range(33) r(k) GROUP BY i2, k)"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> Cube:
    df = table(spark, sf_dir, "embeddings")
    return from_traces(df, "vec_id", "embedding", N, max(1, df.count()), TIME)


def rounded(out: Cube | DataFrame) -> DataFrame:
    if isinstance(out, Cube):
        out = out.long().df.select(*out.keys, "v")
    return out.select(*[(F.round(c, 6) + 0.0).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in out.dtypes])


def register(name: str, query: Callable[[Cube], Cube | DataFrame] | None = None, sql: str | None = None, plain: Query | None = None) -> None:
    """``query`` of the panel, or ``plain`` of session and folder."""
    QUERIES[name] = (lambda spark, sf_dir: rounded(query(panel(spark, sf_dir)))) if query else (lambda spark, sf_dir: rounded(plain(spark, sf_dir)))
    if sql:
        ORACLES[name] = sql


def sample(name: str, query: Callable[[Cube], Cube], value: str) -> None:
    """A query whose twin is one expression of v, i1, i2."""
    register(name, query, f"SELECT i1, i2, round({value}, 6) + 0.0 AS v FROM {PANEL}")


# sample-wise functions
sample("abs", pointwise.absolute, "abs(v)")
sample("sign", pointwise.sign, "sign(v)::DOUBLE")
sample("sqrt", lambda c: pointwise.sqrt(pointwise.absolute(c)), "sqrt(abs(v))")
sample("log", lambda c: pointwise.log(c.map(lambda v: F.abs(v) + 1.0)), "ln(abs(v) + 1)")
sample("log10", lambda c: pointwise.log(c.map(lambda v: F.abs(v) + 1.0), 10.0), "ln(abs(v) + 1) / ln(10.0)")
sample("exp", pointwise.exp, "exp(v)")
sample("pow", lambda c: pointwise.power(c, 3), "pow(v, 3)")
sample("scale", lambda c: pointwise.scale(c, 2.5), "v * 2.5")
sample("math", lambda c: pointwise.math_expression(c, "input*x1 + sin(x2)^2 - pi"), "v * (i1 * 0.004) + pow(sin(i2), 2) - pi()")
sample("add", lambda c: pointwise.combine(c, c.map(lambda v: v * v), "add"), "v + v * v")
sample("mul", lambda c: pointwise.combine(c, c.map(lambda v: v + 1), "mul"), "v * (v + 1)")
sample("sub", lambda c: pointwise.combine(c, c.map(F.abs), "sub"), "v - abs(v)")
sample("div", lambda c: pointwise.combine(c, c.map(lambda v: v * v + 1), "div", "inf"), "v / (v * v + 1)")
sample("tpow", lambda c: pointwise.tpow(c, 1.5), "v * CASE WHEN i1 = 0 THEN 0 ELSE pow(i1 * 0.004, 1.5) END")
sample("gain", lambda c: pointwise.gain(c, 2.0, 1, 3.0, 0.5), "v * 3 * pow((i1 + 1) * 0.004, 2) * exp((i1 + 1) * 0.004 * 0.5)")
sample("clip", lambda c: pointwise.clip(c, 0.5), "CASE WHEN abs(v) > 0.5 THEN sign(v) * 0.5 ELSE v END")
sample("clip2", lambda c: pointwise.clip_bounds(c, -0.3, 0.6), "least(greatest(v, -0.3), 0.6)")
sample("tclip", pointwise.tclip, "CASE WHEN v < 0.2 THEN 0 WHEN v > 0.8 THEN 1 ELSE v END")
sample("threshold_hard", lambda c: pointwise.threshold(c, 0.4), "CASE WHEN abs(v) < 0.4 THEN 0 ELSE v END")
sample("threshold_soft", lambda c: pointwise.threshold(c, 0.4, "soft"), "sign(v) * greatest(abs(v) - 0.4, 0)")
sample("mask", lambda c: pointwise.mask(c, -0.5, 0.5), "CASE WHEN v BETWEEN -0.5 AND 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE")
sample("isnan", pointwise.is_nan, "isnan(v)::INT::DOUBLE")
sample("fillnan", lambda c: pointwise.fill_nan(c.map(lambda v: F.when(v > 0.5, F.lit(float("nan"))).otherwise(v)), -1.0), "CASE WHEN v > 0.5 THEN -1 ELSE v END")
sample("byte", lambda c: pointwise.byte_scale(c, 1.0), "round_even((greatest(least(v, 1.0), -1.0) + 1) * 255.0 / 2, 0)")
_ABOVE = f"(SELECT quantile_cont(v - 0.1, 0.9) FROM {PANEL} WHERE v - 0.1 > 0)"
sample("clip2_pclip", lambda c: pointwise.clip_bounds(c, pclip=90.0), f"least(greatest(v, (SELECT quantile_cont(v, 0.05) FROM {PANEL})), (SELECT quantile_cont(v, 0.95) FROM {PANEL}))")
sample("clip2_symmetric", lambda c: pointwise.clip_bounds(c, pclip=80.0, symmetric=True), f"least(greatest(v, -(SELECT quantile_cont(abs(v), 0.8) FROM {PANEL})), (SELECT quantile_cont(abs(v), 0.8) FROM {PANEL}))")
sample("byte_pclip", lambda c: pointwise.byte_scale(c, pclip=95.0, bias=0.1), f"round_even((greatest(least(v, 0.1 + w), 0.1 - w) - (0.1 - w)) * 255.0 / (0.1 + w - (0.1 - w)), 0)".replace("w", f"(SELECT quantile_cont(abs(v - 0.1), 0.95) FROM {PANEL})"))
sample("byte_positive", lambda c: pointwise.byte_scale(c, pclip=90.0, bias=0.1, positive=True), f"round_even((greatest(least(v, 0.1 + {_ABOVE}), 0.1) - 0.1) * 255.0 / {_ABOVE}, 0)")
sample("byte_range", lambda c: pointwise.byte_scale(c), f"round_even((v - (SELECT min(v) FROM {PANEL})) * 255.0 / (SELECT max(v) - min(v) FROM {PANEL}), 0)")
sample("costaper", lambda c: pointwise.cosine_taper(c, {1: 8}), "v * CASE WHEN least(i1, 63 - i1) < 8 THEN pow(sin((least(i1, 63 - i1) + 1) * pi() / 18), 2) ELSE 1 END")
sample("mute", lambda c: pointwise.mute(c, 0.02, 1500.0, F.pmod(F.col("i2"), F.lit(50)) * 2.0, 0.03), "v * CASE WHEN i1 * 0.004 - (0.02 + abs((i2 % 50) * 2.0) / 1500) < 0 THEN 0 WHEN i1 * 0.004 - (0.02 + abs((i2 % 50) * 2.0) / 1500) < 0.03 THEN pow(sin((i1 * 0.004 - (0.02 + abs((i2 % 50) * 2.0) / 1500)) / 0.03 * pi() / 2), 2) ELSE 1 END")

# selections and axis edits
register("window", lambda c: reshape.window(c, 1, 4, 10, 3), f"SELECT (i1 - 4) // 3 AS i1, i2, round(v, 6) + 0.0 AS v FROM {PANEL} WHERE i1 BETWEEN 4 AND 31 AND (i1 - 4) % 3 = 0")
register("slice", lambda c: reshape.slice_axis(c, 1, 7), f"SELECT i2 AS i1, round(v, 6) + 0.0 AS v FROM {PANEL} WHERE i1 = 7")
sample("cut", lambda c: reshape.cut(c, 1, 10, 5, 2), "CASE WHEN i1 BETWEEN 10 AND 18 AND (i1 - 10) % 2 = 0 THEN 0 ELSE v END")
register("reverse", reshape.reverse, f"SELECT 63 - i1 AS i1, i2, round(v, 6) + 0.0 AS v FROM {PANEL}")
register("rotate", lambda c: reshape.rotate(c, 1, 5), f"SELECT (i1 - 5 + 64) % 64 AS i1, i2, round(v, 6) + 0.0 AS v FROM {PANEL}")
register("shift", lambda c: reshape.shift(c, 3), f"SELECT (i1 + 3) % 64 AS i1, i2, CASE WHEN i1 + 3 > 63 THEN 0 ELSE round(v, 6) + 0.0 END AS v FROM {PANEL}")
register("transp", lambda c: reshape.transpose(c, (2, 1)), f"SELECT i2 AS i1, i1 AS i2, round(v, 6) + 0.0 AS v FROM {PANEL}")
register("reshape", lambda c: reshape.reshape(c, (16, 4, c.meta.shape[1])), f"SELECT i1 % 16 AS i1, i1 // 16 AS i2, i2 AS i3, round(v, 6) + 0.0 AS v FROM {PANEL}")
register("pad", lambda c: reshape.pad(c, 1, 2, 3, -9.0), f"SELECT i1 + 2 AS i1, i2, round(v, 6) + 0.0 AS v FROM {PANEL} UNION ALL SELECT k, vec_id, -9.0::DOUBLE FROM embeddings, (SELECT unnest([0, 1, 66, 67, 68])::BIGINT AS k)")
register("lpad", reshape.lpad, f"SELECT i1, i2 * 2 AS i2, round(v, 6) + 0.0 AS v FROM {PANEL} UNION ALL SELECT i1, i2 * 2 + 1, 0.0::DOUBLE FROM {PANEL}")
register("spray", lambda c: reshape.spray(c, 2, 3), f"SELECT i1, k AS i2, i2 AS i3, round(v, 6) + 0.0 AS v FROM {PANEL}, range(3) r(k)")
register("tile", lambda c: reshape.tile(c, 1, 2), f"SELECT i1 + 64 * k AS i1, i2, round(v, 6) + 0.0 AS v FROM {PANEL}, range(2) r(k)")
register("cat", lambda c: reshape.cat([c, pointwise.scale(c, 2)], 1), f"SELECT i1, i2, round(v, 6) + 0.0 AS v FROM {PANEL} UNION ALL SELECT i1 + 64, i2, round(v * 2, 6) + 0.0 FROM {PANEL}")
register("interleave", lambda c: reshape.interleave([c, pointwise.scale(c, 2)]), f"SELECT i1 * 2 AS i1, i2, round(v, 6) + 0.0 AS v FROM {PANEL} UNION ALL SELECT i1 * 2 + 1, i2, round(v * 2, 6) + 0.0 FROM {PANEL}")


# aggregations
def reduction(name: str, query: Callable[[Cube], Cube], value: str) -> None:
    register(name, query, f"SELECT i2 AS i1, round({value}, 6) + 0.0 AS v FROM {PANEL} GROUP BY i2")


reduction("mean", lambda c: agg.reduce(c, "mean", 1), "avg(v)")
reduction("rms", lambda c: agg.reduce(c, "rms", 1), "sqrt(avg(v * v))")
reduction("var", lambda c: agg.reduce(c, "var", 1), "var_pop(v)")
reduction("std", lambda c: agg.reduce(c, "std", 1, ddof=1), "stddev_samp(v)")
reduction("median", lambda c: agg.reduce(c, "median", 1), "quantile_cont(v, 0.5)")
reduction("min", lambda c: agg.reduce(c, "min", 1), "min(v)")
reduction("max", lambda c: agg.reduce(c, "max", 1), "max(v)")
reduction("stacks_rms", lambda c: agg.stack(c, 1, "rms", False), "sqrt(avg(v * v))")
reduction("range", lambda c: agg.reduce(c, "range", 1), "max(v) - min(v)")
register("mean_all", lambda c: agg.reduce(c, "mean"), f"SELECT 0::BIGINT AS i1, round(avg(v), 6) + 0.0 AS v FROM {PANEL}")
register("stack", lambda c: agg.stack(c, 2), f"SELECT i1, round(coalesce(sum(v) / nullif(count(*) FILTER (v <> 0), 0), 0), 6) + 0.0 AS v FROM {PANEL} GROUP BY i1")
register("quantile", lambda c: agg.quantile(c, [0.1, 0.5, 0.9], 1), f"SELECT k AS i1, i2, round(q, 6) + 0.0 AS v FROM (SELECT i2, unnest(range(3)) AS k, unnest(quantile_cont(v, [0.1, 0.5, 0.9])) AS q FROM {PANEL} GROUP BY i2)")
_ALL_Q = [0.001, 0.25, 0.5, 0.9, 0.99, 1.0]
register("quantile_all", lambda c: agg.quantile(c, _ALL_Q), f"SELECT k AS i1, round(q, 6) + 0.0 AS v FROM (SELECT unnest(range(6)) AS k, unnest(quantile_cont(v, {_ALL_Q})) AS q FROM {PANEL})")
register("quantile_axis2", lambda c: agg.quantile(c, [0.1, 0.5, 0.9], 2), f"SELECT i1, k AS i2, round(q, 6) + 0.0 AS v FROM (SELECT i1, unnest(range(3)) AS k, unnest(quantile_cont(v, [0.1, 0.5, 0.9])) AS q FROM {PANEL} GROUP BY i1)")
_HOLED = lambda c: c.map(lambda v: F.when(v > 0.1, F.lit(float("nan"))).otherwise(v))
register("quantile_omit", lambda c: agg.quantile(_HOLED(c), [0.25, 0.5], 1, True), f"SELECT k AS i1, i2, round(q, 6) + 0.0 AS v FROM (SELECT i2, unnest(range(2)) AS k, unnest(quantile_cont(v, [0.25, 0.5])) AS q FROM {PANEL} WHERE v <= 0.1 GROUP BY i2)")
register("median_all", lambda c: agg.reduce(c, "median"), f"SELECT 0::BIGINT AS i1, round(quantile_cont(v, 0.5), 6) + 0.0 AS v FROM {PANEL}")
register("max1", agg.argmax, f"SELECT i2, round(value, 6) + 0.0 AS value, i AS index, round(i * 0.004, 6) + 0.0 AS coord FROM (SELECT i2, v AS value, i1 AS i, row_number() OVER (PARTITION BY i2 ORDER BY v DESC, i1) AS r FROM {PANEL}) WHERE r = 1")
register("min_index", lambda c: agg.extreme(c, "min"), f"SELECT round(v, 6) + 0.0 AS value, i1 + 64 * i2 AS index FROM {PANEL} ORDER BY v, i1 + 64 * i2 LIMIT 1")
register("max_index", lambda c: agg.extreme(c, "max"), f"SELECT round(v, 6) + 0.0 AS value, i1 + 64 * i2 AS index FROM {PANEL} ORDER BY v DESC, i1 + 64 * i2 LIMIT 1")
register("attr", agg.attributes, f"SELECT count(*) AS n, round(min(v), 6) + 0.0 AS min, round(max(v), 6) + 0.0 AS max, round(avg(v), 6) + 0.0 AS mean, round(sqrt(avg(v * v)), 6) + 0.0 AS rms, round(var_samp(v), 6) + 0.0 AS var, count(*) FILTER (v <> 0) AS nonzero, count(*) FILTER (isnan(v)) AS nan FROM {PANEL}")
register("histogram", lambda c: agg.histogram(c, 20, -2.0, 2.0), f"SELECT b AS bin, round(-2 + (b + 0.5) * 0.2, 6) + 0.0 AS centre, count(i1)::DOUBLE AS value FROM range(20) r(b) LEFT JOIN (SELECT i1, least(floor((v + 2) / 0.2), 19)::BIGINT AS k FROM {PANEL} WHERE v BETWEEN -2 AND 2) ON k = b GROUP BY b")
register("otsu", lambda c: agg.otsu(agg.histogram(c, 20, -2.0, 2.0)), f"""WITH h AS (SELECT b, count(i1)::DOUBLE AS n FROM range(20) r(b) LEFT JOIN (SELECT i1, least(floor((v + 2) / 0.2), 19)::BIGINT AS k FROM {PANEL} WHERE v BETWEEN -2 AND 2) ON k = b GROUP BY b),
c AS (SELECT b, sum(n) OVER (ORDER BY b) AS w0, sum(n * b) OVER (ORDER BY b) AS s0, sum(n) OVER () AS w, sum(n * b) OVER () AS s FROM h)
SELECT b + 0.5::DOUBLE AS threshold FROM c ORDER BY coalesce(w0 * (w - w0) * pow(s0 / nullif(w0, 0) - (s - s0) / nullif(w - w0, 0), 2), 0) DESC, b LIMIT 1""")
register("diff", lambda c: agg.difference(c, pointwise.absolute(c), "rms"), f"SELECT round(sqrt(avg(pow(v - abs(v), 2))), 6) + 0.0 AS value FROM {PANEL}")
register("normalize", lambda c: agg.normalize(c), f"SELECT i1, i2, round(v / (SELECT max(abs(v)) FROM {PANEL}), 6) + 0.0 AS v FROM {PANEL}")
register("snr", lambda c: agg.snr(c, (10, 30)), f"SELECT i2, round(20 * log10(greatest(sqrt(avg(v * v) FILTER (i1 BETWEEN 10 AND 29)), 1e-12) / greatest(sqrt(avg(v * v) FILTER (i1 NOT BETWEEN 10 AND 29)), 1e-12)), 6) + 0.0 AS v FROM {PANEL} GROUP BY i2")


def gather_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean trace of each gather (label); zero samples don't count."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("samples"))
    got = agg.stack_by(Cube(rows, Meta((TIME, Axis(1))), "trace"), F.col("label"))
    return got.select(F.col("gather").alias("i2"), F.posexplode("samples").alias("i1", "v")).select(F.col("i1").cast("long").alias("i1"), "i2", "v")


register("gather_stack", plain=gather_stack, sql=f"SELECT i1, label::BIGINT AS i2, round(coalesce(avg(v) FILTER (v <> 0), 0), 6) + 0.0 AS v FROM {PANEL} GROUP BY i1, label")

# binning and header tables
_SECONDS = "epoch(ts - (SELECT min(ts) FROM events))"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    first = df.agg(F.min("ts").alias("first"))
    return df.join(F.broadcast(first)).withColumn("t", (F.unix_micros("ts") - F.unix_micros("first")) / 1e6)


def _by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of each 5 users: 40 bins, and more before and after them where the table's ids go on."""
    df = table(spark, sf_dir, "events")
    first, last = df.agg(F.floor(F.min("user_id") / 5).cast("long"), F.floor(F.max("user_id") / 5).cast("long")).first()
    low, high = min(0, first or 0), max(39, last or 0)
    return agg.bin_1d(df, F.col("user_id"), F.col("value"), Axis(high - low + 1, low * 5.0, 5.0)).withColumn("i1", F.col("i1") + low)


register("bin_1d", plain=_by_user, sql="SELECT b AS i1, round(coalesce(avg(value), 0), 6) + 0.0 AS v FROM (SELECT unnest(range(n)) AS b FROM (SELECT greatest(40, max(user_id) // 5 + 1) AS n FROM events)) LEFT JOIN events ON floor(user_id / 5.0) = b GROUP BY b")
register("bin_2d", plain=lambda s, d: agg.bin_2d(table(s, d, "lineitem"), F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.col("l_extendedprice"), (Axis(10, 1.0, 5.0), Axis(7, 1.0, 1.0)), "sum"), sql="SELECT a AS i1, b AS i2, round(coalesce(sum(l_extendedprice), 0), 6) + 0.0 AS v FROM range(10) x(a), range(7) y(b) LEFT JOIN lineitem ON floor((l_quantity - 1) / 5) = a AND l_linenumber - 1 = b GROUP BY a, b")
register("fold", plain=lambda s, d: agg.fold(table(s, d, "lineitem"), [F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.col("l_discount") * 100], (Axis(11, 0.0, 5.0), Axis(7, 1.0, 1.0), Axis(6, 0.0, 2.0))), sql="SELECT a AS i1, b AS i2, c AS i3, count(l_quantity) AS v FROM range(11) x(a), range(7) y(b), range(6) z(c) LEFT JOIN lineitem ON round_even(l_quantity / 5, 0) = a AND round_even(l_linenumber - 1.0::DOUBLE, 0) = b AND round_even(l_discount * 100 / 2, 0) = c GROUP BY a, b, c")
register("linefit", plain=lambda s, d: agg.linefit(table(s, d, "part"), F.col("p_size").cast("double"), F.col("p_retailprice"), Axis(20, 0.0, 2.5)), sql="SELECT k AS i1, round(a * k * 2.5 + b, 6) + 0.0 AS v FROM range(20) r(k), (SELECT regr_slope(p_retailprice, p_size) AS a, regr_intercept(p_retailprice, p_size) AS b FROM part)")
register("headersort", plain=lambda s, d: headers.sort(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", True).select("o_orderkey", "position"), sql="SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position FROM orders")
register("headermath", plain=lambda s, d: headers.math(table(s, d, "lineitem"), "l_extendedprice*(1-l_discount)^2", "net").select("l_orderkey", "l_linenumber", "net"), sql="SELECT l_orderkey, l_linenumber, round(l_extendedprice * pow(1 - l_discount, 2), 6) + 0.0 AS net FROM lineitem")
register("headerattr", plain=lambda s, d: headers.attributes(table(s, d, "lineitem"), ["l_quantity", "l_discount"]), sql="SELECT 'l_quantity' AS key, count(*) AS n, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 6) + 0.0 AS mean FROM lineitem UNION ALL SELECT 'l_discount', count(*), min(l_discount), max(l_discount), round(avg(l_discount), 6) + 0.0 FROM lineitem")
register("intbin", plain=lambda s, d: headers.intbin(table(s, d, "lineitem"), F.col("l_linenumber"), F.col("l_suppkey") % 50, F.col("l_quantity"), F.col("l_orderkey"), (Axis(7, 1.0), Axis(50, 0.0))), sql="SELECT a AS i1, b AS i2, coalesce(max_by(l_quantity, l_orderkey * 100 + l_quantity), 0)::DOUBLE AS v FROM range(7) x(a), range(50) y(b) LEFT JOIN lineitem ON l_linenumber - 1 = a AND l_suppkey % 50 = b GROUP BY a, b")
register("headercut", plain=lambda s, d: headers.cut(panel(s, d), table(s, d, "embeddings").select(F.col("vec_id").alias("i"), (F.col("label") == 3).alias("cut"))), sql=f"SELECT i1, i2, CASE WHEN label = 3 THEN 0 ELSE round(v, 6) + 0.0 END AS v FROM {PANEL}")
register("headerwindow", plain=lambda s, d: headers.window(panel(s, d), table(s, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("vec_id").between(100, 199).alias("keep"))), sql=f"SELECT i1, i2 - 100 AS i2, round(v, 6) + 0.0 AS v FROM {PANEL} WHERE i2 BETWEEN 100 AND 199")
register("windowed_bins", plain=lambda s, d: binning.windowed_bins(table(s, d, "events"), "1 hour", "10 minutes"), sql="SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) + 0.0 AS total, round(avg(value), 6) + 0.0 AS mean FROM events GROUP BY 1, 2")

# neighbourhoods
_W = "OVER (PARTITION BY i2 ORDER BY i1)"


def along(name: str, query: Callable[[Cube], Cube], value: str, more: str = "") -> None:
    register(name, query, f"SELECT i1, i2, round({value}, 6) + 0.0 AS v FROM (SELECT *, lag(v) {_W} AS b, lead(v) {_W} AS a{more} FROM {PANEL})")


along("deriv", neighbour.deriv, "CASE WHEN b IS NULL THEN a - v WHEN a IS NULL THEN v - b ELSE (a - b) / 2 END / 0.004")
along("causint", neighbour.integrate, "s", f", sum(v) {_W} AS s")
register("integral", lambda c: neighbour.integrate(c, 1, "trapezoid", True), f"SELECT i1, i2, round(sum(t) {_W} * 0.004, 6) + 0.0 AS v FROM (SELECT i1, i2, coalesce((v + lag(v) {_W}) / 2, 0) AS t FROM {PANEL})")
along("localrms", lambda c: neighbour.local_rms(c, 5), "s", ", sqrt(avg(v * v) OVER (PARTITION BY i2 ORDER BY i1 ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS s")
along("agc", lambda c: neighbour.agc(c, 0.036), "CASE WHEN s > 1e-12 THEN v / s ELSE 0 END", ", sqrt(sum(v * v) OVER (PARTITION BY i2 ORDER BY i1 ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9) AS s")
along("smooth_box", lambda c: neighbour.smooth(c, 2), "(coalesce(b, v) + v + coalesce(a, v)) / 3")
along("smooth_triangle", lambda c: neighbour.smooth(c, 2, 1, "triangle"), "(coalesce(b, v) + 2 * v + coalesce(a, v)) / 4")
register("decimate", lambda c: neighbour.decimate(c, 4), f"SELECT i1 // 4 AS i1, i2, round((coalesce(b, v) + v + a + a2) / 4, 6) + 0.0 AS v FROM (SELECT *, lag(v) {_W} AS b, lead(v) {_W} AS a, lead(v, 2) {_W} AS a2 FROM {PANEL}) WHERE i1 % 4 = 0")
along("laplac", lambda c: neighbour.laplacian(c, [1]), "(coalesce(v - b, 0) + coalesce(v - a, 0)) / (0.004 * 0.004)")
along("demean", neighbour.demean, "v - m", ", avg(v) OVER (PARTITION BY i2) AS m")
register("detrend", neighbour.detrend, f"SELECT i1, i2, round(v - (a * i1 + b), 6) + 0.0 AS v FROM {PANEL} JOIN (SELECT i2, regr_slope(v, i1) AS a, regr_intercept(v, i1) AS b FROM {PANEL} GROUP BY i2) USING (i2)")
along("ai2refl", lambda c: neighbour.reflectivity(c.map(lambda v: F.abs(v) + 1.0), 1e-7), "coalesce((abs(a) - abs(v)) / (abs(a) + abs(v) + 2 + 1e-7), 0)")
register("refl2ai", lambda c: neighbour.impedance(c.map(lambda v: F.tanh(v) * 0.1), 2.0), f"SELECT i1, i2, round(2 * exp(coalesce(sum(ln((1 + r) / (1 - r))) OVER (PARTITION BY i2 ORDER BY i1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 6) + 0.0 AS v FROM (SELECT i1, i2, tanh(v) * 0.1 AS r FROM {PANEL})")
_X = "OVER (PARTITION BY i1 ORDER BY i2)"


def across(name: str, query: Callable[[Cube], Cube], value: str, more: str = "") -> None:
    """Along axis 2, over all traces."""
    register(name, query, f"SELECT i1, i2, round({value}, 6) + 0.0 AS v FROM (SELECT *, lag(v) {_X} AS b, lead(v) {_X} AS a{more} FROM {PANEL})")


_near = lambda k: f"OVER (PARTITION BY i1 ORDER BY i2 ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"
across("deriv_axis2", lambda c: neighbour.deriv(c, 2), "CASE WHEN b IS NULL THEN a - v WHEN a IS NULL THEN v - b ELSE (a - b) / 2 END")
across("causint_axis2", lambda c: neighbour.integrate(c, 2), "s", f", sum(v) {_X} AS s")
register("integral_axis2", lambda c: neighbour.integrate(c, 2, "trapezoid", True), f"SELECT i1, i2, round(sum(t) {_X}, 6) + 0.0 AS v FROM (SELECT i1, i2, coalesce((v + lag(v) {_X}) / 2, 0) AS t FROM {PANEL})")
across("localrms_axis2", lambda c: neighbour.local_rms(c, 5, 2), "s", f", sqrt(avg(v * v) {_near(2)}) AS s")
across("agc_axis2", lambda c: neighbour.agc(c, 9.0, 2), "CASE WHEN s > 1e-12 THEN v / s ELSE 0 END", f", sqrt(sum(v * v) {_near(4)} / 9) AS s")
across("smooth_axis2", lambda c: neighbour.smooth(c, 2, 2, "triangle"), "(coalesce(b, v) + 2 * v + coalesce(a, v)) / 4")
across("laplac_axis2", lambda c: neighbour.laplacian(c, [2]), "coalesce(v - b, 0) + coalesce(v - a, 0)")
register("laplac_both", lambda c: neighbour.laplacian(c, [1, 2]), f"SELECT i1, i2, round((coalesce(v - lag(v) {_W}, 0) + coalesce(v - lead(v) {_W}, 0)) / (0.004 * 0.004) + coalesce(v - lag(v) {_X}, 0) + coalesce(v - lead(v) {_X}, 0), 6) + 0.0 AS v FROM {PANEL}")
register("decimate_axis2", lambda c: neighbour.decimate(c, 4, 2), f"SELECT i1, i2 // 4 AS i2, round((coalesce(b, v) + v + coalesce(a, v) + coalesce(a2, a, v)) / 4, 6) + 0.0 AS v FROM (SELECT *, lag(v) {_X} AS b, lead(v) {_X} AS a, lead(v, 2) {_X} AS a2 FROM {PANEL}) WHERE i2 % 4 = 0")
register("grad2", neighbour.sobel_square, f"SELECT i1, i2, round(CASE WHEN i1 IN (0, 63) OR lag(d) {_X} IS NULL OR lead(d) {_X} IS NULL THEN 0 ELSE pow(lead(d) {_X} + 2 * d + lag(d) {_X}, 2) + pow(lead(s) {_X} - lag(s) {_X}, 2) END, 6) + 0.0 AS v FROM (SELECT i1, i2, lead(v) {_W} - lag(v) {_W} AS d, lead(v) {_W} + 2 * v + lag(v) {_W} AS s FROM {PANEL})")


# interpolation and seismic transforms
def _lerp(place: str, source: str = PANEL, keys: str = "i2") -> str:
    """DuckDB value at a fractional index, by two look-ups."""
    return f"CASE WHEN {place} BETWEEN 0 AND 63 THEN e[floor({place})::INT + 1] * (1 - ({place} - floor({place}))) + coalesce(e[floor({place})::INT + 2], 0) * ({place} - floor({place})) ELSE 0 END"


_E = "(SELECT vec_id AS i2, label, embedding::DOUBLE[] AS e FROM embeddings)"
register("linear", lambda c: resample.linear(c, 50, 0.01, 0.005), f"SELECT k AS i1, i2, round({_lerp('p')}, 6) + 0.0 AS v FROM (SELECT *, (0.01 + k * 0.005) / 0.004 AS p FROM {_E}, range(50) r(k))")
register("t2warp", lambda c: resample.t2warp(c, 64), f"SELECT k AS i1, i2, round({_lerp('p')}, 6) + 0.0 AS v FROM (SELECT *, least(sqrt(k * (pow(63 * 0.004, 2) / 63)) / 0.004, 63) AS p FROM {_E}, range(64) r(k))")
register("t2warp_inverse", lambda c: resample.t2warp(c, 64, inverse=True), f"SELECT k AS i1, i2, round({_lerp('p')}, 6) + 0.0 AS v FROM (SELECT *, pow(k * (sqrt(63 * 0.004e0) / 63), 2) / 0.004e0 AS p FROM {_E}, range(64) r(k))")
_H = "((i2 % 12) * 20.0)"
_MOVED = f"(SELECT *, sqrt(pow(k * 0.004, 2) + pow({_H} * 2, 2) / (2000.0 * 2000.0)) / 0.004 AS p FROM {_E}, range(64) r(k))"
_offset = lambda: F.pmod(F.col("i2"), F.lit(12)) * 20.0
register("nmo", lambda c: resample.nmo(c, _offset(), 2000.0, stretch=None), f"SELECT k AS i1, i2, round({_lerp('p')}, 6) + 0.0 AS v FROM {_MOVED}")
#: 0 where a place and the one before it (past the first) are less than half a sample apart.
_UNSTRETCHED = f"CASE WHEN b > 0 AND abs(p - b) < 0.5 THEN 0 ELSE {_lerp('p')} END"
register("nmo_stretch", lambda c: resample.nmo(c, _offset(), 2000.0), f"SELECT k AS i1, i2, round({_UNSTRETCHED}, 6) + 0.0 AS v FROM (SELECT *, lag(p) OVER (PARTITION BY i2 ORDER BY k) AS b FROM {_MOVED})")
register("nmo_of_time", lambda c: resample.nmo(c, _offset(), [1500.0 + 10 * k for k in range(N)], h0=30.0, stretch=None), f"SELECT k AS i1, i2, round(CASE WHEN q >= 0 THEN {_lerp('(sqrt(greatest(q, 0)) / 0.004e0)')} ELSE 0 END, 6) + 0.0 AS v FROM (SELECT *, pow(k * 0.004e0, 2) + (pow({_H} * 2e0, 2) - 3600) / pow(1500e0 + 10 * k, 2) AS q FROM {_E}, range(64) r(k))")


def semblance(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    labels = df.select(F.col("vec_id").alias("i2"), F.col("label").cast("long").alias("label"))
    c = panel(spark, sf_dir)
    c = c.derive(c.df.join(labels, "i2"))
    return resample.semblance(c, (F.pmod(F.col("i2"), F.lit(12)) + 1) * 20.0, F.col("label"), [1500.0, 2000.0, 2500.0], **options)


register("semblance", plain=lambda s, d: semblance(s, d, stretch=None), sql=f"""SELECT label::BIGINT AS gather, k AS i1, j AS i2, round(coalesce(pow(sum(a), 2) / nullif(count(*) FILTER (a <> 0) * sum(a * a), 0), 0), 6) + 0.0 AS v FROM
(SELECT label, k, j, {_lerp('p')} AS a FROM (SELECT *, sqrt(pow(k * 0.004, 2) + pow((i2 % 12 + 1) * 40.0, 2) / (speed * speed)) / 0.004 AS p FROM {_E}, range(64) r(k), (VALUES (0::BIGINT, 1500.0::DOUBLE), (1, 2000), (2, 2500)) s(j, speed))) GROUP BY label, k, j""")
register("stack_rms", lambda c: agg.stack(c, 2, "rms"), f"SELECT i1, round(coalesce(sqrt(sum(v * v) / nullif(count(*) FILTER (v <> 0), 0)), 0), 6) + 0.0 AS v FROM {PANEL} GROUP BY i1")
_SCAN = f"""(SELECT *, lag(p) OVER (PARTITION BY i2, j ORDER BY k) AS b FROM (SELECT *, sqrt(pow(k * 0.004, 2) + pow((i2 % 12 + 1) * 40.0, 2) / (speed * speed)) / 0.004 AS p FROM {_E}, range(64) r(k), (VALUES (0::BIGINT, 1500.0::DOUBLE), (1, 2000), (2, 2500)) s(j, speed)))"""
register("semblance_smooth", plain=lambda s, d: semblance(s, d, smooth=3), sql=f"""SELECT gather, i1, i2, round(CASE WHEN below > 0 THEN above / below ELSE 0 END, 6) + 0.0 AS v FROM (SELECT gather, i1, i2, sum(x) OVER w AS above, sum(y) OVER w AS below FROM
(SELECT label::BIGINT AS gather, k AS i1, j AS i2, pow(sum(a), 2) AS x, count(*) FILTER (a <> 0) * sum(a * a) AS y FROM (SELECT label, k, j, {_UNSTRETCHED} AS a FROM {_SCAN}) GROUP BY label, k, j) WINDOW w AS (PARTITION BY gather, i2 ORDER BY i1 ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))""")
register("radon_mean", lambda c: resample.radon(c, F.pmod(F.col("i2"), F.lit(12)) * 20.0, [0.00007, 0.00013], normalize=True).drop("gather"), f"SELECT k AS i1, j AS i2, round(avg(a), 6) + 0.0 AS v FROM (SELECT k, j, {_lerp('p')} AS a FROM (SELECT *, k + p0 * {_H} / 0.004 AS p FROM {_E}, range(64) r(k), (VALUES (0::BIGINT, 0.00007::DOUBLE), (1, 0.00013)) s(j, p0))) GROUP BY k, j")
register("radon", lambda c: resample.radon(c, F.pmod(F.col("i2"), F.lit(12)) * 20.0, [0.00007, 0.00013]).drop("gather"), f"SELECT k AS i1, j AS i2, round(sum(a), 6) + 0.0 AS v FROM (SELECT k, j, {_lerp('p')} AS a FROM (SELECT *, k + p0 * {_H} / 0.004 AS p FROM {_E}, range(64) r(k), (VALUES (0::BIGINT, 0.00007::DOUBLE), (1, 0.00013)) s(j, p0))) GROUP BY k, j")

# spectra and filters
register("spectra", spectral.power_spectrum, f"SELECT i1, i2, round(re * re + im * im, 6) + 0.0 AS v FROM {DFT}")
register("rfft_real", lambda c: spectral.rfft_parts(c)[0], f"SELECT i1, i2, round(re, 6) + 0.0 AS v FROM {DFT}")
register("rfft_imag", lambda c: spectral.rfft_parts(c)[1].map(lambda v: F.round(v, 6)), f"SELECT i1, i2, round(im, 6) + 0.0 AS v FROM {DFT}")
register("psd", lambda c: spectral.psd(c, "boxcar"), f"SELECT i1, i2, round((re * re + im * im) * CASE WHEN i1 IN (0, 32) THEN 1 ELSE 2 END / 64 * 0.004, 6) + 0.0 AS v FROM {DFT}")
register("autocorr", lambda c: spectral.autocorrelate(c, 8), "SELECT k AS i1, vec_id AS i2, round(list_sum([CAST(embedding[i] AS DOUBLE) * CAST(embedding[i + k] AS DOUBLE) FOR i IN range(1, 65 - k)]), 6) + 0.0 AS v FROM embeddings, range(8) r(k)")
register("convolve", lambda c: spectral.convolve(c, _taps()), f"SELECT i1, i2, round(0.25 * coalesce(a, 0) + 0.5 * v + 0.25 * coalesce(b, 0), 6) + 0.0 AS v FROM (SELECT *, lag(v) {_W} AS b, lead(v) {_W} AS a FROM {PANEL})")


def _filtered(re: str, im: str = "0", more: str = "") -> str:
    """DuckDB traces after a gain re + i im at frequency f (in Hz) and bin k."""
    spectrum = f"(SELECT i1 AS k, i2, i1 / 0.256e0 AS f, re, im{more} FROM {DFT})"
    gained = f"SELECT k, i2, re * ({re}) - im * ({im}) AS re, re * ({im}) + im * ({re}) AS im FROM {spectrum}"
    return f"SELECT t AS i1, i2, round(sum(CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * (re * cos(2 * pi() * k * t / 64) - CASE WHEN k IN (0, 32) THEN 0 ELSE im END * sin(2 * pi() * k * t / 64))) / 64, 6) + 0.0 AS v FROM ({gained}), range(64) r(t) GROUP BY t, i2"


def _flank(position: str) -> str:
    return f"(0.5 - 0.5 * cos(pi() * greatest(least({position}, 1), 0)))"


_ANALYTIC = f"(SELECT t AS i1, i2, sum(CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * (re * cos(2 * pi() * k * t / 64) - im * sin(2 * pi() * k * t / 64))) / 64 AS x, sum(CASE WHEN k IN (0, 32) THEN 0 ELSE 2 END * (re * sin(2 * pi() * k * t / 64) + im * cos(2 * pi() * k * t / 64))) / 64 AS y FROM (SELECT i1 AS k, i2, re, im FROM {DFT}), range(64) r(t) GROUP BY t, i2)"
#: A windowed sinc of 21 taps, 40 Hz of 125, with unit gain at 0.
_SINC = "(SELECT j, h / sum(h) OVER () AS h FROM (SELECT j, CASE WHEN j = 10 THEN 0.32e0 ELSE sin(pi() * 0.32e0 * (j - 10)) / (pi() * (j - 10)) END * (0.5 - 0.5 * cos(2 * pi() * j / 20)) AS h FROM range(21) r(j)))"
register("bandpass", lambda c: spectral.bandpass(c, 8.0, 60.0, 4.0), _filtered("0.5 - 0.5 * cos(pi() * greatest(least((f - 8) / 4 + 1, 1), 0) * greatest(least((60 - f) / 4 + 1, 1), 0))"))
register("fir", lambda c: spectral.fir_filter(c, spectral.firwin(21, 40.0, 250.0)), f"SELECT t AS i1, vec_id AS i2, round(sum(h * CASE WHEN t + 10 - j BETWEEN 0 AND 63 THEN CAST(embedding[t + 11 - j] AS DOUBLE) ELSE 0 END), 6) + 0.0 AS v FROM embeddings, range(64) r(t), {_SINC} GROUP BY t, vec_id")
register("envelope", spectral.envelope, f"SELECT i1, i2, round(sqrt(x * x + y * y), 6) + 0.0 AS v FROM {_ANALYTIC}")
register("hilbert", spectral.hilbert, f"SELECT i1, i2, round(y, 6) + 0.0 AS v FROM {_ANALYTIC}")
register("whiten", spectral.whiten, _filtered("1 / greatest(sqrt(re * re + im * im), 1e-6 * top)", more=", sqrt(max(re * re + im * im) OVER (PARTITION BY i2)) AS top"))
register("welch", lambda c: spectral.welch(c, 32), f"""SELECT k AS i1, i2, round(avg(re * re + im * im) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END * 0.004e0 / (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * m / 31), 2)) FROM range(32) r(m)), 6) + 0.0 AS v FROM
(SELECT k, i2, g, sum(w * cos(2 * pi() * m * k / 32)) AS re, sum(w * sin(2 * pi() * m * k / 32)) AS im FROM (SELECT i2, g, i1 - 16 * g AS m, v * (0.5 - 0.5 * cos(2 * pi() * (i1 - 16 * g) / 31)) AS w FROM {PANEL}, range(3) s(g) WHERE i1 - 16 * g BETWEEN 0 AND 31), range(17) q(k) GROUP BY k, i2, g) GROUP BY k, i2""")
register("freqattr", spectral.frequency_attributes, f"""SELECT j AS i1, i2, round(CASE j WHEN 0 THEN top WHEN 1 THEN centre ELSE sqrt(greatest(square - centre * centre, 0)) END, 6) + 0.0 AS v FROM
(SELECT i2, arg_max(i1, p) / 0.256e0 AS top, sum(p * i1 / 0.256e0) / sum(p) AS centre, sum(p * pow(i1 / 0.256e0, 2)) / sum(p) AS square FROM (SELECT i1, i2, re * re + im * im AS p FROM {DFT}) GROUP BY i2), range(3) r(j)""")
register("cosft", spectral.dct, f"SELECT k AS i1, i2, round(sum(v * cos(pi() * (i1 + 0.5) * k / 64)) * sqrt(2.0 / 64) * CASE WHEN k = 0 THEN sqrt(0.5) ELSE 1 END, 6) + 0.0 AS v FROM {PANEL}, range(64) r(k) GROUP BY k, i2")
register("icosft", lambda c: spectral.dct(c, inverse=True), f"SELECT k AS i1, i2, round(sum(v * cos(pi() * (k + 0.5) * i1 / 64) * sqrt(2.0 / 64) * CASE WHEN i1 = 0 THEN sqrt(0.5) ELSE 1 END), 6) + 0.0 AS v FROM {PANEL}, range(64) r(k) GROUP BY k, i2")
_SINH = "(exp({x} * ln(2 + sqrt(3e0))) - exp(-({x}) * ln(2 + sqrt(3e0))))"
_BENDS = f"""(SELECT i2, k, sum(6 * (e[j + 2] - 2 * e[j + 1] + e[j]) * CASE WHEN (k + j) % 2 = 0 THEN 1 ELSE -1 END * {_SINH.format(x="least(k, j)")} * {_SINH.format(x="(63 - greatest(k, j))")} / ({_SINH.format(x="1")} * {_SINH.format(x="63")})) AS m FROM {_E}, range(1, 63) a(j), range(1, 63) b(k) GROUP BY i2, k)"""
register("spline", lambda c: resample_spline(c), f"""SELECT i1, s.i2, round(CASE WHEN p <= 63 THEN (1 - t) * e[s.k + 1] + t * e[s.k + 2] + ((pow(1 - t, 3) - (1 - t)) * coalesce(x.m, 0) + (pow(t, 3) - t) * coalesce(y.m, 0)) / 6 ELSE 0 END, 6) + 0.0 AS v FROM
(SELECT *, p - k AS t FROM (SELECT *, least(floor(p)::BIGINT, 62) AS k FROM (SELECT *, (0.01e0 + i1 * 0.005e0) / 0.004e0 AS p FROM {_E}, range(50) r(i1)))) s LEFT JOIN {_BENDS} x ON s.i2 = x.i2 AND s.k = x.k LEFT JOIN {_BENDS} y ON s.i2 = y.i2 AND s.k + 1 = y.k""")

_BOTH = f"(SELECT i2, k AS i1, sum(v * cos(2 * pi() * i1 * k / 64)) AS re, -sum(v * sin(2 * pi() * i1 * k / 64)) AS im, sum(abs(v) * cos(2 * pi() * i1 * k / 64)) AS re2, -sum(abs(v) * sin(2 * pi() * i1 * k / 64)) AS im2 FROM {PANEL}, range(33) r(k) GROUP BY i2, k)"
_TWICE = "CASE WHEN i1 IN (0, 32) THEN 1 ELSE 2 END"
register("csd_real", lambda c: cross.csd(c, c.map(F.abs), kind="boxcar"), f"SELECT i1, i2, round((re * re2 + im * im2) * {_TWICE} / 64 * 0.004, 6) + 0.0 AS v FROM {_BOTH}")
register("csd_imag", lambda c: cross.csd(c, c.map(F.abs), kind="boxcar", part="imag"), f"SELECT i1, i2, round((re * im2 - im * re2) * {_TWICE} / 64 * 0.004, 6) + 0.0 AS v FROM {_BOTH}")
#: Segments of 16 samples, 8 apart, under a window: (i2, g, k) with the parts of the trace and of its magnitude.
_SHORT = """(SELECT k, i2, g, sum(v * w * cos(2 * pi() * m * k / 16)) AS re, -sum(v * w * sin(2 * pi() * m * k / 16)) AS im, sum(abs(v) * w * cos(2 * pi() * m * k / 16)) AS re2, -sum(abs(v) * w * sin(2 * pi() * m * k / 16)) AS im2
FROM (SELECT i2, g, i1 - 8 * g AS m, v, 0.5 - 0.5 * cos(2 * pi() * (i1 - 8 * g) / 15) AS w FROM """ + PANEL + """, range(7) s(g) WHERE i1 - 8 * g BETWEEN 0 AND 15), range(9) q(k) GROUP BY k, i2, g)"""
register("coherence", lambda c: cross.coherence(c, c.map(F.abs), 16), f"SELECT i1, i2, round(CASE WHEN a * b > 1e-12 THEN greatest(least((x * x + y * y) / (a * b), 1), 0) ELSE 0 END, 6) + 0.0 AS v FROM (SELECT k AS i1, i2, avg(re * re + im * im) AS a, avg(re2 * re2 + im2 * im2) AS b, avg(re * re2 + im * im2) AS x, avg(re * im2 - im * re2) AS y FROM {_SHORT} GROUP BY k, i2)")
register("spectrogram", lambda c: cross.spectrogram(c, 16), f"SELECT k AS i1, g AS i2, i2 AS i3, round((re * re + im * im) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END / (SELECT pow(sum(0.5 - 0.5 * cos(2 * pi() * m / 15)), 2) FROM range(16) r(m)), 6) + 0.0 AS v FROM {_SHORT}")
_NINE = "(SELECT j, h / sum(h) OVER () AS h FROM (SELECT j, CASE WHEN j = 4 THEN 0.32e0 ELSE sin(pi() * 0.32e0 * (j - 4)) / (pi() * (j - 4)) END * (0.5 - 0.5 * cos(2 * pi() * j / 8)) AS h FROM range(9) r(j)))"
_ONCE = f"(SELECT p, i2, sum(h * CASE WHEN q BETWEEN -24 AND 87 THEN e[(CASE WHEN q < 0 THEN -q WHEN q > 63 THEN 126 - q ELSE q END)::INT + 1] ELSE 0 END) AS y FROM (SELECT p, i2, e, h, p + 4 - j AS q FROM (SELECT vec_id AS i2, embedding::DOUBLE[] AS e FROM embeddings), range(-24, 88) r(p), {_NINE}) GROUP BY p, i2)"
register("filtfilt", lambda c: cross.zero_phase(c, spectral.firwin(9, 40.0, 250.0)), f"SELECT t AS i1, i2, round(sum(h * y), 6) + 0.0 AS v FROM {_ONCE} JOIN (SELECT t, t + 4 - j AS p, h FROM range(64) r(t), {_NINE}) USING (p) GROUP BY t, i2")


def _band_taps(low: float, high: float) -> str:
    """DuckDB taps of a windowed band-pass of 21, edges as fractions of half the sampling rate."""
    raw = f"(SELECT j, CASE WHEN j = 10 THEN {high - low}::DOUBLE ELSE (sin(pi() * {high} * (j - 10)) - sin(pi() * {low} * (j - 10))) / (pi() * (j - 10)) END * (0.5 - 0.5 * cos(2 * pi() * j / 20)) AS h FROM range(21) r(j))"
    return f"SELECT j, h / sum(h * cos(pi() * (j - 10) * {(low + high) / 2})) OVER () AS h FROM {raw}"


register("filterbank", lambda c: cross.filter_bank(c, [(10.0, 30.0), (40.0, 80.0)], 21), f"SELECT t AS i1, vec_id AS i2, b AS i3, round(sum(h * CASE WHEN t + 10 - j BETWEEN 0 AND 63 THEN embedding[t + 11 - j]::DOUBLE ELSE 0 END), 6) + 0.0 AS v FROM embeddings, range(64) r(t), (SELECT 0::BIGINT AS b, j, h FROM ({_band_taps(0.08, 0.24)}) UNION ALL SELECT 1, j, h FROM ({_band_taps(0.32, 0.64)})) GROUP BY t, vec_id, b")
register("transfer", lambda c: cross.transfer(c, c.map(lambda v: v * 3), N, kind="boxcar"), f"SELECT i1, i2, CASE WHEN re * re + im * im <= 1e-12 THEN 0.0 ELSE 3.0 END::DOUBLE AS v FROM {DFT}")
register("transfer_panels", lambda c: cross.transfer(c, c.map(F.abs), N, kind="boxcar"), f"SELECT i1, i2, round(CASE WHEN re * re + im * im <= 1e-12 THEN 0 ELSE sqrt((re2 * re2 + im2 * im2) / (re * re + im * im)) END, 6) + 0.0 AS v FROM {_BOTH}")
register("bandenergy", lambda c: cross.band_energy(c, [(0.0, 40.0), (50.0, 125.0)], "energy"), f"SELECT (k)::BIGINT AS i1, i2, round(sum((re * re + im * im) * {_TWICE} / 64), 6) + 0.0 AS v FROM {DFT}, (VALUES (0, 0.0, 40.0), (1, 50.0, 125.0)) b(k, low, high) WHERE i1 / 0.256 BETWEEN low AND high GROUP BY k, i2")
register("specnorm", lambda c: cross.normalize_spectrum(c), f"SELECT i1, i2, round(v / greatest(s, 1e-12), 6) + 0.0 AS v FROM {PANEL} JOIN (SELECT i2, sqrt(avg(re * re + im * im)) AS s FROM {DFT} GROUP BY i2) USING (i2)")


# gathers: four offsets a midpoint or shot, by vec_id
def _gathers(c: Cube) -> Cube:
    n = c.meta.axes[1].n
    df = c.df.select((F.col("i2") % 4).alias("i2"), F.floor(F.col("i2") / 4).cast("long").alias("i3"), "samples")
    return Cube(df, Meta((TIME, Axis(4), Axis(max(1, -(-n // 4)))), {}), "trace")


_N = "(SELECT (count(*) + 3) // 4 AS n FROM embeddings)"
register("cmp2shot", lambda c: gathers.cmp2shot(_gathers(c)), f"SELECT t AS i1, h AS i2, s AS i3, round(coalesce(v, 0), 6) + 0.0 AS v FROM (SELECT t, h, s FROM {_N}, range(64) a(t), range(4) b(h), (SELECT unnest(range(n + 3)) AS s FROM {_N})) LEFT JOIN (SELECT i1 AS t, i2 % 4 AS h, i2 // 4 - i2 % 4 + 3 AS s, v FROM {PANEL}) USING (t, h, s)")
register("shot2cmp", lambda c: gathers.shot2cmp(_gathers(c)), f"SELECT t AS i1, h AS i2, m AS i3, round(coalesce(v, 0), 6) + 0.0 AS v FROM (SELECT t, h, m FROM {_N}, range(64) a(t), range(4) b(h), (SELECT unnest(range(n + 3)) AS m FROM {_N})) LEFT JOIN (SELECT i1 AS t, i2 % 4 AS h, i2 // 4 + i2 % 4 AS m, v FROM {PANEL}) USING (t, h, m)")
#: As _lerp, with a zero sample after the last.
_LERP_OPEN = "CASE WHEN p BETWEEN 0 AND 64 THEN coalesce(e[floor(p)::INT + 1], 0) * (1 - (p - floor(p))) + coalesce(e[floor(p)::INT + 2], 0) * (p - floor(p)) ELSE 0 END"
register("kirchhoff", lambda c: gathers.kirchhoff(c.derive(c.df, c.meta.with_axis(2, d=10.0)), 2000.0, 20.0), f"SELECT k AS i1, x AS i2, round(sum({_LERP_OPEN}), 6) + 0.0 AS v FROM (SELECT *, sqrt(pow(k * 0.004, 2) + pow((i2 - x) * 0.01, 2)) / 0.004 AS p FROM (SELECT *, unnest(range(greatest(i2 - 2, 0), least(i2 + 3, (SELECT count(*) FROM embeddings)))) AS x FROM {_E}), range(64) r(k)) GROUP BY k, x")
_ALL_IMAGES = "(SELECT *, unnest(range((SELECT count(*) FROM embeddings))) AS x FROM " + _E + ")"
register("kirchhoff_mean", lambda c: gathers.kirchhoff(c.derive(c.df, c.meta.with_axis(2, d=10.0)), 200.0, normalize=True), f"SELECT k AS i1, x AS i2, round(sum({_LERP_OPEN}) / greatest(count(*) FILTER (p >= -1 AND p < 64), 1), 6) + 0.0 AS v FROM (SELECT *, sqrt(pow(k * 0.004, 2) + pow((i2 - x) * 0.1, 2)) / 0.004 AS p FROM {_ALL_IMAGES}, range(64) r(k)) WHERE p < 64 GROUP BY k, x")
register("radon_model", lambda c: gathers.radon_model(c.derive(c.df, c.meta.with_axis(2, d=1e-5)), [0.0, 30.0]), f"SELECT q AS i1, j AS i2, round(sum(w), 6) + 0.0 AS v FROM (SELECT j, floor(p)::BIGINT + e AS q, v * CASE WHEN e = 0 THEN 1 - p + floor(p) ELSE p - floor(p) END AS w FROM (SELECT *, (i1 * 0.004 + i2 * 1e-5::DOUBLE * x) / 0.004 AS p FROM {PANEL}, (VALUES (0::BIGINT, 0.0::DOUBLE), (1, 30.0)) o(j, x) WHERE v <> 0), range(2) t(e)) WHERE q BETWEEN 0 AND 63 GROUP BY q, j")
register("locate", plain=lambda s, d: gathers.locate(table(s, d, "embeddings").selectExpr("0D AS sx", "0D AS sz", "vec_id % 100 * 1D AS rx", "0D AS rz", "0.05 + 0.001 * (vec_id % 7) AS observed", "1D AS weight"), 1500.0, Axis(11, 0.0, 10.0), Axis(6, 0.0, 20.0)), sql="SELECT iz, ix, ix * 10.0::DOUBLE AS x, iz * 20.0::DOUBLE AS z, round(o, 6) + 0.0 AS objective FROM (SELECT iz, ix, sum(0.5 * pow(0.05::DOUBLE + 0.001::DOUBLE * (vec_id % 7) - (sqrt(pow(ix * 10, 2) + pow(iz * 20, 2)) + sqrt(pow(vec_id % 100 - ix * 10, 2) + pow(iz * 20, 2))) / 1500, 2)) AS o FROM embeddings, range(6) z(iz), range(11) x(ix) GROUP BY iz, ix) ORDER BY o, iz, ix LIMIT 1")

# masks, scatters, matrices and modelling
_SHAPE = [(1.5, 1.5), (8.2, 2.5), (6.0, 9.5), (2.0, 7.0)]
_EDGES = ", ".join(f"({ax}::DOUBLE, {ay}::DOUBLE, {bx}::DOUBLE, {by}::DOUBLE)" for (ax, ay), (bx, by) in zip(_SHAPE, [_SHAPE[-1], *_SHAPE[:-1]], strict=True))
register("polymask", lambda c: pointwise.combine(c, scatter.polygon_mask(c.df.sparkSession, (Axis(N, 0.0, 0.25), Axis(c.meta.shape[1], 0.0, 0.4)), _SHAPE), "mul"), f"SELECT i1, i2, round(v * (count(*) FILTER (((ay > i2 * 0.4) <> (\"by\" > i2 * 0.4)) AND i1 * 0.25 < (bx - ax) * (i2 * 0.4 - ay) / (\"by\" - ay) + ax) % 2), 6) + 0.0 AS v FROM {PANEL}, (VALUES {_EDGES}) e(ax, ay, bx, \"by\") GROUP BY i1, i2, v")
sample("mutter", lambda c: scatter.line_mute(c, 2000.0, 0.02, "above", 4), "v * pow(sin(greatest(least((i1 * 0.004 - 0.02 - i2 / 2000.0) / 0.016, 1), 0) * pi() / 2), 2)")
sample("mutter_below", lambda c: scatter.line_mute(c, 5000.0, 0.021, "below"), "CASE WHEN i1 * 0.004::DOUBLE > 0.021::DOUBLE + i2 / 5000.0::DOUBLE THEN 0 ELSE v END")
register("avo", lambda c: scatter.avo(_gathers(c).derive(_gathers(c).df, _gathers(c).meta.with_axis(2, o=10.0, d=5.0))), f"SELECT t AS i1, k AS i2, g AS i3, round(CASE WHEN k = 0 THEN regr_intercept(v, h) ELSE regr_slope(v, h) END, 6) + 0.0 AS v FROM (SELECT i1 AS t, i2 // 4 AS g, (10.0::DOUBLE + 5 * (i2 % 4)) * 2 AS h, v FROM {PANEL}), range(2) r(k) GROUP BY t, k, g")
register("map2coh", lambda c: scatter.map_to_coherence(c, c.map(lambda v: F.abs(v) * 10), Axis(12, 0.5, 1.25)), f"SELECT t AS i1, k AS i2, round(coalesce(sum(w), 0), 6) + 0.0 AS v FROM range(64) a(t) CROSS JOIN range(12) b(k) LEFT JOIN (SELECT i1, floor(p)::BIGINT + e AS bin, v * CASE WHEN e = 0 THEN 1 - p + floor(p) ELSE p - floor(p) END AS w FROM (SELECT *, (abs(v) * 10 - 0.5) / 1.25 AS p FROM {PANEL}), range(2) s(e)) ON i1 = t AND bin = k GROUP BY t, k")
register("moveout", lambda c: scatter.moveout_spikes(reshape.slice_axis(c.map(F.abs), 1, 7), Axis(40, 0.0, 0.05)), "SELECT k AS i1, vec_id AS i2, round(greatest(1 - abs(k - abs(embedding[8]::DOUBLE) / 0.05), 0), 6) + 0.0 AS v FROM embeddings, range(40) r(k)")
register("cos2ang", lambda c: scatter.to_angle(c.derive(c.df, c.meta.with_axis(1, o=-4.0, d=0.05)), n=63, d=1.4), f"SELECT k AS i1, i2, round({_lerp('p')}, 6) + 0.0 AS v FROM (SELECT *, (-1 / cos(radians(k * 1.4)) + 4.0) / 0.05 AS p FROM {_E}, range(63) r(k))")
register("isin2ang", lambda c: scatter.to_angle(c.derive(c.df, c.meta.with_axis(1, o=1.0, d=0.1)), "sin", 50, 5.0, 1.7), f"SELECT k AS i1, i2, round({_lerp('p')}, 6) + 0.0 AS v FROM (SELECT *, (1 / sin(radians(5 + k * 1.7)) - 1.0) / 0.1 AS p FROM {_E}, range(50) r(k))")
register("matmult", lambda c: scatter.matmult(c, _matrix()), f"SELECT r AS i1, i2, round(sum(v / (1 + i1 + r)), 6) + 0.0 AS v FROM {PANEL}, range(5) m(r) GROUP BY r, i2")
register("matmult_sparse", plain=lambda s, d: _sparse(s, d), sql="SELECT l_suppkey AS i, round(sum(l_quantity * p_size), 6) + 0.0 AS v FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey")
register("match", lambda c: scatter.match(c, _taps_of_four()), f"SELECT i1, i2, round(coalesce(lead(v, 2) {_W}, 0) - 0.5 * coalesce(lead(v, 1) {_W}, 0) + 2 * v + 0.25 * coalesce(lag(v, 1) {_W}, 0), 6) + 0.0 AS v FROM {PANEL}")
register("match_adjoint", lambda c: scatter.match_adjoint(c, c.map(F.abs), 3), f"SELECT k AS i1, round(sum(CASE k WHEN 0 THEN coalesce(abs(a), 0) WHEN 1 THEN abs(v) ELSE coalesce(abs(b), 0) END * v), 6) + 0.0 AS v FROM (SELECT *, lag(v) {_W} AS b, lead(v) {_W} AS a FROM {PANEL}), range(3) r(k) GROUP BY k")
register("cconv", lambda c: filters.circular_convolve(c, _taps_of_four()), "SELECT k AS i1, vec_id AS i2, round(e[k + 1] - 0.5 * e[(k + 63) % 64 + 1] + 2 * e[(k + 62) % 64 + 1] + 0.25 * e[(k + 61) % 64 + 1], 6) + 0.0 AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), range(64) r(k)")
register("correlate", lambda c: filters.correlate(c, _taps_of_four()[:3]), f"SELECT i1, i2, round(coalesce(lag(v) {_W}, 0) - 0.5 * v + 2 * coalesce(lead(v) {_W}, 0), 6) + 0.0 AS v FROM {PANEL}")
register("xcorr", lambda c: filters.trace_correlation(c, c.map(F.abs)), "SELECT k AS i1, vec_id AS i2, round(list_sum([CAST(embedding[i] AS DOUBLE) * abs(CAST(embedding[i - k + 63] AS DOUBLE)) FOR i IN range(greatest(1, k - 62), least(64, k + 1) + 1)]), 6) + 0.0 AS v FROM embeddings, range(127) r(k)")
_ENVELOPES = f"(SELECT i2, i1, sqrt(a.x * a.x + a.y * a.y) AS e, sqrt(b.x * b.x + b.y * b.y) AS f FROM {_ANALYTIC} a JOIN {_ANALYTIC.replace('sum(v *', 'sum(abs(v) *')} b USING (i1, i2))"
register("envcorr", lambda c: filters.trace_correlation(c, c.map(F.abs), "same", True, True), f"""SELECT t AS i1, i2, round(above / below, 6) + 0.0 AS v FROM (SELECT t, x.i2, coalesce(sum(x.e * y.f), 0) AS above FROM {_ENVELOPES} x CROSS JOIN range(64) r(t) LEFT JOIN {_ENVELOPES} y ON x.i2 = y.i2 AND y.i1 = x.i1 + 32 - t GROUP BY t, x.i2) JOIN (SELECT i2, sqrt(sum(e * e) * sum(f * f)) AS below FROM {_ENVELOPES} GROUP BY i2) USING (i2)""")
register("bandstop", lambda c: filters.bandstop(c, 20.0, 40.0, 4.0), _filtered(f"1 - {_flank('(f - 20) / 4 + 1')} * {_flank('(40 - f) / 4 + 1')}"))
register("notch", lambda c: filters.notch(c, 50.0, 8.0), _filtered("CASE WHEN f BETWEEN 46 AND 54 THEN 0 ELSE 1 END"))
register("trapez", lambda c: filters.trapezoid(c, (5.0, 12.0, 50.0, 70.0)), _filtered(f"CASE WHEN f >= 5 AND f < 12 THEN {_flank('(f - 5) / 7')} WHEN f >= 12 AND f < 50 THEN 1 WHEN f >= 50 AND f < 70 THEN {_flank('(70 - f) / 20')} ELSE 0 END"))
_OMEGA = "CASE WHEN k = 0 THEN 0 ELSE pow(greatest(2 * pi() * k / 64, 1 / 64e0), {power}) * {turn}(pi() / 4) END"
register("halfint", filters.half_integral, _filtered(_OMEGA.format(power=-0.5, turn="cos"), _OMEGA.format(power=-0.5, turn="-sin")))
register("halfdiff", lambda c: filters.half_integral(c, True), _filtered(_OMEGA.format(power=0.5, turn="cos"), _OMEGA.format(power=0.5, turn="sin")))
_LAYERS = "CASE WHEN abs(x - 100) <= 50 AND abs(z - 60) <= 20 THEN 3000 WHEN pow(x - 300, 2) + pow(z - 100, 2) <= 900 THEN w - 200 ELSE w END"
register("velocity_model", lambda c: pointwise.combine(c, modelling.circle(modelling.rectangle(modelling.layered_velocity(c.df.sparkSession, Axis(N, 0.0, 5.0), Axis(c.meta.shape[1], 0.0, 10.0), [(0.0, 1500.0), (80.0, 2200.0)]), (50.0, 150.0), (40.0, 80.0), velocity=3000.0), 300.0, 100.0, 30.0, delta=-200.0), "mul"), f"SELECT i1, i2, round(v * ({_LAYERS}), 6) + 0.0 AS v FROM (SELECT *, i1 * 5.0 AS z, i2 * 10.0 AS x, CASE WHEN i1 * 5.0 >= 80 THEN 2200 ELSE 1500 END AS w FROM {PANEL})")
register("acoustic2d", plain=lambda s, d: _survey(s, d))
register("locate_velocity", plain=lambda s, d: modelling.locate_velocity(_picks(s, d), Axis(11, 0.0, 10.0), Axis(6, 0.0, 20.0), 1000.0, 3000.0), sql="""SELECT iz, ix, ix * 10.0::DOUBLE AS x, iz * 20.0::DOUBLE AS z, round(1 / s, 6) + 0.0 AS velocity, round(o, 6) + 0.0 AS objective FROM (SELECT *, 0.5 * (tt - 2 * s * pt + s * s * pp) AS o FROM (SELECT *, greatest(least(pt / pp, 1 / 1000.0), 1 / 3000.0) AS s FROM (
SELECT iz, ix, sum(t * t) AS tt, sum(p * t) AS pt, sum(p * p) AS pp FROM (SELECT iz, ix, 0.05::DOUBLE + 0.001::DOUBLE * (vec_id % 7) AS t, sqrt(pow(ix * 10, 2) + pow(iz * 20, 2)) + sqrt(pow(vec_id % 100 - ix * 10, 2) + pow(iz * 20, 2)) AS p FROM embeddings, range(6) z(iz), range(11) x(ix)) GROUP BY iz, ix))) ORDER BY o, iz, ix LIMIT 1""")
register("locate_velocities", plain=lambda s, d: modelling.locate_velocity(_picks(s, d), Axis(11, 0.0, 10.0), Axis(6, 0.0, 20.0), velocities=[1000.0, 1400.0, 1900.0, 2500.0]), sql="""SELECT iz, ix, ix * 10.0::DOUBLE AS x, iz * 20.0::DOUBLE AS z, round(c, 6) + 0.0 AS velocity, round(o, 6) + 0.0 AS objective FROM (SELECT *, 0.5 * (tt - 2 * pt / c + pp / (c * c)) AS o FROM (
SELECT iz, ix, sum(t * t) AS tt, sum(p * t) AS pt, sum(p * p) AS pp FROM (SELECT iz, ix, 0.05::DOUBLE + 0.001::DOUBLE * (vec_id % 7) AS t, sqrt(pow(ix * 10, 2) + pow(iz * 20, 2)) + sqrt(pow(vec_id % 100 - ix * 10, 2) + pow(iz * 20, 2)) AS p FROM embeddings, range(6) z(iz), range(11) x(ix)) GROUP BY iz, ix), (VALUES (1000e0), (1400e0), (1900e0), (2500e0)) v(c)) ORDER BY o, iz, ix LIMIT 1""")
register("least_squares", plain=lambda s, d: _solved(s, d), sql="SELECT 0::BIGINT AS i, round(regr_intercept(p_retailprice, p_size / 50.0), 4) + 0.0 AS v FROM part UNION ALL SELECT 1, round(regr_slope(p_retailprice, p_size / 50.0), 4) + 0.0 FROM part")



def _ridge(spark: SparkSession, sf_dir: str) -> runs.Problem:
    """An effect of each supplier on the quantity of each line item, drawn towards 0."""
    numbered = headers.sort(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity"), "l_orderkey", "l_suppkey")
    rows = numbered.select(F.col("position").alias("row"), F.col("l_suppkey").cast("long").alias("col"), F.col("l_quantity").cast("double").alias("y"))
    last, most = rows.agg(F.max("row"), F.max("col")).first()
    columns = (most or 0) + 1
    return runs.Problem(solvers.Matrix(rows.select("row", "col", F.lit(1.0).alias("value")), (last or 0) + 1, columns, single=True), rows.select(F.col("row").alias("i"), F.col("y").alias("v")), solvers.identity(columns), 3.0)


def _resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that ends after two steps and is taken up again."""
    problem, folder = _ridge(spark, sf_dir), f"{solvers.shared_folder(spark)}/{uuid.uuid4().hex}"
    runs.solve(problem, folder, 2, 1e-12)
    return runs.solve(problem, folder, 25, 1e-12).x.where("abs(v) > 0")


register("least_squares_run", plain=_resumed, sql="SELECT l_suppkey::BIGINT AS i, round(sum(l_quantity) / (count(*) + 9), 6) + 0.0 AS v FROM lineitem GROUP BY l_suppkey")

# complex samples
_FULL = f"(SELECT (k + 32) % 64 AS i1, i2, sum(v * cos(2 * pi() * i1 * k / 64)) AS re, -sum(v * sin(2 * pi() * i1 * k / 64)) AS im FROM {PANEL}, range(64) r(k) GROUP BY k, i2)"
_PARTS = "round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im"
_N2 = "(SELECT count(*) FROM embeddings)"
_PLACES = "(SELECT unnest(range(count(*))) AS k FROM embeddings)"


def _across_traces(source: str, sign: int, place: str = "i2", out: str = "k") -> str:
    """DuckDB transform of (i1, i2, re, im) along axis 2: place ``place`` against bin k, as ``out``."""
    w = f"(2 * pi() * (({place}) * k % {_N2}) / {_N2})"
    return f"(SELECT i1, {out} AS i2, sum(re * cos({w}) - {sign} * im * sin({w})) AS re, sum(im * cos({w}) + {sign} * re * sin({w})) AS im FROM {source}, {_PLACES} GROUP BY i1, k)"


_FK = _across_traces(_FULL, -1, out=f"(k + {_N2} // 2) % {_N2}")
register("fkspectrum", filters.fk_spectrum, f"SELECT i1, i2, round(sqrt(re * re + im * im), 6) + 0.0 AS v FROM {_FK}")
_SPEED = f"SELECT *, CASE WHEN i2 = {_N2} // 2 THEN CASE WHEN i1 = 32 THEN 0e0 ELSE 'inf'::DOUBLE END ELSE abs(i1 - 32) / 0.256e0 / (abs(i2 - {_N2} // 2) / {_N2}::DOUBLE) END AS s FROM {_FK}"
_KEPT = f"(SELECT i1, i2, re * w AS re, im * w AS im FROM (SELECT *, CASE WHEN s >= 10 THEN 1 WHEN s > 5 THEN 0.5 * (1 - cos(pi() * (s - 5) / 5)) ELSE 0 END * CASE WHEN s <= 400 THEN 1 WHEN s < 405 THEN 0.5 * (1 + cos(pi() * (s - 400) / 5)) ELSE 0 END AS w FROM ({_SPEED})))"
register("fkfilter", lambda c: filters.fk_filter(c, 10.0, 400.0, 5.0), f"SELECT t AS i1, i2, round(sum(re * cos(2 * pi() * (i1 - 32) * t / 64) - im * sin(2 * pi() * (i1 - 32) * t / 64)) / 64 / {_N2}, 6) + 0.0 AS v FROM {_across_traces(_KEPT, 1, f'i2 + {_N2} - {_N2} // 2')}, range(64) r(t) GROUP BY t, i2")
_ALTERNATED = f"(SELECT i1, i2, re * (1 - 2 * (i2 % 2)) AS re, im * (1 - 2 * (i2 % 2)) AS im FROM {DFT})"
register("spectra2", filters.spectra2, f"SELECT i1, i2, round(sqrt(re * re + im * im) / sqrt(64 * {_N2}), 6) + 0.0 AS v FROM {_across_traces(_ALTERNATED, -1)}")
register("fft_traces", lambda c: complexes.fft(c, 2).long(), f"SELECT i1, i2, {_PARTS} FROM {_across_traces(f'(SELECT i1, i2, v AS re, 0e0 AS im FROM {PANEL})', -1, out=f'(k + {_N2} // 2) % {_N2}')}")
register("rfft_traces", lambda c: complexes.rfft(c, 2).long(), f"SELECT i1, i2, {_PARTS} FROM {_across_traces(f'(SELECT i1, i2, v AS re, 0e0 AS im FROM {PANEL})', -1)} WHERE i2 <= {_N2} // 2")
register("irfft_traces", lambda c: complexes.irfft(complexes.conjugate(complexes.rfft(c, 2)), 2), f"SELECT i1, ({_N2} - i2) % {_N2} AS i2, round(v, 6) + 0.0 AS v FROM {PANEL}")
register("fft_real", lambda c: complexes.real(complexes.fft(c)), f"SELECT i1, i2, round(re, 6) + 0.0 AS v FROM {_FULL}")
register("fft_imag", lambda c: complexes.imag(complexes.fft(c)), f"SELECT i1, i2, round(im, 6) + 0.0 AS v FROM {_FULL}")
register("fft_axis2", lambda c: complexes.fft(reshape.reshape(c, (16, 4, c.meta.shape[1])), 2).long(), f"SELECT i1, i2, i3, {_PARTS} FROM (SELECT i1 % 16 AS i1, (k + 2) % 4 AS i2, i2 AS i3, sum(v * cos(pi() * (i1 // 16) * k / 2)) AS re, -sum(v * sin(pi() * (i1 // 16) * k / 2)) AS im FROM {PANEL}, range(4) r(k) GROUP BY 1, 2, 3)")
register("ifft", lambda c: complexes.real(complexes.ifft(complexes.conjugate(complexes.fft(c)))), f"SELECT (64 - i1) % 64 AS i1, i2, round(v, 6) + 0.0 AS v FROM {PANEL}")
register("rfft", lambda c: complexes.rfft(c).long(), f"SELECT i1, i2, {_PARTS} FROM {DFT}")
register("irfft", lambda c: complexes.irfft(complexes.conjugate(complexes.rfft(c))), f"SELECT (64 - i1) % 64 AS i1, i2, round(v, 6) + 0.0 AS v FROM {PANEL}")
register("fft1", lambda c: complexes.fft1(c).long(), f"SELECT i1, i2, {_PARTS} FROM {DFT}")
register("fft1_inverse", lambda c: complexes.fft1(complexes.fft1(c), inverse=True), f"SELECT i1, i2, round(v, 6) + 0.0 AS v FROM {PANEL}")
register("cmplx", lambda c: complexes.cmplx(c, c.map(F.abs)).long(), f"SELECT i1, i2, round(v, 6) + 0.0 AS re, round(abs(v), 6) + 0.0 AS im FROM {PANEL}")
register("rtoc", lambda c: complexes.rtoc(c).long(), f"SELECT i1, i2, round(v, 6) + 0.0 AS re, 0.0::DOUBLE AS im FROM {PANEL}")
register("real", lambda c: complexes.real(complexes.cmplx(c, c.map(F.abs))), f"SELECT i1, i2, round(v, 6) + 0.0 AS v FROM {PANEL}")
register("imag", lambda c: complexes.imag(complexes.cmplx(c, c.map(F.abs))), f"SELECT i1, i2, round(abs(v), 6) + 0.0 AS v FROM {PANEL}")
register("modulus", lambda c: complexes.modulus(complexes.cmplx(c, c.map(lambda v: v * v))), f"SELECT i1, i2, round(sqrt(v * v + pow(v, 4)), 6) + 0.0 AS v FROM {PANEL}")
register("phase", lambda c: complexes.phase(complexes.cmplx(c, c.map(lambda v: v * v + 1))), f"SELECT i1, i2, round(atan2(v * v + 1, v), 6) + 0.0 AS v FROM {PANEL}")
register("complex_cg", plain=lambda s, d: _complex_system(s, d), sql="SELECT unnest([0::BIGINT, 1]) AS i, unnest([round(3 * m / 5, 6), 0.0]) + 0.0 AS re, unnest([0.0, round(4 * m / 5, 6)]) + 0.0 AS im FROM (SELECT avg(p_size) AS m FROM part)")
register("grad3", lambda c: neighbour.sobel3(reshape.reshape(c, (16, 4, c.meta.shape[1]))), f"""WITH t AS (SELECT i1 % 16 AS i1, i1 // 16 AS i2, i2 AS i3, v FROM {PANEL}),
a AS (SELECT *, lag(v) OVER w + 4 * v + lead(v) OVER w AS a, lead(v) OVER w - lag(v) OVER w AS b FROM t WINDOW w AS (PARTITION BY i1, i3 ORDER BY i2)),
p AS (SELECT *, lag(a) OVER w + 4 * a + lead(a) OVER w - 12 * v AS p, lag(b) OVER w + 4 * b + lead(b) OVER w AS q, lead(a) OVER w - lag(a) OVER w AS r, lead(v) OVER w - lag(v) OVER w AS s FROM a WINDOW w AS (PARTITION BY i1, i2 ORDER BY i3)),
g AS (SELECT *, lead(p) OVER w - lag(p) OVER w AS x, lag(q) OVER w + 4 * q + lead(q) OVER w - 12 * b AS y, lag(r) OVER w + 4 * r + lead(r) OVER w - 12 * s AS z FROM p WINDOW w AS (PARTITION BY i2, i3 ORDER BY i1))
SELECT i1, i2, i3, round(coalesce((x * x + y * y + z * z) / 36, 0), 6) + 0.0 AS v FROM g""")
register("intbin3", plain=lambda s, d: headers.intbin3(table(s, d, "lineitem"), F.col("l_linenumber"), F.col("l_suppkey") % 10, F.col("l_orderkey") % 8, F.col("l_quantity"), F.col("l_orderkey"), (Axis(7, 1.0), Axis(10, 0.0), Axis(8, 0.0))), sql="SELECT a AS i1, b AS i2, c AS i3, coalesce(max_by(l_quantity, l_orderkey * 100 + l_quantity), 0)::DOUBLE AS v FROM range(7) x(a), range(10) y(b), range(8) z(c) LEFT JOIN lineitem ON l_linenumber - 1 = a AND l_suppkey % 10 = b AND l_orderkey % 8 = c GROUP BY a, b, c")


def _traces_by(keys: dict[str, str], bounds: list | None = None) -> Query:
    """Traces of the panel on a grid of integer keys, zeros where there is none."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        heads = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trace"), *[F.expr(k).alias(name) for name, k in keys.items()])
        return rounded(headers.filled(headers.bin_traces(panel(spark, sf_dir), heads, list(keys), bounds)))

    return query


register("intbin_traces", plain=_traces_by({"x": "vec_id % 20", "y": "coalesce(label, 0)"}, [(2, 15), (None, None)]), sql="""WITH h AS (SELECT vec_id, vec_id % 20 AS x, coalesce(label, 0) AS y FROM embeddings), w AS (SELECT x, y, max(vec_id) AS t FROM h GROUP BY x, y), b AS (SELECT min(y) AS low, max(y) AS high FROM h)
SELECT i1, cx - 2 AS i2, cy - low AS i3, round(coalesce(embedding[i1 + 1]::DOUBLE, 0), 6) + 0.0 AS v FROM (SELECT unnest(range(2, 16)) AS cx), (SELECT unnest(range(low, high + 1)) AS cy, low FROM b), range(64) r(i1) LEFT JOIN w ON x = cx AND y = cy LEFT JOIN embeddings ON vec_id = t""")
register("intbin3_traces", plain=_traces_by({"x": "vec_id % 5 - 2", "y": "coalesce(label, 0)", "z": "vec_id div 100 % 3"}), sql="""WITH h AS (SELECT vec_id, vec_id % 5 - 2 AS x, coalesce(label, 0) AS y, vec_id // 100 % 3 AS z FROM embeddings), w AS (SELECT x, y, z, max(vec_id) AS t FROM h GROUP BY x, y, z), b AS (SELECT min(y) AS low, max(y) AS high FROM h)
SELECT i1, cx + 2 AS i2, cy - low AS i3, cz AS i4, round(coalesce(embedding[i1 + 1]::DOUBLE, 0), 6) + 0.0 AS v FROM (SELECT unnest(range(-2, 3)) AS cx), (SELECT unnest(range(low, high + 1)) AS cy, low FROM b), range(3) z(cz), range(64) r(i1) LEFT JOIN w ON x = cx AND y = cy AND z = cz LEFT JOIN embeddings ON vec_id = t""")
register("parabolic_radon", lambda c: resample.radon(c, _offset(), [0.001, 0.004], parabolic=True, x0=100.0).drop("gather"), f"SELECT k AS i1, j AS i2, round(sum(a), 6) + 0.0 AS v FROM (SELECT k, j, {_lerp('p')} AS a FROM (SELECT *, k + p0 * pow({_H} / 100e0, 2) / 0.004e0 AS p FROM {_E}, range(64) r(k), (VALUES (0::BIGINT, 0.001::DOUBLE), (1, 0.004)) s(j, p0))) GROUP BY k, j")

# datasets: written to the shared folder and read back
def _dataset(write: Callable[[Cube, str], None], read: Callable[[SparkSession, str], Cube | DataFrame] = rsf.read) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{solvers.shared_folder(spark)}/{uuid.uuid4().hex}"
        write(panel(spark, sf_dir), path)
        return read(spark, path)

    return query


def _converted(kind: str, **options) -> Callable[[Cube, str], None]:
    def write(c: Cube, path: str) -> None:
        rsf.write(c, path + ".first")
        rsf.convert(c.df.sparkSession, path + ".first", path, kind, **options)

    return write


def _copied(c: Cube, path: str) -> None:
    rsf.write(c, path + ".first")
    rsf.copy(path + ".first", path)
    rsf.remove(path + ".first", dry_run=False, confirm=True)


def _segy(c: Cube, path: str) -> None:
    segy.write(c.df.select(F.col("i2").alias("trace"), "samples", (F.col("i2") % 7).cast("int").alias("cdp"), (F.col("i2") * 25).cast("int").alias("offset")), path, N, 4000)


def _put(c: Cube, path: str) -> None:
    rsf.write(c, path)
    rsf.put(path, label2="Shot", o2=5)


def _words(spark: SparkSession, path: str) -> DataFrame:
    keys = ["n1", "o2", "label1", "label2", "data_format"]
    return spark.createDataFrame(list(zip(keys, rsf.get(path, *keys), strict=True)), "key string, value string")


_SAMPLES = f"SELECT i1, i2, round(v, 6) + 0.0 AS v FROM {PANEL}"
register("dataset", plain=lambda s, d: rounded(_dataset(rsf.write)(s, d)), sql=_SAMPLES)
register("dataset_xdr", plain=lambda s, d: rounded(_dataset(lambda c, p: rsf.write(c, p, "xdr_double"))(s, d)), sql=_SAMPLES)
register("dataset_text", plain=lambda s, d: rounded(_dataset(_converted("ascii_float"))(s, d)), sql=_SAMPLES)
register("dataset_int", plain=lambda s, d: rounded(_dataset(_converted("native_int", truncate=True))(s, d)), sql=f"SELECT i1, i2, trunc(v) + 0.0 AS v FROM {PANEL}")
register("dataset_copy", plain=lambda s, d: rounded(_dataset(_copied)(s, d)), sql=_SAMPLES)
register("dataset_complex", plain=lambda s, d: _dataset(lambda c, p: rsf.write(complexes.cmplx(c, c.map(F.abs)), p, "native_double_complex"))(s, d).long(), sql=ORACLES["cmplx"])
register("dataset_words", plain=_dataset(_put, _words), sql="SELECT * FROM (VALUES ('n1', '64'), ('o2', '5'), ('label1', 'Time'), ('label2', 'Shot'), ('data_format', 'native_float')) t(key, value)")
register("header_table", plain=_dataset(lambda c, p: rsf.write_table(c.df.select("i2", (F.col("i2") * 2).alias("twice"), F.element_at("samples", 1).alias("first")), ["twice", "first"], p, "i2"), rsf.read_table), sql="SELECT vec_id AS trace, (vec_id * 2)::DOUBLE AS twice, round(embedding[1]::DOUBLE, 6) + 0.0 AS first FROM embeddings")
register("segy", plain=_dataset(_segy, lambda s, p: segy.read(s, p)[0].select(F.col("trace").alias("i2"), F.posexplode("samples").alias("i1", "v")).select(F.col("i1").cast("long").alias("i1"), "i2", F.col("v").cast("double").alias("v"))), sql=_SAMPLES)
_RANGE = "trace >= 100 AND trace < 260 AND trace <> 170"
register("segy_range", plain=_dataset(_segy, lambda s, p: planned.segy_traces(s, p, ["trace", "cdp", "samples"], partition_bytes=40_000).where(_RANGE).select("trace", "cdp", F.element_at("samples", 3).cast("double").alias("third"))), sql="SELECT vec_id AS trace, (vec_id % 7)::INT AS cdp, round(embedding[3]::DOUBLE, 6) + 0.0 AS third FROM embeddings WHERE vec_id >= 100 AND vec_id < 260 AND vec_id <> 170")
register("dataset_range", plain=lambda s, d: rounded(_dataset(lambda c, p: rsf.write(c, p, "native_double"), lambda s, p: planned.dataset_traces(s, p, ["i2", "samples"], partition_bytes=40_000).where("i2 IN (3, 4, 5, 77, 400)").select("i2", F.posexplode("samples").alias("i1", "v")).select(F.col("i1").cast("long").alias("i1"), "i2", "v"))(s, d)), sql=f"{_SAMPLES} WHERE i2 IN (3, 4, 5, 77, 400)")
register("segy_headers", plain=_dataset(_segy, lambda s, p: segy.header_table(s, p, "cdp", "offset", "ns", "dt")), sql="SELECT vec_id AS trace, (vec_id % 7)::INT AS cdp, (vec_id * 25)::INT AS \"offset\", 64 AS ns, 4000 AS dt FROM embeddings")
register("compare", plain=lambda s, d: metrics.compare(panel(s, d), panel(s, d).map(lambda v: F.when(v > 1, v + 0.25).otherwise(v))), sql=f"SELECT count(*) FILTER (v > 1) = 0 AS same, count(*) AS samples, count(*) FILTER (v > 1) AS different, round(coalesce(max(0.25::DOUBLE) FILTER (v > 1), 0), 6) + 0.0 AS max_abs, round(max(CASE WHEN v > 1 THEN 0.25 / (v + 0.25) ELSE 0 END), 6) + 0.0 AS max_rel FROM {PANEL}")
register("panel_metrics", lambda c: metrics.panel_metrics(c, (10, 30), (40, 60)), f"""SELECT * FROM (SELECT round(a, 6) + 0.0 AS rms, round(b, 6) + 0.0 AS signal_rms, round(c, 6) + 0.0 AS noise_rms, round(20 * log10(b / c), 6) + 0.0 AS snr_db FROM (SELECT sqrt(avg(v * v)) AS a, sqrt(avg(v * v) FILTER (i1 BETWEEN 10 AND 29)) AS b, sqrt(avg(v * v) FILTER (i1 BETWEEN 40 AND 59)) AS c FROM {PANEL})),
(SELECT round(avg(top), 6) + 0.0 AS dominant_frequency, round(avg(t), 6) + 0.0 AS target_band_energy, round(avg(r), 6) + 0.0 AS reject_band_energy FROM (SELECT i2, arg_max(i1, p) / 0.256e0 AS top, sum(p) FILTER (i1 / 0.256e0 BETWEEN 15 AND 35) / 32 AS t, sum(p) FILTER (i1 / 0.256e0 BETWEEN 60 AND 80) / 32 AS r FROM (SELECT i1, i2, re * re + im * im AS p FROM {DFT}) GROUP BY i2))""")


def _processed(c: Cube) -> DataFrame:
    """A few metrics of a filter, a mute and a stack of the panel."""
    gather = Cube(c.df, Meta((TIME, Axis(c.meta.shape[1], 0.0, 0.1, "Offset", "m"))), "trace")
    low = spectral.bandpass(gather, 8.0, 60.0, 4.0)
    last = pointwise.mute(low, 0.02, 1500.0, gather.coordinate(2))
    got = metrics.processing_metrics(gather, gather, low, last, agg.stack(gather, 2, "mean", False), (10, 30), (40, 60), mute_from=0.02, mute_velocity=1500.0)
    spark = c.df.sparkSession
    return spark.range(1).select(*[F.lit(got[k]).alias(k) for k in ("input_rms", "snr_before_db", "muted_fraction", "mute_zero_fraction", "finite_fraction", "stack_signal_window_rms", "header_axis_ok")])


register("processing_metrics", lambda c: _processed(c), f"""SELECT round(sqrt(avg(v * v)), 6) + 0.0 AS input_rms, round(20 * log10(sqrt(avg(v * v) FILTER (i1 BETWEEN 10 AND 29)) / sqrt(avg(v * v) FILTER (i1 BETWEEN 40 AND 59))), 6) + 0.0 AS snr_before_db, round(avg((i1 * 0.004e0 < 0.02e0 + i2 * 0.1e0 / 1500)::INT), 6) + 0.0 AS muted_fraction, 1.0::DOUBLE AS mute_zero_fraction, 1.0::DOUBLE AS finite_fraction,
(SELECT round(sqrt(avg(m * m)), 6) + 0.0 FROM (SELECT i1, avg(v) AS m FROM {PANEL} WHERE i1 BETWEEN 10 AND 29 GROUP BY i1)) AS stack_signal_window_rms, true AS header_axis_ok FROM {PANEL}""")
register("source_receiver", plain=lambda s, d: metrics.source_receiver_table(s, Axis(max(1, table(s, d, "embeddings").count()), -500.0, 50.0), 100.0), sql="SELECT vec_id AS trace, 100 - h / 2 AS source_x, 100 + h / 2 AS receiver_x, h AS \"offset\", 100.0::DOUBLE AS midpoint, vec_id + 1 AS channel, 1::BIGINT AS source_id, vec_id + 1 AS receiver_id FROM (SELECT vec_id, -500e0 + 50 * vec_id AS h FROM embeddings)")
register("plane_wave", lambda c: pointwise.combine(c, metrics.plane_wave(c.df.sparkSession, N, 0.02, Axis(c.meta.shape[1], -115.0, 10.0), level=0.0), "add"), f"SELECT i1, i2, round(v + (1 - 2 * s) * exp(-s), 6) + 0.0 AS v FROM (SELECT *, pow(pi() * 30 * (i1 * 0.02e0 - (0.45e0 + (10 * i2 - 115) / 1500e0)), 2) AS s FROM {PANEL})")
register("axis_values", plain=lambda s, d: pointwise.with_axis_values(panel(s, d), table(s, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").alias("w")), 2).long().df.select("i1", "i2", "v"), sql=f"SELECT i1, i2, round(v * coalesce(label, 0), 6) + 0.0 AS v FROM {PANEL}")

# windows, filters and solvers
_ANGLE = "2 * pi() * i1 / 63"
_WINDOWS = {"hann": f"0.5 - 0.5 * cos({_ANGLE})", "hamming": f"0.54 - 0.46 * cos({_ANGLE})", "blackman": f"0.42 - 0.5 * cos({_ANGLE}) + 0.08 * cos(2 * {_ANGLE})", "bartlett": "1 - abs(i1 / 31.5e0 - 1)"}
register("window_function", lambda c: _weighted_sums(c), f"SELECT i2, {', '.join(f'round(sum(v * ({w})), 6) + 0.0 AS {name}' for name, w in _WINDOWS.items())} FROM {PANEL} GROUP BY i2")
register("firwin", lambda c: c.map_traces(lambda x: x[:, :21] @ spectral.firwin(21, 40.0, 250.0)[:, None], Axis(1)), f"SELECT 0::BIGINT AS i1, vec_id AS i2, round(sum(h * embedding[j + 1]::DOUBLE), 6) + 0.0 AS v FROM embeddings, {_SINC} GROUP BY vec_id")
_GAIN = f"(SELECT k, sqrt(pow(sum(h * cos(2 * pi() * k * j / 64)), 2) + pow(sum(h * sin(2 * pi() * k * j / 64)), 2)) AS gain FROM {_SINC}, range(33) r(k) GROUP BY k)"
register("freqz", lambda c: _answered(c), f"SELECT i1, i2, round(gain * sqrt(re * re + im * im), 6) + 0.0 AS v FROM {DFT} JOIN {_GAIN} ON k = i1")
register("welchcsd", lambda c: cross.csd(c, c.map(F.abs), 32), f"""SELECT k AS i1, i2, round(avg(re * re2 + im * im2) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END * 0.004e0 / (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * m / 31), 2)) FROM range(32) r(m)), 6) + 0.0 AS v FROM
(SELECT k, i2, g, sum(v * w * cos(2 * pi() * m * k / 32)) AS re, sum(v * w * sin(2 * pi() * m * k / 32)) AS im, sum(abs(v) * w * cos(2 * pi() * m * k / 32)) AS re2, sum(abs(v) * w * sin(2 * pi() * m * k / 32)) AS im2 FROM (SELECT i2, g, i1 - 16 * g AS m, v, 0.5 - 0.5 * cos(2 * pi() * (i1 - 16 * g) / 31) AS w FROM {PANEL}, range(3) s(g) WHERE i1 - 16 * g BETWEEN 0 AND 31), range(17) q(k) GROUP BY k, i2, g) GROUP BY k, i2""")
register("cg", plain=lambda s, d: _normal_system(s, d), sql=ORACLES["least_squares"])
register("cgnr", plain=lambda s, d: _solved(s, d, solvers.cgnr, steps=4, tol=1e-13), sql=ORACLES["least_squares"])
register("cgls", plain=lambda s, d: _solved(s, d, solvers.cgls, steps=4, tol=1e-13), sql=ORACLES["least_squares"])
register("cgls_preconditioned", plain=lambda s, d: _solved(s, d, solvers.cgls, steps=4, tol=1e-13, preconditioner=solvers.diagonal(s.createDataFrame([(0, 2.0), (1, 5.0)], "i long, v double"), 2)), sql=ORACLES["least_squares"])
register("differences", lambda c: solvers.differences(N * c.meta.shape[1], 2).forward(_vector(c)), f"SELECT i, round(v, 6) + 0.0 AS v FROM (SELECT 64 * i2 + i1 AS i, v - 2 * lead(v) OVER w + lead(v, 2) OVER w AS v FROM {PANEL} WINDOW w AS (ORDER BY i2, i1)) WHERE v IS NOT NULL")
register("custom_operator", lambda c: _ramped(c), f"SELECT 64 * i2 + i1 AS i, round(3 * (64 * i2 + i1) * v, 6) + 0.0 AS v FROM {PANEL}")
register("dot_test", plain=lambda s, d: _adjoint_agrees(s, d), sql="SELECT true AS same, count(*) AS entries FROM lineitem")

# generators
register("spike", lambda c: pointwise.combine(c, generators.spike(c.df.sparkSession, c.meta.axes, [(5, 7), (64, 40)], [1.5, -2.0]), "add"), f"SELECT i1, i2, round(v + CASE WHEN i1 = 4 AND i2 = 6 THEN 1.5 WHEN i1 = 63 AND i2 = 39 THEN -2.0 ELSE 0.0 END, 6) + 0.0 AS v FROM {PANEL}")
register("ricker", lambda c: pointwise.with_axis_values(c, generators.ricker(c.df.sparkSession, 25.0, TIME).df.withColumnsRenamed({"i1": "i", "v": "w"}), 1), f"SELECT i1, i2, round(v * (1 - 2 * s) * exp(-s), 6) + 0.0 AS v FROM (SELECT *, pow(pi() * 25 * (i1 * 0.004 - 0.04), 2) AS s FROM {PANEL})")
register("noise", lambda c: generators.noise(c, 1.0, 0.0, 11))


def _taps():
    import numpy as np

    return np.array([0.25, 0.5, 0.25])


def resample_spline(c: Cube) -> Cube:
    return spectral.spline(c, Axis(50, 0.01, 0.005))


def _taps_of_four():
    import numpy as np

    return np.array([1.0, -0.5, 2.0, 0.25])


def _matrix():
    import numpy as np

    return 1 / (1.0 + np.arange(5)[:, None] + np.arange(N))


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as a sparse matrix of suppliers by parts, times the sizes of parts."""
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("value"))
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("v"))
    return solvers.Matrix(entries, 0, 0).forward(sizes)


def _picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("0D AS sx", "0D AS sz", "vec_id % 100 * 1D AS rx", "0D AS rz", "0.05D + 0.001D * (vec_id % 7) AS observed", "1D AS weight")


def _vector(c: Cube) -> DataFrame:
    """All samples of the panel as one vector."""
    return c.long().df.select((F.col("i2") * N + F.col("i1")).alias("i"), "v")


def _ramped(c: Cube) -> DataFrame:
    """An operator of the caller's own, scaled and composed, on the whole panel."""
    n = N * c.meta.shape[1]
    times = lambda x: x.select("i", (F.col("v") * F.col("i")).alias("v"))
    return solvers.composed(solvers.scaled(solvers.identity(n), 3.0), solvers.Custom(n, n, times, times)).forward(_vector(c))


def _weighted_sums(c: Cube) -> DataFrame:
    """Each trace under four windows of its own length."""
    names = list(_WINDOWS)
    sums = c.map_traces(lambda x: np.stack([x @ spectral.window_weights(N, w) for w in names], axis=1), Axis(len(names)))
    return sums.df.select("i2", *[F.element_at("samples", k).alias(w) for k, w in enumerate(names, 1)])


def _answered(c: Cube) -> Cube:
    """Amplitudes of each trace behind a filter."""
    gain = np.abs(cross.frequency_response(spectral.firwin(21, 40.0, 250.0), 250.0, 64)[1])
    return c.map_traces(lambda x: np.abs(np.fft.rfft(x)) * gain, Axis(len(gain)))


def _adjoint_agrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dot test of a matrix with an entry for each line item, over differences."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("row"), F.col("l_suppkey").cast("long").alias("col"), F.col("l_quantity").cast("double").alias("value"))
    entries, last, most = rows.agg(F.count("*"), F.max("row"), F.max("col")).first()
    columns = (most or 0) + 3
    matrix = solvers.stacked(solvers.Matrix(rows, (last or 0) + 1, columns), solvers.differences(columns, 2))
    same = solvers.dot_test(spark, matrix)[2]
    return spark.range(1).select(F.lit(same).alias("same"), F.lit(entries).cast("long").alias("entries"))


def _normal_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same line by conjugate gradients on its two normal equations."""
    part = table(spark, sf_dir, "part").select((F.col("p_size") / 50.0).alias("x"), F.col("p_retailprice").alias("y"))
    sums = part.agg(F.count("*").cast("double").alias("n"), F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("y")).alias("xy"))
    cell = lambda i, j, v: F.struct(F.lit(i).cast("long").alias("row"), F.lit(j).cast("long").alias("col"), F.col(v).alias("value"))
    place = lambda i, v: F.struct(F.lit(i).cast("long").alias("i"), F.col(v).alias("v"))
    entries = sums.select(F.explode(F.array(cell(0, 0, "n"), cell(0, 1, "x"), cell(1, 0, "x"), cell(1, 1, "xx"))).alias("e")).select("e.*")
    right = sums.select(F.explode(F.array(place(0, "y"), place(1, "xy"))).alias("e")).select("e.*")
    return solvers.conjugate_gradient(solvers.Matrix(entries, 2, 2), right, steps=4, tol=1e-13).x.select("i", F.round("v", 4).alias("v"))


def _solved(spark: SparkSession, sf_dir: str, solver=solvers.lsqr, **options) -> DataFrame:
    """Line through price over size / 50 by a solver, each part a row of the matrix."""
    options = options or {"steps": 2, "tol": 0.0}
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("x"), "p_retailprice")
    entries = part.select(F.col("p_partkey").alias("row"), F.posexplode(F.array(F.lit(1.0), F.col("x"))).alias("col", "value")).withColumn("col", F.col("col").cast("long"))
    found = solver(solvers.Matrix(entries, 0, 2), part.select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("v")), **options)
    return found.x.select("i", F.round("v", 4).alias("v"))


def _complex_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[[3, i], [-i, 2]] x = (m, i m), m being the mean size of a part."""
    entries = spark.createDataFrame([(0, 0, 3.0, 0.0), (0, 1, 0.0, 1.0), (1, 0, 0.0, -1.0), (1, 1, 2.0, 0.0)], "row long, col long, re double, im double")
    mean = table(spark, sf_dir, "part").agg(F.avg("p_size").alias("m"))
    right = mean.select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("i"), F.col("m").alias("re"), F.lit(0.0).alias("im")), F.struct(F.lit(1).cast("long").alias("i"), F.lit(0.0).alias("re"), F.col("m").alias("im")))).alias("e")).select("e.*")
    return complexes.complex_conjugate_gradient(entries, right, 2, steps=4, tol=1e-12).x


def _survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shot for each nation over a layered model."""
    model = modelling.layered_velocity(spark, Axis(40, 0.0, 10.0), Axis(60, 0.0, 10.0), [(0.0, 1500.0), (200.0, 2500.0)])
    shots = table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey AS long) AS shot", "cast(n_nationkey * 2 + 5 AS int) AS sx", "2 AS sz", "array(5, 20, 35, 50) AS rx", "array(2, 2, 2, 2) AS rz")
    traces = modelling.acoustic_survey(shots, model, Axis(150, 0.0, 0.002), 20.0)
    return traces.select("shot", "i2", F.posexplode("samples").alias("i1", "v")).withColumn("i1", F.col("i1").cast("long"))
