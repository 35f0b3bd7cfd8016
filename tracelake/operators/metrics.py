"""Comparison of cubes, metrics of panels, geometry contracts and signal fixtures."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.cube import Axis, Cube, Meta, grid
from tracelake.operators.generators import add_noise


def compare(a: Cube, b: Cube, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """One row (same, samples, different, max_abs, max_rel): whether |a - b| <= atol + rtol |b| everywhere; NaN equals NaN.

    Cubes of different shape are not the same, with nulls for the rest.
    """
    spark = a.df.sparkSession
    if a.meta.shape != b.meta.shape:
        return spark.range(1).selectExpr("false AS same", "cast(null AS long) AS samples", "cast(null AS long) AS different", "cast(null AS double) AS max_abs", "cast(null AS double) AS max_rel")
    x, y = a.long(), b.long()
    v, w = F.col("v"), F.col("w")
    off = F.abs(v - w)
    close = (F.isnan(v) & F.isnan(w)) | (v == w) | F.coalesce(off <= F.abs(w) * rtol + atol, F.lit(False)) & ~F.isnan(off)
    fine = F.when(~F.isnan(off), off)
    both = x.df.join(y.df.withColumnRenamed("v", "w"), x.keys, "full")
    close = F.coalesce(close, F.lit(False))
    return both.agg(F.coalesce(F.every(close), F.lit(True)).alias("same"), F.count("*").alias("samples"), F.count_if(~close).alias("different"), F.max(fine).alias("max_abs"), F.max(F.try_divide(fine, F.abs(w))).alias("max_rel"))


def compare_headers(a: Meta, b: Meta, rtol: float = 1e-9) -> list[str]:
    """What differs between two headers: axes by number, then words."""
    out = []
    for k in range(max(len(a.axes), len(b.axes))):
        x, y = (m.axes[k] if k < len(m.axes) else None for m in (a, b))
        if x is None or y is None or x.n != y.n or not (math.isclose(x.o, y.o, rel_tol=rtol, abs_tol=1e-12) and math.isclose(x.d, y.d, rel_tol=rtol)) or (x.label, x.unit) != (y.label, y.unit):
            out.append(f"axis {k + 1}: {x} and {y}")
    return out + [f"{w}: {a.attrs.get(w)} and {b.attrs.get(w)}" for w in sorted(a.attrs.keys() | b.attrs.keys()) if a.attrs.get(w) != b.attrs.get(w)]


def panel_metrics(c: Cube, signal: tuple[int, int], quiet: tuple[int, int], target: tuple[float, float] = (15.0, 35.0), reject: tuple[float, float] = (60.0, 80.0)) -> DataFrame:
    """One row: rms, rms of the signal and the quiet window [from, to), their ratio in dB, mean dominant frequency, mean energies of two bands.

    Each trace gives its sums; those are added before the exchange.
    """
    a = c.meta.axes[0]
    if max(signal[0], quiet[0]) < min(signal[1], quiet[1]):
        raise ValueError("the windows overlap")
    f = np.fft.rfftfreq(a.n, a.d)
    twice = np.where((np.arange(len(f)) > 0) & (2 * np.arange(len(f)) < a.n), 2.0, 1.0)
    bands = np.array([(f >= low) & (f <= high) for low, high in (target, reject)], float)

    def kernel(x: np.ndarray) -> np.ndarray:
        power = np.abs(np.fft.rfft(x)) ** 2
        square = x * x
        sums = np.stack([square.sum(axis=1), square[:, slice(*signal)].sum(axis=1), square[:, slice(*quiet)].sum(axis=1), f[power.argmax(axis=1)]], axis=1)
        return np.concatenate([sums, (power * twice / a.n) @ bands.T], axis=1)

    s = lambda k: F.element_at("samples", k)
    root = lambda k, n: F.sqrt(F.sum(s(k)) / (F.count("*") * n))
    out = c.map_traces(kernel, Axis(6)).df.agg(root(1, a.n).alias("rms"), root(2, signal[1] - signal[0]).alias("signal_rms"), root(3, quiet[1] - quiet[0]).alias("noise_rms"), F.avg(s(4)).alias("dominant_frequency"), F.avg(s(5)).alias("target_band_energy"), F.avg(s(6)).alias("reject_band_energy"))
    eps = float(np.finfo(float).eps)
    return out.withColumn("snr_db", 20 * F.log10(F.greatest(F.col("signal_rms") / F.greatest("noise_rms", F.lit(eps)), F.lit(eps))))


EPS = float(np.finfo(float).eps)


def processing_metrics(raw: Cube, before: Cube, after: Cube, processed: Cube, stacked: Cube, signal: tuple[int, int], quiet: tuple[int, int], target: tuple[float, float] = (15.0, 35.0), reject: tuple[float, float] = (60.0, 80.0), mute_from: float = 0.08, mute_velocity: float = 4000.0) -> dict[str, float | bool]:
    """What the stages of a gather's processing did: signal to noise and bands before and after a filter, the mute, the stack.

    Gathers have one shape; ``stacked`` is their stack over axis 2.  Each gather
    gives one row of sums; nothing else comes to the driver.
    """
    gathers = (raw, before, after, processed)
    if any(g.rank != 2 or g.meta.shape != raw.meta.shape for g in gathers):
        raise ValueError("the gathers are of one shape, with two axes")
    time, offset = raw.meta.axes
    if stacked.meta.shape[0] != time.n or stacked.rank != 1:
        raise ValueError("the stack is as long as the gathers")
    if not mute_velocity > 0:
        raise ValueError("a velocity is positive")
    one, two, last, line = (panel_metrics(c, signal, quiet, target, reject).first() for c in (before, after, processed, stacked))
    ratio = lambda a, b: a / max(b, EPS)
    finite = lambda c: c.long().df.agg(F.count("*"), F.count_if(~F.isnan("v") & (F.abs("v") < float("inf"))), F.sqrt(F.avg(F.col("v") * F.col("v")))).first()
    sums = [finite(c) for c in (*gathers, stacked)]
    own = processed.long()
    muted = time.coordinate(F.col("i1")) < F.lit(mute_from) + F.abs(offset.coordinate(F.col("i2"))) / mute_velocity
    all_, hit, zero = own.df.agg(F.count("*"), F.count_if(muted), F.count_if(muted & (F.abs("v") <= 1e-8))).first()
    inside = stacked.long().df.where(F.col("i1").between(signal[0], signal[1] - 1))
    peak = inside.agg(F.max(F.struct(F.abs("v").alias("size"), (-F.col("i1")).alias("at"), F.col("v").alias("v"))).alias("m")).first()["m"]
    bands = {f"{name}_band_energy_{when}": row[f"{name}_band_energy"] for name in ("target", "reject") for when, row in (("before", one), ("after", two))}
    windows = {f"{name}_window_rms_{when}": row[f"{name}_rms"] for name in ("noise", "signal") for when, row in (("before", one), ("after", two))}
    return {
        "input_rms": sums[0][2],
        "output_rms": sums[3][2],
        **windows,
        "snr_before_db": one["snr_db"],
        "snr_after_db": two["snr_db"],
        "snr_improvement_db": two["snr_db"] - one["snr_db"],
        "stack_peak_time": time.o - peak["at"] * time.d,
        "stack_peak_amplitude": peak["v"],
        "stack_signal_window_rms": line["signal_rms"],
        "stack_noise_window_rms": line["noise_rms"],
        "stack_snr_db": line["snr_db"],
        "dominant_frequency_before": one["dominant_frequency"],
        "dominant_frequency_after": two["dominant_frequency"],
        **bands,
        "target_band_energy_ratio": ratio(two["target_band_energy"], one["target_band_energy"]),
        "reject_band_energy_ratio": ratio(two["reject_band_energy"], one["reject_band_energy"]),
        "processed_noise_window_rms": last["noise_rms"],
        "stack_noise_reduction_ratio": ratio(line["noise_rms"], last["noise_rms"]),
        "finite_fraction": sum(s[1] for s in sums) / sum(s[0] for s in sums),
        "muted_fraction": hit / all_,
        "mute_zero_fraction": zero / hit if hit else 1.0,
        "header_axis_ok": _stages_agree(raw, (before, after, processed), stacked),
    }


def _stages_agree(raw: Cube, later: tuple[Cube, ...], stacked: Cube) -> bool:
    """Whether a regular gather of offsets kept its axes through all stages."""
    time, offset = raw.meta.axes
    named = (time.label, time.unit, offset.label, offset.unit) == ("Time", "s", "Offset", "m")
    return named and all(c.meta.axes == raw.meta.axes for c in later) and stacked.meta.axes[0] == time


def check_processing(metrics: dict[str, float | bool], least_snr_db: float = 6.0, target_ratio: tuple[float, float] = (0.75, 1.1), most_reject_ratio: float = 0.02, most_stack_noise: float = 0.45) -> dict[str, bool]:
    """The metrics against thresholds; ``overall_pass`` if all hold."""
    if target_ratio[0] > target_ratio[1] or min(most_reject_ratio, most_stack_noise) < 0:
        raise ValueError("thresholds out of order or below 0")
    checks = {
        "snr_improved": metrics["snr_improvement_db"] >= least_snr_db,
        "target_band_preserved": target_ratio[0] <= metrics["target_band_energy_ratio"] <= target_ratio[1],
        "reject_band_attenuated": metrics["reject_band_energy_ratio"] <= most_reject_ratio,
        "stack_noise_reduced": metrics["stack_noise_reduction_ratio"] <= most_stack_noise,
        "mute_applied": metrics["muted_fraction"] > 0 and metrics["mute_zero_fraction"] >= 0.999,
        "finite": math.isclose(metrics["finite_fraction"], 1.0, rel_tol=1e-5),
        "header_axis_ok": bool(metrics["header_axis_ok"]),
    }
    return checks | {"overall_pass": all(checks.values())}


def compare_reports(before: dict[str, float | bool], after: dict[str, float | bool], rtol: float = 1e-9) -> dict[str, tuple]:
    """The metrics in which two reports differ, or which only one has (the other being None)."""
    same = lambda a, b: a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=rtol))
    return {k: (before.get(k), after.get(k)) for k in sorted(before.keys() | after.keys()) if not same(before.get(k), after.get(k))}


# geometry contracts
def source_receiver_table(spark: SparkSession, offsets: Axis, midpoint: float = 0.0, source: int = 1) -> DataFrame:
    """(trace, source_x, receiver_x, offset, midpoint, channel, source_id, receiver_id) of one midpoint with a trace for each offset."""
    offset = offsets.coordinate(F.col("id"))
    return spark.range(offsets.n).select(F.col("id").alias("trace"), (F.lit(midpoint) - offset / 2).alias("source_x"), (F.lit(midpoint) + offset / 2).alias("receiver_x"), offset.alias("offset"), F.lit(float(midpoint)).alias("midpoint"), (F.col("id") + 1).alias("channel"), F.lit(source).cast("long").alias("source_id"), (F.col("id") + 1).alias("receiver_id"))


def broken_geometry(table: DataFrame, atol: float = 1e-6) -> DataFrame:
    """Rows of a source-receiver table whose offset or midpoint is not that of its coordinates, or not finite."""
    off = lambda name, want: F.coalesce(~(F.abs(F.col(name) - want) <= atol), F.lit(True)) | F.isnan(name)
    return table.where(off("offset", F.col("receiver_x") - F.col("source_x")) | off("midpoint", (F.col("receiver_x") + F.col("source_x")) / 2))


def regular_offsets(c: Cube, traces: int | None = None) -> Axis:
    """Axis 2 of a gather, checked: Offset by name, with a unit, finite and ascending, of ``traces`` places."""
    if c.rank < 2:
        raise ValueError("a gather has two axes or more")
    a = c.meta.axis(2)
    good = {"a label of Offset": a.label == "Offset", "a unit": bool(a.unit), "a finite start": math.isfinite(a.o), "a positive step": math.isfinite(a.d) and a.d > 0, f"{traces} traces": traces in (None, a.n)}
    if not all(good.values()):
        raise ValueError("axis 2 needs " + ", ".join(k for k, v in good.items() if not v))
    return a


def explicit_offsets(offsets: DataFrame, traces: int) -> DataFrame:
    """(i2, offset) of every trace, checked when it is read: finite, one each, none missing."""
    bad = F.raise_error(F.lit("an offset is missing or not finite"))
    every = offsets.sparkSession.range(traces).withColumnRenamed("id", "i2").join(offsets.groupBy("i2").agg(F.count("*").alias("n"), F.max("offset").alias("offset")), "i2", "left")
    fine = (F.col("n") == 1) & F.col("offset").isNotNull() & ~F.isnan("offset") & (F.abs("offset") != float("inf"))
    return every.select("i2", F.when(fine, F.col("offset")).otherwise(bad).alias("offset"))


# signal fixtures
def _signal(spark: SparkSession, axes: tuple[Axis, ...], value: Column, level: float, seed: int) -> Cube:
    c = Cube(grid(spark, axes).withColumn("v", value), Meta(axes))
    return add_noise(c, level, 0.0, seed) if level else c


def _ricker(t: Column, frequency: float) -> Column:
    s = F.pow(t * (math.pi * frequency), F.lit(2.0))
    return (1 - 2 * s) * F.exp(-s)


def mixed_trace(spark: SparkSession, n: int = 512, d: float = 0.004, level: float = 0.02, seed: int = 0) -> Cube:
    """sin at 20 Hz, a quarter of it at 70 Hz with phase 0.35, a trend of 0.08 a second, and noise."""
    t = F.lit(d) * F.col("i1")
    value = F.sin(2 * math.pi * 20 * t) + 0.25 * F.sin(2 * math.pi * 70 * t + 0.35) + 0.08 * (t - d * (n - 1) / 2)
    return _signal(spark, (Axis(n, 0.0, d, "Time", "s"),), value, level, seed)


def ricker_event(spark: SparkSession, n: int = 512, d: float = 0.004, peak: float = 0.6, frequency: float = 25.0) -> Cube:
    return _signal(spark, (Axis(n, 0.0, d, "Time", "s"),), _ricker(F.lit(d) * F.col("i1") - peak, frequency), 0.0, 0)


def channel_panel(spark: SparkSession, n: int = 512, d: float = 0.004, channels: int = 12, level: float = 0.04, seed: int = 0) -> Cube:
    """One event on all channels, whose amplitudes are 1 + 0.08 cos(channel)."""
    value = (1 + 0.08 * F.cos("i2")) * _ricker(F.lit(d) * F.col("i1") - 0.6, 25.0)
    return _signal(spark, (Axis(n, 0.0, d, "Time", "s"), Axis(channels, 0.0, 12.5, "Channel", "m")), value, level, seed)


def plane_wave(spark: SparkSession, n: int = 512, d: float = 0.002, offsets: Axis = Axis(24, -115.0, 10.0, "Offset", "m"), intercept: float = 0.45, speed: float = 1500.0, level: float = 0.01, seed: int = 0) -> Cube:
    place = F.lit(d) * F.col("i1") - (intercept + offsets.coordinate(F.col("i2")) / speed)
    return _signal(spark, (Axis(n, 0.0, d, "Time", "s"), offsets), _ricker(place, 30.0), level, seed)


def hyperbolic_gather(spark: SparkSession, n: int = 512, d: float = 0.004, offsets: Axis = Axis(21, -500.0, 50.0, "Offset", "m"), t0: float = 0.45, speed: float = 2200.0, level: float = 0.04, seed: int = 0) -> Cube:
    """A reflection with moveout, a 70 Hz tone of 0.2, a trend of 0.06 a second, and noise."""
    t, h = F.lit(d) * F.col("i1"), offsets.coordinate(F.col("i2"))
    value = _ricker(t - F.sqrt(t0 * t0 + h * h / (speed * speed)), 24.0) + 0.2 * F.sin(2 * math.pi * 70 * t) + 0.06 * (t - d * (n - 1) / 2)
    return _signal(spark, (Axis(n, 0.0, d, "Time", "s"), offsets), value, level, seed)
