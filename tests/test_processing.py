"""Metrics before and after processing."""

import numpy as np
import pytest

from tests.test_extra import cube
from tracelake.cube import Axis
from tracelake.operators import aggregate, metrics, pointwise


def test_processing_metrics(spark):
    rng = np.random.default_rng(1)
    t, h = Axis(64, 0.1, 0.004, "Time", "s"), Axis(6, 0.0, 50.0, "Offset", "m")
    x = rng.normal(size=(6, 64)) + 3 * np.sin(2 * np.pi * 25 * (0.1 + 0.004 * np.arange(64)))
    raw = cube(spark, x, t, h)
    after = raw.map(lambda v: v * 0.5)
    last = pointwise.mute(after, 0.15, 4000.0, raw.coordinate(2))
    stack = aggregate.stack(last, 2, "mean", False)
    got = metrics.processing_metrics(raw, raw, after, last, stack, (10, 30), (40, 60), mute_from=0.15)
    y = x * 0.5
    muted = (0.1 + 0.004 * np.arange(64))[None] < 0.15 + 50 * np.arange(6)[:, None] / 4000
    z = np.where(muted, 0, y)
    s = z.mean(axis=0)
    rms = lambda a: np.sqrt(np.mean(a**2))
    assert np.isclose(got["input_rms"], rms(x)) and np.isclose(got["output_rms"], rms(z))
    assert np.isclose(got["snr_improvement_db"], 0, atol=1e-9) and np.isclose(got["target_band_energy_ratio"], 0.25)
    assert np.isclose(got["stack_noise_reduction_ratio"], rms(s[40:60]) / rms(z[:, 40:60]))
    peak = 10 + np.argmax(np.abs(s[10:30]))
    assert np.isclose(got["stack_peak_time"], 0.1 + 0.004 * peak) and np.isclose(got["stack_peak_amplitude"], s[peak])
    assert np.isclose(got["muted_fraction"], muted.mean()) and got["mute_zero_fraction"] == 1 and got["finite_fraction"] == 1 and got["header_axis_ok"]
    checks = metrics.check_processing(got)
    assert not checks["snr_improved"] and checks["mute_applied"] and checks["finite"] and not checks["overall_pass"]
    assert metrics.check_processing(got, -1.0, (0.2, 0.3), 1.0, 10.0)["overall_pass"]
    other = got | {"input_rms": 2.0}
    assert metrics.compare_reports(got, got) == {} and metrics.compare_reports(got, {**other, "new": 1.0}) == {"input_rms": (got["input_rms"], 2.0), "new": (None, 1.0)}
    with pytest.raises(ValueError):
        metrics.processing_metrics(raw, raw, after, last, raw, (10, 30), (40, 60))
    with pytest.raises(ValueError):
        metrics.check_processing(got, target_ratio=(2.0, 1.0))
