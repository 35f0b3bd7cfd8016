"""Transforms along lines of any length across traces, in several exchanges.

The transform of n = r * s points is s-point transforms of every r-th point, a
twist of each result, and r-point transforms of these: two exchanges, and no
task holds more than max(r, s) traces of a line.  Where n has no two factors
near its root it is a convolution with a chirp (the exponent j k is half of
j^2 + k^2 - (k - j)^2), whose transforms have a power of two of points.

Rows are (keys, ``re``, ``im``): whole traces as arrays, moved as they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Traces of a line that one task may transform at once; of lines longer than its square, some times their root.
MOST = 2048


def factors(n: int, most: int = MOST) -> tuple[int, int] | None:
    """(r, s) with n = r * s, as near each other as may be; (1, n) for short lines; None if one would be above ``most``."""
    if n <= min(most, 64):
        return 1, n
    r = next(k for k in range(math.isqrt(n), 0, -1) if n % k == 0)
    return (r, n // r) if n // r <= max(most, 4 * r) else None


def _table(group: pa.Table, keys: list[str], size: int, key: str, at: np.ndarray) -> np.ndarray:
    """Rows of a group at their places, as complex (size, samples); absent ones are 0."""
    re, im = (np.asarray(group.column(c).combine_chunks().flatten(), np.float64).reshape(group.num_rows, -1) for c in ("re", "im"))
    z = np.zeros((size, re.shape[1]), np.complex128)
    z[at] = re + 1j * im
    return z


def _rows(rest: dict[str, object], key: str, places: np.ndarray, z: np.ndarray, types: dict[str, pa.DataType]) -> pa.Table:
    ends = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
    lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x).reshape(-1))) for x in (z.real, z.imag)]
    fixed = {k: pa.array([v] * len(z), types[k]) for k, v in rest.items()}
    return pa.table({**fixed, key: pa.array(places.astype(np.int64)), "re": lists[0], "im": lists[1]})


def _step(df: DataFrame, keys: list[str], key: str, part, size: int, work: Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]], where: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """Groups of ``size`` rows that share the other keys and ``part``; ``work`` gives new places and rows."""
    rest = [k for k in keys if k != key]

    def run(group: pa.Table) -> pa.Table:
        p = group.column("_part")[0].as_py()
        at = np.asarray(group.column(key))
        places, z = work(_table(group, keys, size, key, where(at, p)), p)
        return _rows({k: group.column(k)[0].as_py() for k in rest}, key, places, z, {k: group.schema.field(k).type for k in rest})

    schema = ", ".join([*(f"{k} long" for k in rest), f"{key} long", "re array<double>", "im array<double>"])
    return df.withColumn("_part", part).groupBy(*rest, "_part").applyInArrow(run, schema).select(*keys, "re", "im")


def _two_step(df: DataFrame, keys: list[str], key: str, r: int, s: int, sign: int) -> DataFrame:
    n = r * s
    dft = (lambda z: np.fft.fft(z, axis=0)) if sign < 0 else (lambda z: np.fft.ifft(z, axis=0) * len(z))
    twist = lambda a, b: np.exp(sign * 2j * np.pi * ((a * b) % n) / n)
    if r == 1:
        return _step(df, keys, key, F.lit(0), n, lambda z, p: (np.arange(n), dft(z)), lambda at, p: at)
    # place j = p + r * m: over m for each p, then over p for each result q
    first = _step(df, keys, key, F.col(key) % r, s, lambda z, p: (np.arange(s) * r + p, dft(z) * twist(p, np.arange(s))[:, None]), lambda at, p: at // r)
    return _step(first, keys, key, F.floor(F.col(key) / r).cast("long"), r, lambda z, q: (q + s * np.arange(r), dft(z)), lambda at, q: at % r)


def _chirp(k: np.ndarray, n: int, sign: int) -> np.ndarray:
    return np.exp(sign * 1j * np.pi * ((k * k) % (2 * n)) / n)


def _times(df: DataFrame, keys: list[str], key: str, factor: Callable[[np.ndarray], np.ndarray], keep: int) -> DataFrame:
    """Every row times a number of its place; places from ``keep`` on go."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                at = np.asarray(t.column(key))
                z = _table(t, keys, len(at), key, np.arange(len(at))) * factor(at)[:, None]
                ends = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x).reshape(-1))) for x in (z.real, z.imag)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *lists], names=[*keys, "re", "im"])

    schema = ", ".join([*(f"{k} long" for k in keys), "re array<double>", "im array<double>"])
    return df.where(F.col(key) < keep).select(*keys, "re", "im").mapInArrow(run, schema)


def along(df: DataFrame, keys: list[str], axis: int, n: int, sign: int = -1, most: int = MOST) -> DataFrame:
    """Sums over j of row j times exp(sign * 2 pi i j k / n) for every k, along axis 2 or more; absent rows are 0."""
    key = f"i{axis}"
    two = factors(n, most)
    if two:
        return _two_step(df, keys, key, *two, sign)
    m = 1 << (2 * n - 2).bit_length()
    near, far = np.arange(n), np.arange(1, n)
    kernel = np.zeros(m, np.complex128)
    kernel[:n], kernel[m - far] = _chirp(near, n, -sign), _chirp(far, n, -sign)
    kernel = np.fft.fft(kernel)  # m numbers, for all lines
    pair = factors(m, m)  # at most twice the root of m
    twisted = _times(df, keys, key, lambda j: _chirp(j, n, sign), n)
    spectrum = _times(_two_step(twisted, keys, key, *pair, -1), keys, key, lambda k: kernel[k] / m, m)
    return _times(_two_step(spectrum, keys, key, *pair, 1), keys, key, lambda k: _chirp(k, n, sign), n)


def shifted(df: DataFrame, axis: int, n: int, by: int) -> DataFrame:
    """Places moved round by ``by``."""
    return df.withColumn(f"i{axis}", F.pmod(F.col(f"i{axis}") + by, F.lit(n)).cast("long"))
