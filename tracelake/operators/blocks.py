"""Lines along an axis of whole traces, in blocks of traces that overlap.

A line along axis 2 or more runs across traces and may be as long as the table.
It is cut into blocks of a bounded number of samples; each trace goes to its own
block and, if it lies within the operator's reach of the border, to the next
one.  A block is then a small panel, and the same kernel that works along axis 1
of whole traces works on its columns.  Results of the overlap are dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.cube import Cube

#: Traces and samples of a block, without the overlap; samples times reach of a strip that a kernel gets at a time.
TRACES, SAMPLES, STRIP = 1024, 1 << 21, 1 << 22

Kernel = Callable[[np.ndarray], np.ndarray]


def _size(own: Cube, reach: int, traces: int) -> int:
    return max(reach, 1, min(traces, SAMPLES // own.meta.axes[0].n))


def _blocked(own: Cube, axis: int, size: int, reach: int) -> DataFrame:
    """Every trace once for each block that needs it, as ``_block``."""
    at, last = F.col(f"i{axis}"), (own.meta.axis(axis).n - 1) // size
    blocks = F.array_distinct(F.array(*[F.floor((at + k) / size).cast("long") for k in (-reach, 0, reach)]))
    return own.df.withColumn("_block", F.explode(blocks)).where(F.col("_block").between(0, last))


def _panel(group: pa.Table, key: str, low: int, high: int, n1: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, n1 x (high - low) matrix) of a block's traces; absent traces are 0."""
    at = np.asarray(group.column(key)) - low
    x = np.zeros((high - low, n1))
    x[at] = np.asarray(group.column("samples").combine_chunks().flatten(), np.float64).reshape(-1, n1)
    return at, x.T


def _in_strips(x: np.ndarray, kernel: Kernel, reach: int) -> np.ndarray:
    """The kernel on some rows at a time, as kernels make ``reach`` copies of what they get."""
    rows = max(1, STRIP // (x.shape[1] * (2 * reach + 1)))
    return np.concatenate([kernel(x[k : k + rows]) for k in range(0, len(x), rows)])


def _rows(group: pa.Table, keys: list[str], chosen: np.ndarray, samples: np.ndarray) -> pa.Table:
    """The chosen rows of a block with new samples (a row for each)."""
    ends = pa.array(np.arange(len(samples) + 1, dtype=np.int32) * samples.shape[1])
    values = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(samples).reshape(-1)))
    return pa.table([*(group.column(k).take(pa.array(chosen)) for k in keys), values], names=[*keys, "samples"])


def _schema(keys: list[str]) -> str:
    return ", ".join([*(f"{k} long" for k in keys), "samples array<double>"])


def along(c: Cube, axis: int, kernel: Kernel, reach: int, traces: int = TRACES) -> Cube:
    """A kernel on (lines, samples) matrices, of which a sample needs ``reach`` samples either side, along axis 2 or more.

    One exchange of traces; a block holds at most ``traces`` of them (more if
    the reach is larger) and its overlap.
    """
    own, key = c.traces(), f"i{axis}"
    n1, n, size = own.meta.axes[0].n, own.meta.axis(axis).n, _size(c.traces(), reach, traces)
    keys = own.keys[1:]

    def run(group: pa.Table) -> pa.Table:
        block = group.column("_block")[0].as_py()
        low, high = max(0, block * size - reach), min(n, (block + 1) * size + reach)
        at, x = _panel(group, key, low, high, n1)
        mine = np.flatnonzero((at + low) // size == block)
        return _rows(group, keys, mine, _in_strips(x, kernel, reach).T[at[mine]])

    rest = [k for k in keys if k != key]
    out = own.derive(_blocked(own, axis, size, reach).groupBy(*rest, "_block").applyInArrow(run, _schema(keys)))
    return out if c.layout == "trace" else out.long()


def running(c: Cube, axis: int, terms: Kernel, reach: int, traces: int = TRACES) -> Cube:
    """Sums up to each sample of ``terms`` of a line, along axis 2 or more: within blocks, and of the blocks before.

    ``terms`` are what is summed, each from ``reach`` samples either side.  Only
    the sums of whole blocks, one trace for each, meet along a line.
    """
    own, key = c.traces(), f"i{axis}"
    n1, n, size = own.meta.axes[0].n, own.meta.axis(axis).n, _size(c.traces(), reach, traces)
    keys = own.keys[1:]
    rest = [k for k in keys if k != key]

    def summed(group: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
        block = group.column("_block")[0].as_py()
        low, high = max(0, block * size - reach), min(n, (block + 1) * size + reach)
        at, x = _panel(group, key, low, high, n1)
        got = terms(x).T[block * size - low : min(n, (block + 1) * size) - low]
        return np.cumsum(got, axis=0), at + low - block * size, block

    def inside(group: pa.Table) -> pa.Table:
        sums, at, _ = summed(group)
        mine = np.flatnonzero((at >= 0) & (at < size))
        return _rows(group, [*keys, "_block"], mine, sums[at[mine]])

    def total(group: pa.Table) -> pa.Table:
        return _rows(group, [*rest, "_block"], np.zeros(1, np.int64), summed(group)[0][-1:])

    blocked = _blocked(own, axis, size, reach)
    parts = blocked.groupBy(*rest, "_block").applyInArrow(inside, _schema([*keys, "_block"]))
    if n <= size:
        out = own.derive(parts.drop("_block"))
        return out if c.layout == "trace" else out.long()
    totals = blocked.groupBy(*rest, "_block").applyInArrow(total, _schema([*rest, "_block"]))
    # the blocks before each one: a row for each block and sample place, a window over blocks only
    cells = totals.select(*rest, "_block", F.posexplode("samples").alias("_at", "_sum"))
    upto = Window.partitionBy(*rest, "_at").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select(*rest, "_block", "_at", F.coalesce(F.sum("_sum").over(upto), F.lit(0.0)).alias("_sum"))
    before = before.groupBy(*rest, "_block").agg(F.array_sort(F.collect_list(F.struct("_at", "_sum"))).alias("_before"))  # a value for each sample of a trace
    joined = parts.join(before, [*rest, "_block"])
    df = joined.select(*keys, F.zip_with("samples", F.col("_before._sum"), lambda a, b: a + b).alias("samples"))
    out = own.derive(df)
    return out if c.layout == "trace" else out.long()


def chosen(c: Cube, axis: int, factor: int, n: int, d: float) -> Cube:
    """Every ``factor``-th place of an axis, renumbered."""
    own, key = c.traces(), f"i{axis}"
    df = own.df.where(F.col(key) % factor == 0).withColumn(key, F.floor(F.col(key) / factor).cast("long"))
    return replace(own, df=df, meta=own.meta.with_axis(axis, n=n, d=d), origin=None)
