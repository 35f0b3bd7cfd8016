"""Regularly sampled arrays as DataFrames.

A cube of N axes is a DataFrame in one of two layouts and a small metadata
object.  ``long``: one row a sample, ``i1 .. iN`` (zero-based, axis 1 fastest)
and ``v``.  ``trace``: one row a trace, ``i2 .. iN`` and ``samples``, the
values along axis 1.  Coordinates ``o + d * i`` are projected, never stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    n: int
    o: float = 0.0
    d: float = 1.0
    label: str = ""
    unit: str = ""

    def __post_init__(self):
        if self.n < 1:
            raise ValueError("an axis has one sample or more")

    def coordinate(self, index: Column) -> Column:
        return F.lit(self.o) + F.lit(self.d) * index


@dataclass(frozen=True)
class Meta:
    axes: tuple[Axis, ...]
    attrs: dict = field(default_factory=dict)

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(a.n for a in self.axes)

    def axis(self, k: int) -> Axis:
        if not 1 <= k <= len(self.axes):
            raise ValueError(f"axis {k} of {len(self.axes)}")
        return self.axes[k - 1]

    def with_axis(self, k: int, **changes) -> Meta:
        self.axis(k)
        return replace(self, axes=tuple(replace(a, **changes) if i == k else a for i, a in enumerate(self.axes, 1)))

    def without(self, k: int) -> Meta:
        self.axis(k)
        rest = tuple(a for i, a in enumerate(self.axes, 1) if i != k)
        return replace(self, axes=rest or (Axis(1),))

    def leftsize(self, k: int) -> int:
        out = 1
        for a in self.axes[k:]:
            out *= a.n
        return out


@dataclass(frozen=True)
class Cube:
    df: DataFrame
    meta: Meta
    layout: str = "long"
    #: Where only ``map`` made this cube: the rows it came from, and the function of their samples.
    origin: tuple[DataFrame, Callable[[Column], Column]] | None = field(default=None, repr=False, compare=False)

    @property
    def rank(self) -> int:
        return len(self.meta.axes)

    @property
    def keys(self) -> list[str]:
        return [f"i{k}" for k in range(1, self.rank + 1)]

    def others(self, axis: int) -> list[str]:
        return [k for k in self.keys if k != f"i{axis}"]

    def coordinate(self, axis: int) -> Column:
        return self.meta.axis(axis).coordinate(F.col(f"i{axis}"))

    def long(self) -> Cube:
        if self.layout == "long":
            return self
        rest = self.keys[1:]
        df = self.df.select(*rest, F.posexplode("samples").alias("i1", "v")).select(F.col("i1").cast("long").alias("i1"), *rest, "v")
        return replace(self, df=df, layout="long", origin=None)

    def traces(self) -> Cube:
        """Trace layout; missing samples are 0, so every trace has all its samples."""
        if self.layout == "trace":
            return self
        rest = self.keys[1:] or [F.lit(0).cast("long").alias("i2")]
        n = self.meta.axes[0].n
        cells = F.map_from_entries(F.collect_list(F.struct("i1", "v")))
        got = self.df.groupBy(*rest).agg(cells.alias("cells"))
        samples = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("cells", i), F.lit(0.0)))
        return replace(self, df=got.select(*(self.keys[1:] or ["i2"]), samples.alias("samples")), layout="trace", origin=None)

    def derive(self, df: DataFrame, meta: Meta | None = None, layout: str | None = None) -> Cube:
        return Cube(df, meta or self.meta, layout or self.layout)

    def map(self, value: Callable[[Column], Column]) -> Cube:
        """A function of the sample alone, in either layout."""
        rows, before = self._origin()
        origin = (rows, lambda v: value(before(v)))
        if self.layout == "trace":
            return replace(self, df=self.df.withColumn("samples", F.transform("samples", lambda v: value(v))), origin=origin)
        return replace(self, df=self.df.withColumn("v", value(F.col("v"))), origin=origin)

    def _origin(self) -> tuple[DataFrame, Callable[[Column], Column]]:
        return self.origin or (self.df, lambda v: v)

    def beside(self, other: Cube) -> DataFrame:
        """Rows of both cubes in this one's layout, the other's samples (or v) as ``_other``; joined only if they come from different rows."""
        name = "samples" if self.layout == "trace" else "v"
        (mine, one), (theirs, two) = self._origin(), other._origin()
        if mine is theirs and self.layout == other.layout:
            both = (F.transform(name, lambda v: f(v)) if name == "samples" else f(F.col(name)) for f in (one, two))
            return mine.select(*[k for k in self.df.columns if k != name], *(c.alias(n) for c, n in zip(both, (name, "_other"), strict=True)))
        right = other.traces() if self.layout == "trace" else other.long()
        return self.df.join(right.df.withColumnRenamed(name, "_other"), [k for k in self.df.columns if k != name])

    def map_traces(self, kernel: Callable[[np.ndarray], np.ndarray], first: Axis | None = None) -> Cube:
        """A NumPy kernel on (traces, samples) matrices, Arrow batch by batch."""
        own = self.traces()
        names = own.df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                at = names.index("samples")
                column = batch.column(at)
                matrix = np.asarray(column.flatten(), np.float64).reshape(batch.num_rows, -1)
                out = np.ascontiguousarray(kernel(matrix), np.float64)
                ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * out.shape[1], pa.int32())
                columns = batch.columns
                columns[at] = pa.ListArray.from_arrays(ends, pa.array(out.reshape(-1)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

        schema = ", ".join(f"{c} {'array<double>' if c == 'samples' else 'long'}" for c in names)
        axes = (first, *self.meta.axes[1:]) if first else self.meta.axes
        return Cube(own.df.mapInArrow(run, schema), replace(self.meta, axes=axes), "trace")


def from_traces(df: DataFrame, key: str, samples: str, n1: int, n2: int, first: Axis | None = None) -> Cube:
    """Two-axis cube from one row a trace."""
    rows = df.select(F.col(key).cast("long").alias("i2"), F.col(samples).cast("array<double>").alias("samples"))
    return Cube(rows, Meta((first or Axis(n1), Axis(n2))), "trace")


def grid(spark: SparkSession, axes: tuple[Axis, ...]) -> DataFrame:
    """All index tuples of the axes: one range, split by arithmetic, so no join."""
    total = 1
    for a in axes:
        total *= a.n
    df, step = spark.range(total), 1
    cols = []
    for k, a in enumerate(axes, 1):
        cols.append((F.floor(F.col("id") / step).cast("long") % a.n).alias(f"i{k}"))
        step *= a.n
    return df.select(*cols)
