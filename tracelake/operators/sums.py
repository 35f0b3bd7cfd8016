"""Sums of whole traces by key: arrays are added up inside tasks, and merged as arrays after one exchange.

A task keeps an array for each key it meets (up to a bound of memory, then it
puts them out and goes on), so what moves is a row for each task and key, not
one for each trace or sample.  After the exchange rows arrive sorted by key and
are added up as they stream through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Numbers that a task keeps.
HELD = 1 << 23

Kernel = Callable[[pa.RecordBatch], Iterator[tuple[tuple, np.ndarray]]]


def array_sums(df: DataFrame, keys: dict[str, str], kernel: Kernel) -> DataFrame:
    """(keys .., sums): ``kernel`` gives (key, array) pairs of a batch of ``df``; arrays of a key have one length and are added.

    ``keys`` are names and types of a key's parts; null is a key as any other.
    """
    names = list(keys)
    schema = ", ".join([*(f"{k} {t}" for k, t in keys.items()), "sums array<double>"])

    def put_out(held: dict[tuple, np.ndarray], kinds: list[pa.DataType]) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True))
        arrays = list(held.values())
        ends = pa.array(np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32))
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(arrays)))], names=[*names, "sums"])

    kinds = [f.dataType for f in StructType.fromDDL(schema).fields[:-1]]

    def types() -> list[pa.DataType]:
        return [to_arrow_type(k) for k in kinds]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        count, mine = 0, types()
        for batch in batches:
            if not batch.num_rows:
                continue
            for key, values in kernel(batch):
                if key in held:
                    held[key] += values
                    continue
                held[key] = np.array(values, np.float64)
                count += len(values)
                if count > HELD:
                    yield put_out(held, mine)
                    held, count = {}, 0
        if held:
            yield put_out(held, mine)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple, np.ndarray] = {}
        now, total, count, mine = None, None, 0, types()
        for batch in batches:
            for *key, values in zip(*(c.to_pylist() for c in batch.columns[:-1]), batch.column(len(names)), strict=True):
                own = np.asarray(values.values, np.float64)
                if total is not None and now == tuple(key):
                    total = total + own
                    continue
                if total is not None:
                    done[now] = total
                    count += len(total)
                    if count > HELD:
                        yield put_out(done, mine)
                        done, count = {}, 0
                now, total = tuple(key), own
        if total is not None:
            done[now] = total
        if done:
            yield put_out(done, mine)

    parts = df.mapInArrow(add_up, schema)
    dealt = parts.repartition(*names).sortWithinPartitions(*names) if names else parts.coalesce(1)  # without keys, an array a task
    return dealt.mapInArrow(merge, schema)


def matrix(batch: pa.RecordBatch, name: str = "samples") -> np.ndarray:
    """A column of equally long arrays."""
    column = batch.column(batch.schema.get_field_index(name))
    return np.asarray(column.flatten(), np.float64).reshape(batch.num_rows, -1)


def by_group(batch: pa.RecordBatch, names: list[str]) -> Callable[[np.ndarray], Iterator[tuple[tuple, np.ndarray]]]:
    """A function that adds up the rows of a matrix by the values of key columns."""
    keys = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in names), strict=True)) if names else [()] * batch.num_rows
    codes: dict[tuple, int] = {}
    code = np.fromiter((codes.setdefault(k, len(codes)) for k in keys), np.int64, len(keys))
    order = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[order], np.arange(len(codes)))
    return lambda rows: zip(codes, np.add.reduceat(rows[order], starts, axis=0), strict=True)


def lookup(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Linear interpolation of each row at fractional places, 0 outside and where a place is NaN."""
    n = x.shape[1]
    inside = (place >= 0) & (place <= n - 1)
    p = np.where(inside, place, 0.0)
    k = np.floor(p).astype(np.int64)
    part = p - k
    got = np.take_along_axis(x, k, 1) * (1 - part) + np.take_along_axis(x, np.minimum(k + 1, n - 1), 1) * part
    return np.where(inside, got, 0.0)


def exploded(df: DataFrame, keys: list[str], n: int, parts: list[str]) -> DataFrame:
    """(keys, i1, parts ..) of sums whose arrays hold ``parts`` one after the other, each of n samples."""
    pieces = [F.slice("sums", k * n + 1, n).alias(p) for k, p in enumerate(parts)]
    zipped = df.select(*keys, *pieces).select(*keys, F.posexplode(F.arrays_zip(*parts)).alias("i1", "_z"))
    return zipped.select(*keys, F.col("i1").cast("long").alias("i1"), *[F.col(f"_z.{p}").alias(p) for p in parts])
