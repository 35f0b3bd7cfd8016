"""Data sources of trace files: partitions of byte ranges, trace ranges pushed down, header words pruned.

``register(spark)`` makes ``spark.read.format("traces_segy")`` and
``format("traces_dataset")`` known.  Filters on the trace number (and on the
slowest index of a dataset) become ranges of traces, and only their bytes are
read.  A schema that is given with ``.schema(..)`` names the columns to make;
without ``samples`` only the 240 bytes of each SEG-Y trace header are read where
that is less than the traces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from tracelake.sources import rsf, segy

#: Bytes of traces of a partition, unless the option ``partition_bytes`` says more or less.
PARTITION_BYTES = 64 << 20
#: Records from this size on are skipped over to the next header; shorter ones are read through.
SKIP = 1 << 16


@dataclass
class Traces(ds.InputPartition):
    """Traces start .. stop - 1."""

    start: int
    stop: int


class _Reader(ds.DataSourceReader):
    """Ranges of ``count`` traces of ``size`` bytes; ``units`` maps columns to the traces that one step of theirs is."""

    def __init__(self, options: dict[str, str], schema: StructType, count: int, size: int, units: dict[str, int]):
        self.columns, self.count, self.size, self.units = schema.fieldNames(), count, size, units
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.ranges = [(0, count)]

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            unit = self.units.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            wanted = self._wanted(f) if unit else None
            if wanted is None:
                yield f
            else:
                cut = [(a * unit, b * unit) for a, b in wanted]
                self.ranges = sorted((max(a, c), min(b, d)) for a, b in self.ranges for c, d in cut if max(a, c) < min(b, d))

    def _wanted(self, f: ds.Filter) -> list[tuple[int, int]] | None:
        """Half-open ranges of a column's values; None if the filter is of another kind."""
        end = self.count
        if isinstance(f, ds.IsNotNull):
            return [(0, end)]
        if isinstance(f, ds.In):
            values = set(f.value) - {None}
            return [(v, v + 1) for v in sorted(values)] if all(isinstance(v, int) for v in values) else None
        if not isinstance(getattr(f, "value", None), int):
            return None
        v = f.value
        found = {ds.EqualTo: (v, v + 1), ds.GreaterThan: (v + 1, end), ds.GreaterThanOrEqual: (v, end), ds.LessThan: (0, v), ds.LessThanOrEqual: (0, v + 1)}.get(type(f))
        return None if found is None else [found]

    def partitions(self) -> list[Traces]:
        step = max(1, self.bytes // self.size)
        return [Traces(k, min(k + step, b)) for a, b in self.ranges for k in range(a, b, step)] or [Traces(0, 0)]


class _SegyReader(_Reader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path = options["path"]
        self.layout = segy.layout(self.path, options.get("endian", "auto"), int(options["kind"]) if "kind" in options else None)
        super().__init__(options, schema, self.layout.traces, self.layout.record.itemsize, {"trace": 1})

    def read(self, partition: Traces) -> Iterator[pa.RecordBatch]:
        record = self.layout.record
        heads_only = "samples" not in self.columns and record.itemsize >= SKIP
        kind = np.dtype([(name, record.fields[name][0]) for name in record.names[:-1]]) if heads_only else record
        step = max(1, rsf.BLOCK // kind.itemsize)
        files, name = rsf._open(self.path)
        with files.open_input_file(name) as f:
            for start in range(partition.start, partition.stop, step):
                n = min(step, partition.stop - start)
                first = segy.TEXT + segy.BINARY + start * record.itemsize
                data = b"".join(f.read_at(segy.HEAD, first + k * record.itemsize) for k in range(n)) if heads_only else f.read_at(n * record.itemsize, first)
                rows = np.frombuffer(data, kind)
                if (rows["ns"].astype(np.uint16) != self.layout.samples).any():
                    raise ValueError("traces of several lengths")
                yield pa.RecordBatch.from_arrays([self._column(c, rows, start) for c in self.columns], names=self.columns)

    def _column(self, column: str, rows: np.ndarray, start: int) -> pa.Array:
        if column == "trace":
            return pa.array(np.arange(start, start + len(rows)))
        if column == "samples":
            values = segy.from_ibm(rows["samples"]) if self.layout.kind == 1 else rows["samples"]
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * self.layout.samples)
            return pa.ListArray.from_arrays(ends, pa.array(values.astype(np.float32).reshape(-1)))
        return pa.array(rows[column].astype(np.int32))


class SegyTraces(ds.DataSource):
    """Options path, endian (auto, big, little), kind (sample format code), partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "traces_segy"

    def schema(self) -> str:
        return "trace long, " + ", ".join(f"`{w}` int" for w in segy.NAMES) + ", samples array<float>"

    def reader(self, schema: StructType) -> _SegyReader:
        unknown = set(schema.fieldNames()) - {"trace", "samples", *segy.NAMES}
        if unknown:
            raise ValueError(f"no header words {sorted(unknown)}")
        return _SegyReader(dict(self.options), schema)


class _DatasetReader(_Reader):
    def __init__(self, options: dict[str, str], schema: StructType):
        path = options["path"]
        header = rsf.read_header(path)
        self.kind = header.get("data_format", "native_float")
        if self.kind not in rsf.FORMATS:
            raise ValueError(f"data_format {self.kind} is not one of whole traces of real numbers")
        self.meta, self.payload = rsf.meta_of(header), rsf._payload(path, header)
        size = self.meta.axes[0].n * np.dtype(rsf.FORMATS[self.kind]).itemsize
        count, last = self.meta.leftsize(1), len(self.meta.axes)
        system, name = rsf._open(self.payload)
        if system.get_file_info(name).size < count * size:
            raise ValueError(f"{self.payload} holds fewer samples than its axes")
        super().__init__(options, schema, count, size, {"trace": 1} | ({f"i{last}": count // self.meta.axes[-1].n} if last > 1 else {}))

    def read(self, partition: Traces) -> Iterator[pa.RecordBatch]:
        n1, step = self.meta.axes[0].n, max(1, rsf.BLOCK // self.size)
        files, name = rsf._open(self.payload)
        with files.open_input_file(name) as f:
            for start in range(partition.start, partition.stop, step):
                n = min(step, partition.stop - start)
                at, unit, columns = np.arange(start, start + n), 1, {"trace": pa.array(np.arange(start, start + n))}
                for k, a in enumerate(self.meta.axes[1:], 2):
                    columns[f"i{k}"] = pa.array(at // unit % a.n)
                    unit *= a.n
                if "samples" in self.columns:
                    values = np.frombuffer(f.read_at(n * self.size, start * self.size), rsf.FORMATS[self.kind]).astype(np.float64)
                    columns["samples"] = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * n1), pa.array(values))
                yield pa.RecordBatch.from_arrays([columns[c] for c in self.columns], names=self.columns)


class DatasetTraces(ds.DataSource):
    """Options path (of the header), partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "traces_dataset"

    def _keys(self) -> list[str]:
        return [f"i{k}" for k in range(2, len(rsf.meta_of(rsf.read_header(self.options["path"])).axes) + 1)]

    def schema(self) -> str:
        return ", ".join(["trace long", *(f"{k} long" for k in self._keys()), "samples array<double>"])

    def reader(self, schema: StructType) -> _DatasetReader:
        unknown = set(schema.fieldNames()) - {"trace", "samples", *self._keys()}
        if unknown:
            raise ValueError(f"no columns {sorted(unknown)}")
        return _DatasetReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Both formats, and filters pushed down to them, for the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (SegyTraces, DatasetTraces):
        spark.dataSource.register(source)


def segy_traces(spark: SparkSession, path: str, columns: list[str] | None = None, **options: object) -> DataFrame:
    """``columns`` (trace, header words, samples; all by default) of a SEG-Y file."""
    register(spark)
    kinds = {"trace": "long", "samples": "array<float>"}
    reader = spark.read.format("traces_segy").options(**options)
    return (reader.schema(", ".join(f"`{c}` {kinds.get(c, 'int')}" for c in columns)) if columns else reader).load(path)


def dataset_traces(spark: SparkSession, path: str, columns: list[str] | None = None, **options: object) -> DataFrame:
    """``columns`` (trace, i2 .., samples; all by default) of a dataset of real numbers."""
    register(spark)
    reader = spark.read.format("traces_dataset").options(**options)
    return (reader.schema(", ".join(f"{c} {'array<double>' if c == 'samples' else 'long'}" for c in columns)) if columns else reader).load(path)
