"""SEG-Y files of traces of one length.

A file is a text header, a binary header and records of one size, so tasks read
byte ranges of whole traces, as for ``rsf``.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import headers
from tracelake.sources.rsf import BLOCK, _open

# The words of a trace header in order, with their bytes.
# fmt: off
WORDS = [
    ("tracl", 4), ("tracr", 4), ("fldr", 4), ("tracf", 4), ("ep", 4), ("cdp", 4), ("cdpt", 4), ("trid", 2), ("nvs", 2), ("nhs", 2), ("duse", 2),
    ("offset", 4), ("gelev", 4), ("selev", 4), ("sdepth", 4), ("gdel", 4), ("sdel", 4), ("swdep", 4), ("gwdep", 4), ("scalel", 2), ("scalco", 2),
    ("sx", 4), ("sy", 4), ("gx", 4), ("gy", 4), ("counit", 2), ("wevel", 2), ("swevel", 2), ("sut", 2), ("gut", 2), ("sstat", 2), ("gstat", 2),
    ("tstat", 2), ("laga", 2), ("lagb", 2), ("delrt", 2), ("muts", 2), ("mute", 2), ("ns", 2), ("dt", 2), ("gain", 2), ("igc", 2), ("igi", 2),
    ("corr", 2), ("sfs", 2), ("sfe", 2), ("slen", 2), ("styp", 2), ("stas", 2), ("stae", 2), ("tatyp", 2), ("afilf", 2), ("afils", 2), ("nofilf", 2),
    ("nofils", 2), ("lcf", 2), ("hcf", 2), ("lcs", 2), ("hcs", 2), ("year", 2), ("day", 2), ("hour", 2), ("minute", 2), ("sec", 2), ("timbas", 2),
    ("trwf", 2), ("grnors", 2), ("grnofr", 2), ("grnlof", 2), ("gaps", 2), ("otrav", 2), ("cdpx", 4), ("cdpy", 4), ("iline", 4), ("xline", 4),
    ("shnum", 4), ("shsca", 2), ("tval", 2), ("tconst4", 4), ("tconst2", 2), ("tunits", 2), ("device", 2), ("tscalar", 2), ("stype", 2),
    ("sendir", 4), ("unknown", 2), ("smeas4", 4), ("smeas2", 2), ("smeasu", 2), ("unass1", 4), ("unass2", 4),
]
# fmt: on
NAMES = [name for name, _ in WORDS]
TEXT, BINARY, HEAD = 3200, 400, 240
# Sample formats by code (1, base-16 floats, is decoded apart).
SAMPLES = {1: "u4", 2: "i4", 3: "i2", 5: "f4", 7: "i1", 8: "i1"}


@dataclass(frozen=True)
class Layout:
    order: str
    kind: int
    samples: int
    interval: int
    traces: int

    @property
    def record(self) -> np.dtype:
        head = [(name, f"{self.order}i{size}") for name, size in WORDS]
        return np.dtype([*head, ("samples", self.order + SAMPLES[self.kind], (self.samples,))])


def layout(path: str, endian: str = "auto", kind: int | None = None) -> Layout:
    """From the binary header; ``auto`` takes the byte order in which the format code is known."""
    system, name = _open(path)
    with system.open_input_file(name) as f:
        if f.size() < TEXT + BINARY:
            raise ValueError(f"{path} ends within its headers")
        head = f.read_at(BINARY, TEXT)
        size = f.size()
    at = lambda order, k: int(np.frombuffer(head, order + "u2", 1, k)[0])
    orders = {"big": ">", "little": "<"}
    order = orders.get(endian) or next((o for o in (">", "<") if at(o, 24) in SAMPLES and at(o, 20)), None)
    if order is None or (code := kind or at(order, 24)) not in SAMPLES:
        raise ValueError("byte order or sample format is unknown")
    n = at(order, 20)
    record = HEAD + n * np.dtype(SAMPLES[code]).itemsize
    if not n or (size - TEXT - BINARY) % record:
        raise ValueError("traces of several lengths, or a file cut short")
    return Layout(order, code, n, at(order, 16), (size - TEXT - BINARY) // record)


def from_ibm(words: np.ndarray) -> np.ndarray:
    """Base-16 floats: sign, exponent of 16 less 64, fraction of 24 bits."""
    w = words.astype(np.int64)
    return np.where(w >> 31 & 1, -1.0, 1.0) * (w & 0xFFFFFF) / 2.0**24 * 16.0 ** ((w >> 24 & 0x7F) - 64)


def to_ibm(values: np.ndarray) -> np.ndarray:
    v = np.abs(np.asarray(values, np.float64))
    power = np.where(v > 0, np.floor(np.log2(np.where(v > 0, v, 1)) / 4) + 1, -64).astype(np.int64)
    fraction = np.rint(v / 16.0**power * 2**24).astype(np.int64)
    power, fraction = np.where(fraction >= 1 << 24, power + 1, power), np.where(fraction >= 1 << 24, fraction >> 4, fraction)
    if (power > 63).any():
        raise ValueError("a value too large for base-16 floats")
    live = (fraction > 0) & (power >= -64)
    return np.where(live, (np.signbit(values).astype(np.int64) << 31) | (power + 64 << 24) | fraction, 0).astype(np.uint32)


def read(spark: SparkSession, path: str, endian: str = "auto", kind: int | None = None, partition_bytes: int = 64 << 20) -> tuple[DataFrame, Layout]:
    """(trace, 91 header words, samples) one row a trace, and the layout; a trace whose own length differs raises."""
    found = layout(path, endian, kind)
    record = found.record
    step = max(1, BLOCK // record.itemsize)
    fields = ["trace", *NAMES, "samples"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, name = _open(path)
        with files.open_input_file(name) as f:
            for batch in batches:
                for start in batch.column(0).to_pylist():
                    n = min(step, found.traces - start)
                    rows = np.frombuffer(f.read_at(n * record.itemsize, TEXT + BINARY + start * record.itemsize), record)
                    if (rows["ns"].astype(np.uint16) != found.samples).any():
                        raise ValueError("traces of several lengths")
                    values = from_ibm(rows["samples"]) if found.kind == 1 else rows["samples"]
                    ends = pa.array(np.arange(n + 1, dtype=np.int32) * found.samples, pa.int32())
                    columns = [pa.array(np.arange(start, start + n)), *(pa.array(rows[w].astype(np.int32)) for w in NAMES)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, pa.array(values.astype(np.float32).reshape(-1)))], names=fields)

    schema = "trace long, " + ", ".join(f"`{w}` int" for w in NAMES) + ", samples array<float>"
    parts = max(1, min(found.traces, -(-found.traces * record.itemsize // partition_bytes)))
    return spark.range(0, found.traces, step, parts).mapInArrow(run, schema), found


def header_table(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Header words of every trace; samples are not made, nor read where traces are long."""
    from tracelake.sources import planned

    return planned.segy_traces(spark, path, ["trace", *(keys or NAMES)])


def write(traces: DataFrame, path: str, samples: int, interval: int, kind: int = 5, order: str = ">", text: str = "") -> None:
    """Traces (``trace``, ``samples`` and any header words, others being 0) in order of ``trace``; integers are rounded half to even.

    In a mounted file system every task writes its traces at their places in
    one file, which then gets its name; elsewhere each range of traces is a part
    file, and parts are joined in order.
    """
    if not (0 < samples < 1 << 16 and 0 < interval < 1 << 16):
        raise ValueError("samples and interval (in microseconds) have 16 bits")
    record = Layout(order, kind, samples, interval, 0).record
    given = [w for w in NAMES if w in traces.columns]
    binary = bytearray(BINARY)
    for k, value in ((16, interval), (20, samples), (24, kind)):
        binary[k : k + 2] = np.array([value], order + "u2").tobytes()
    first = text.ljust(TEXT)[:TEXT].encode("cp037") + bytes(binary)

    def records(batch: pa.RecordBatch) -> np.ndarray:
        """Of columns of the given words and, last, samples."""
        rows = np.zeros(batch.num_rows, record)
        for k, w in enumerate(given):
            rows[w] = batch.column(k).to_numpy(zero_copy_only=False)
        values = np.asarray(batch.column(len(given)).flatten(), np.float64).reshape(batch.num_rows, samples)
        rows["samples"] = to_ibm(values) if kind == 1 else values if kind == 5 else np.rint(values)
        rows["ns"], rows["dt"] = np.uint16(samples).astype(np.int16), np.uint16(interval).astype(np.int16)
        return rows

    if isinstance(_open(path)[0], fs.LocalFileSystem):
        _write_at(_numbered(traces), _open(path)[1], first, record.itemsize, given, records)
        return
    system, name = _open(path + "@parts")
    if system.get_file_info(name).type != fs.FileType.NotFound:
        raise ValueError(f"{path}@parts is there already")
    system.create_dir(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = _open(path + "@parts")
        task = TaskContext.get()
        mine = f"{root}/.{task.partitionId()}-{task.taskAttemptId()}"
        with files.open_output_stream(mine) as sink:
            for batch in batches:
                sink.write(records(batch).tobytes())
        files.move(mine, f"{root}/{task.partitionId():08d}")
        yield pa.RecordBatch.from_arrays([pa.array([0])], names=["done"])

    ordered = traces.repartitionByRange("trace").sortWithinPartitions("trace").select(*given, F.col("samples").cast("array<double>").alias("samples"))
    ordered.mapInArrow(run, "done long").write.format("noop").mode("overwrite").save()
    target, out = _open(path)
    with target.open_output_stream(out) as sink:
        sink.write(first)
        for info in sorted(system.get_file_info(fs.FileSelector(name)), key=lambda f: f.path):
            if not info.base_name.startswith("."):
                with system.open_input_stream(info.path) as source:
                    while block := source.read(BLOCK):
                        sink.write(block)
    system.delete_dir(name)


def _numbered(traces: DataFrame) -> DataFrame:
    """``trace`` as places 0, 1, .. in its order; one sort if it isn't so already."""
    got = traces.agg(F.count("*"), F.count_distinct("trace"), F.min("trace"), F.max("trace")).first()
    if not got[0] or (got[0] == got[1] and (got[2], got[3]) == (0, got[0] - 1)):
        return traces
    return headers.sort(traces, "trace", "trace").withColumn("trace", F.col("position"))


def _write_at(traces: DataFrame, out: str, first: bytes, size: int, given: list[str], records: Callable[[pa.RecordBatch], np.ndarray]) -> None:
    """Every record at its place; a task run again writes the same bytes, and the file gets its name when all are there."""
    temporary = f"{out}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        f.write(first)
        f.truncate(len(first) + traces.count() * size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(temporary, "r+b") as f:  # fails where executors don't see the driver's files
            for batch in batches:
                rows = records(batch)
                for place, row in zip(batch.column(batch.num_columns - 1).to_pylist(), rows, strict=True):
                    f.seek(len(first) + place * size)
                    f.write(row.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([0])], names=["done"])

    chosen = traces.select(*given, F.col("samples").cast("array<double>").alias("samples"), F.col("trace").cast("long").alias("trace"))
    chosen.mapInArrow(run, "done long").write.format("noop").mode("overwrite").save()
    os.replace(temporary, out)
